"""Every query against its SQL in DuckDB, at the smallest scale (tools/check.py runs larger ones)."""

import sys
from pathlib import Path

import pytest

pytest.importorskip("duckdb")
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import check  # noqa: E402
from queries.all import ORACLE, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    ok, note = check.compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf)
    assert ok, note


def test_names_and_entries():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not [n for n in QUERIES if n.startswith("op") and n[2:3].isdigit()]
