import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from millrace import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session.get_session("tests", "local[4]", **{
        "spark__sql__shuffle__partitions": 4, "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false", "spark__driver__memory": "6g",
        "spark__checkpoint__dir": tmp_path_factory.mktemp("checkpoint").as_uri(),
        "spark__sql__warehouse__dir": tmp_path_factory.mktemp("warehouse").as_uri()})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def events(spark, sf):
    return session.table(spark, sf, "events")
