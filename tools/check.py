"""Compare queries with their oracle SQL in DuckDB: python tools/check.py [--sf 0.01] [name ...]"""

from __future__ import annotations

import argparse
import math
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from millrace import session  # noqa: E402


def normal(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(normal(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), normal(x)) for k, x in v.items()))
    return v


def rows_of(arrow):
    names = sorted(arrow.column_names)
    cols = [arrow.column(n).to_pylist() for n in names]
    return names, sorted((tuple(normal(v) for v in r) for r in zip(*cols)), key=repr) if cols else []


def type_name(t) -> str:
    return {"large_string": "string", "timestamp[us, tz=UTC]": "timestamp[us]+tz", "string_view": "string",
            "large_list<item: string>": "list"}.get(str(t), str(t))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    got = fn(spark, sf_dir).toArrow()
    took = time.time() - t0
    if sql is None:
        return True, f"rows-only n={got.num_rows} {took:.2f}s"
    want = con.execute(sql).to_arrow_table()
    gn, gr = rows_of(got)
    wn, wr = rows_of(want)
    if gn != wn:
        return False, f"columns {gn} != {wn}"
    types = [(n, type_name(got.schema.field(n).type), type_name(want.schema.field(n).type)) for n in gn]
    odd = [t for t in types if t[1] != t[2]]
    if len(gr) != len(wr):
        return False, f"rows {len(gr)} != {len(wr)} {odd}"
    bad = [(a, b) for a, b in zip(gr, wr) if a != b]
    note = f"n={len(gr)} {took:.2f}s" + (f" TYPES {odd}" if odd else "")
    if bad:
        return False, f"{len(bad)} differ of {len(gr)}; first {bad[0]} {odd}"
    return True, note + ("  EMPTY" if not gr else "")


def connect(sf_dir):
    con = duckdb.connect()
    for t in session.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from queries.all import ORACLE, QUERIES
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = session.get_session("check", "local[8]", **{"spark__sql__shuffle__partitions": 8,
                                                        "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false",
                                                        "spark__driver__memory": "12g",
                                                        "spark__checkpoint__dir": Path(tempfile.mkdtemp(prefix="check-")).as_uri()})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    names = [n for n in QUERIES if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1]))
                                                         for a in args.names)]
    for name in names:
        try:
            ok, note = compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        if not ok:
            failed.append(name)
        print(("ok  " if ok else "FAIL"), name, note, flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
