"""Run registered queries against their SQL in DuckDB: ``python tests/oracle.py [-s SF] [name ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(r[k] for k in order)) for r in rows)


def compare(df, con, sql: str) -> str:
    """Empty when row count, names and values agree."""
    ours = df.toArrow()
    names = ours.column_names
    cur = con.execute(sql)
    their_names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(their_names):
        return f"columns {sorted(names)} != {sorted(their_names)}"
    rows = list(zip(*[c.to_pylist() for c in ours.columns])) if ours.num_columns else []
    a, b = canon(rows, names), canon(theirs, their_names)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}\n  {a[:2]}\n  {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)}/{len(a)} rows differ {sorted(names)}\n  {bad[0][0]}\n  {bad[0][1]}"
    return ""


def main() -> None:
    import __spark_entry__ as entry
    from bandwright.session import build_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["-s"]:
        sf, args = args[1], args[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.log.level": "ERROR"})
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    con = duck(sf)
    failed = []
    for n in names:
        t = time.time()
        try:
            df = queries[n](spark, sf)
            if n in sqls:
                msg = compare(df, con, sqls[n])
            else:
                rows = df.toArrow()
                msg = "" if rows.num_rows else "no rows"
                msg = msg or ""
        except Exception as e:  # noqa: BLE001
            msg = "".join(traceback.format_exception_only(e))[:1500]
            if "-v" in sys.argv:
                traceback.print_exc()
        took = time.time() - t
        print(f"{'ok  ' if not msg else 'FAIL'} {n:18s} {took:6.2f}s {'' if n in sqls else '(no SQL)'} {msg}", flush=True)
        if msg:
            failed.append(n)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main()
