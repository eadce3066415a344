"""Run registered queries next to their SQL twins and compare the rows.

    python tests/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_module  # noqa: E402
from trailcast.session import local_session, tune  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 5) + 0.0
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name: str, sf_dir: str) -> str:
    job, sql = entry_module.queries()[name], entry_module.oracle_sql().get(name)
    df = job(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return f"rows only ({len(got)})"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"MISMATCH columns spark-only {set(df.columns) - set(names)} sql-only {set(names) - set(df.columns)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"MISMATCH rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        cols = sorted(names)
        diff = [(c, p, q) for c, p, q in zip(cols, *bad[0]) if p != q]
        return f"MISMATCH {len(bad)} of {len(a)} rows, e.g. {str(diff)[:600]}"
    return f"ok ({len(a)} rows)"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry_module.queries())
    spark, con, bad = tune(local_session()), database(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            result = compare(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on
            result = f"ERROR {type(exc).__name__}: {str(exc)[:1200]}"
        bad += result.startswith(("MISMATCH", "ERROR"))
        print(f"{name:45s} {time.time() - start:6.1f}s {result}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
