"""Run registered queries next to their SQL in DuckDB and compare rows as multisets."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TIMES: dict[str, float] = {}
SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(plain(row[k]) for k in order) for row in rows)


def difference(spark, name, item, con, sf_dir: str = SF_DIR):
    """None when equal, else a short report."""
    df = item.run(spark, sf_dir)
    start = time.time()
    ours = df.collect()
    TIMES[name] = time.time() - start
    got = con.execute(item.sql)
    theirs_names = [c[0] for c in got.description]
    theirs = got.fetchall()
    if sorted(df.columns) != sorted(theirs_names):
        return f"{name}: columns {sorted(df.columns)} != {sorted(theirs_names)}"
    a, b = bag([tuple(r) for r in ours], df.columns), bag(theirs, theirs_names)
    if a == b:
        if not ours:
            return f"{name}: both sides are empty"
        return None
    return (
        f"{name}: {len(ours)} vs {len(theirs)} rows\n  columns {sorted(df.columns)}\n"
        f"  only spark: {list((a - b).items())[:4]}\n  only sql:   {list((b - a).items())[:4]}"
    )


def main(names):
    from encoscope.plans import load_all
    from encoscope.session import local_session

    spark = local_session(8, "oracle")
    con = connect()
    bad = 0
    for name, item in load_all().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            if item.sql is None:
                rows = item.run(spark, SF_DIR).collect()
                report = None if rows else f"{name}: no rows"
                if names:
                    print("\n".join(str(r) for r in rows[:8]))
            else:
                report = difference(spark, name, item, con)
        except Exception as err:  # noqa: BLE001
            report = f"{name}: {type(err).__name__} {str(err)[:1500]}"
        bad += report is not None
        print(f"{'BAD' if report else 'ok '} {name} {time.time() - start:.2f}s (collect {TIMES.get(name, 0):.2f}s) {'' if item.sql else '(rows only)'} {report or ''}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
