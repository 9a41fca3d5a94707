"""Run queries in Spark and their SQL form in DuckDB and compare rows, columns and values.

usage: python tools/compare.py [--sf 0.01] [name-part ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cellweave.catalog import ORACLES, QUERIES  # noqa: E402
from cellweave.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, tuple) else (False, "t", str(x)) for x in r))


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = build_session("compare", 8)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name, function in QUERIES.items():
        if args.names and not any(n in name for n in args.names):
            continue
        try:
            begin = time.time()
            df = function(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - begin
            mine = table(rows, df.columns)
            if name not in ORACLES:
                print(f"rows-only {name}: {len(rows)} rows {took:.1f}s {rows[:1]}", flush=True)
                continue
            begin = time.time()
            relation = db.sql(ORACLES[name])
            other = table(relation.fetchall(), relation.columns)
            duck = time.time() - begin
            same_types = {c: (t, str(d)) for (c, t), d in zip(sorted(df.dtypes), [x for _, x in sorted(zip(relation.columns, relation.types))])}
            names_of = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
            odd = {c: p for c, p in same_types.items() if names_of.get(p[0]) != p[1]}
            if mine == other:
                print(f"ok {name}: {len(rows)} rows, spark {took:.1f}s duckdb {duck:.1f}s {'TYPES ' + str(odd) if odd else ''}", flush=True)
            else:
                bad += 1
                print(f"DIFF {name}: {len(rows)} vs {len(other[1])} rows; {mine[0]} vs {other[0]} {odd}", flush=True)
                shown = 0
                for a, b in zip(mine[1], other[1]):
                    if a != b and shown < 3:
                        print("   spark ", a, "\n   duckdb", b)
                        shown += 1
        except Exception as error:  # keep going, this is a report
            bad += 1
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:1500]}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
