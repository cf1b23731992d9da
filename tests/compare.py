"""Run registered queries next to their reference SQL and compare names, counts and values.

A query that SQL cannot say is held against the digest of its rows on the smallest tables, as they were when its rules were last tested
against a plain version; `python tests/compare.py --write [prefix ...]` keeps new digests.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import json
import math
import os
import sys
import time

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


SMALLEST = "sf0.001"


def kept_at(name: str) -> str:
    """The file that holds a query's digest; those of training-data operators lie beside their tests."""
    here = os.path.dirname(os.path.abspath(__file__))
    training = name == "pipeline" or (name.startswith("op") and name[2:].split("_")[0].isdigit())
    return os.path.join(here, "llm" if training else "", "digests.json")


def digest_of(ours) -> list:
    return [len(ours[1]), hashlib.sha256(repr(ours).encode()).hexdigest()]


def keep_digest(name: str, found: list) -> None:
    path = kept_at(name)
    held = json.load(open(path)) if os.path.exists(path) else {}
    held[name] = found
    with open(path, "w") as f:
        f.write(json.dumps(held, indent=0, sort_keys=True) + "\n")


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def value(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.6f}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(value(x) for x in v) + "]"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in data)


def compare(spark, con, folder, name, fn, sql) -> str:
    df = fn(spark, folder)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        if os.path.basename(folder.rstrip("/")) != SMALLEST:
            return f"rows={len(ours[1])} (no SQL)"
        path, found = kept_at(name), digest_of(ours)
        if "--write" in sys.argv:
            keep_digest(name, found)
        want = json.load(open(path)).get(name) if os.path.exists(path) else None
        if want != found:
            raise AssertionError(f"{name}: neither SQL nor the digest that was kept: {found} != {want}")
        return f"rows={len(ours[1])} (digest)"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    ref = rows(names, cur.fetchall())
    if ours[0] != ref[0]:
        raise AssertionError(f"{name}: columns {ours[0]} != {ref[0]}")
    if len(ours[1]) != len(ref[1]):
        raise AssertionError(f"{name}: {len(ours[1])} rows, reference {len(ref[1])}; {_diff(ours[1], ref[1])}")
    if ours[1] != ref[1]:
        raise AssertionError(f"{name}: values differ; {_diff(ours[1], ref[1])}")
    return f"rows={len(ours[1])}"


def _diff(a, b):
    from collections import Counter

    ca, cb = Counter(a), Counter(b)
    left, right = list((ca - cb))[:3], list((cb - ca))[:3]
    return f"only ours {str(left)[:700]} | only reference {str(right)[:700]}"


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from readlake.session import get_spark

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    wanted = [a for a in sys.argv[1:] if a != "--write"]
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        if "--write" in sys.argv and name in sql:
            continue
        t = time.time()
        try:
            said = compare(spark, con, folder, name, fn, sql.get(name))
            print(f"ok   {name} {said} {time.time() - t:.1f}s", flush=True)
        except Exception as e:
            bad += 1
            print(f"FAIL {name} {str(e)[:1800]}", flush=True)
    print("failed:", bad, "of", len(queries), "| with SQL:", len(sql))


if __name__ == "__main__":
    main()
