"""Side-by-side comparison of a registered query with its SQL counterpart."""
from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(v, digits=None):
    if v is None:
        return None
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        v = round(v, digits) if digits is not None else v
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x, digits)) for k, x in v.items())
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if hasattr(v, "asDict"):
        return tuple(norm(x, digits) for x in v)
    if isinstance(v, bool):
        return v
    return v


TIMES = {}


def compare(spark, con, sf_dir, fn, oracle, digits=None):
    """Returns (spark rows, oracle rows, message); an empty message means equal."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(v, digits) for v in r) for r in df.select(*cols).collect())
    TIMES["spark"] = time.time() - t0
    if oracle is None:
        return sum(got.values()), None, ""
    rel = con.execute(oracle)
    names = [c[0] for c in rel.description]
    if sorted(names) != cols:
        return sum(got.values()), None, f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i], digits) for i in order) for r in rel.fetchall())
    n, m = sum(got.values()), sum(want.values())
    if got == want:
        return n, m, ""
    extra, missing = got - want, want - got
    return n, m, f"only spark {sum(extra.values())}: {list(extra)[:2]} | only sql {sum(missing.values())}: {list(missing)[:2]} cols {cols}"


def main(argv):
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tideline.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    if argv and argv[0] == "--from":
        names = list(queries)
        argv = names[names.index(argv[1]):]
    for name in argv or queries:
        for real in ([name] if name in queries else [q for q in queries if q.startswith(name)]):
            t0 = time.time()
            try:
                n, m, msg = compare(spark, con, sf_dir, queries[real], oracles.get(real), None)
                if msg and not msg.startswith("columns"):
                    loose = compare(spark, con, sf_dir, queries[real], oracles.get(real), 6)[2]
                    msg = ("FLOAT-ONLY " if not loose else "") + msg
            except Exception as exc:  # noqa: BLE001
                n, m, msg = None, None, f"{type(exc).__name__}: {str(exc)[:1500]}"
            bad += bool(msg)
            print(f"{'BAD' if msg else 'ok '} {real} rows={n}/{m} {TIMES.get('spark', 0):.1f}s of {time.time() - t0:.1f}s {msg[:1800]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
