"""Run registered queries and their SQL side by side.

``python tests/oracle.py [key part ...]`` compares at sf0.01.
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexstrata.registry import QUERIES  # noqa: E402
from lexstrata.registry.views import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (repr(round(v, 6) + 0.0))
    return v


def compare(spark, con, key: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    q = QUERIES[key]
    df = q.run(spark, sf_dir)
    cols = sorted(df.columns)
    mine = [tuple(_norm(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if q.sql is None:
        return None if mine else "no rows"
    rel = con.execute(q.sql)
    names = [d[0] for d in rel.description]
    rows = rel.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = [tuple(_norm(r[i]) for i in at) for r in rows]
    kinds = {c: {type(v).__name__ for v in (r[i] for r in mine) if v is not None} for i, c in enumerate(cols)}
    other = {c: {type(v).__name__ for v in (r[i] for r in theirs) if v is not None} for i, c in enumerate(cols)}
    if mine and kinds != other:
        return f"types {kinds} vs {other}"
    a, b = sorted(map(repr, mine)), sorted(map(repr, theirs))
    if a != b:
        only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}; only here {str(only[0])[:700]}; only there {str(only[1])[:700]}"
    return None


if __name__ == "__main__":
    from lexstrata.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("8")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    bad = 0
    for key in QUERIES:
        if len(sys.argv) > 1 and not any(a in key for a in sys.argv[1:]):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, key, sf)
        except Exception as e:
            problem = "ERROR " + str(e)[:600] if not os.environ.get("TRACE") else traceback.format_exc()
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {key} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("bad:", bad)
