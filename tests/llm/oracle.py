"""The queries of ``llm`` and their SQL side by side: ``python -m tests.llm.oracle [key part ...]``."""

from __future__ import annotations

import os
import sys
import time

from lexstrata.llm.queries import QUERIES, SQL
from lexstrata.registry.views import Query
from tests import oracle


def compare(spark, con, key: str, sf_dir: str) -> str | None:
    oracle.QUERIES[key] = Query(QUERIES[key], SQL.get(key))
    try:
        return oracle.compare(spark, con, key, sf_dir)
    finally:
        del oracle.QUERIES[key]


if __name__ == "__main__":
    from lexstrata.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("8")
    spark.sparkContext.setLogLevel("OFF")
    con = oracle.connect(sf)
    for key in QUERIES:
        if len(sys.argv) > 1 and not any(a in key for a in sys.argv[1:]):
            continue
        start = time.time()
        problem = compare(spark, con, key, sf)
        print(f"{'ok ' if problem is None else 'BAD'} {key} {time.time() - start:.1f}s {problem or ''}", flush=True)
