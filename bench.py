"""Time the headline queries; prints one JSON line.

A table that is one small file is one task, whatever the machine. Before anything
is timed, the text tables are written as ``BENCH_FILES`` files each, which is how a
cluster holds them; the queries and their plans are the registered ones.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from lexstrata.registry import QUERIES
from lexstrata.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))
FILES = int(os.environ.get("BENCH_FILES", "16"))
TEXT_TABLES = ("documents", "pages", "conversations")
HEADLINE = (
    "win1_nearest_coverage", "win2_similar_words", "job1_consolidate", "job3_latin_clean", "job6_predict_requests",
    "job7_timeline", "jon6_nearest_in_window", "vec7_form_at", "str1_clean_markup", "str8_latin_full",
    "str21_html_section", "str22_mine_raw_content", "agg1_column_coverage", "agg5_mean_pooling", "win5_batches",
    "set4_sorted_distinct",
)


def run(spark, key: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def several_files(spark, sf_dir: str) -> str:
    """A folder with the same tables, the text tables in several files."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in os.listdir(sf_dir):
        if name.removesuffix(".parquet") in TEXT_TABLES:
            spark.read.parquet(f"{sf_dir}/{name}").repartition(FILES).write.parquet(f"{folder}/{name}")
        else:
            os.symlink(os.path.abspath(f"{sf_dir}/{name}"), f"{folder}/{name}")
    return folder


def main() -> None:
    wanted = os.environ.get("BENCH_QUERIES")
    keys = wanted.split(",") if wanted else HEADLINE
    spark = local_session(CPUS, memory=os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = several_files(spark, SF_DIR)
    run(spark, "win1_nearest_coverage", sf_dir)    # starts the workers
    times = {}
    for key in keys:
        run(spark, key, sf_dir)    # warm-up
        times[key] = round(statistics.median(run(spark, key, sf_dir) for _ in range(REPEATS)), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
