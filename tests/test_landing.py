"""Batches that count once, whatever breaks off and however often they come."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lexstrata.sources import landing, tables
from lexstrata.streaming import incremental as inc


def _sinks(tmp_path):
    return {"rows": str(tmp_path / "rows"), "failed": str(tmp_path / "failed")}


def _failed(every):
    return F.when(F.col("id") % every == 0, "failed").otherwise("rows")


def _read(spark, sinks):
    """By the commits, and as plain folders."""
    schema = spark.range(1).schema
    out = []
    for path in sinks.values():
        whole = sorted(tuple(r) for r in landing.read_landed(spark, path, schema, sinks["rows"]).collect())
        out.append(whole)
        shown = sorted((r["id"], r["batch_id"]) for r in spark.read.parquet(path).collect()) if tables.table_exists(spark, path) else []
        assert shown == whole
    return out


def test_an_emptied_batch_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    inc.append_batch(spark.range(5), path, 3)
    inc.append_batch(spark.range(2), path, 4)
    inc.append_batch(spark.range(0), path, 3)
    assert sorted(tuple(r) for r in landing.read_landed(spark, path, spark.range(1).schema).collect()) == [(0, 4), (1, 4)]
    assert spark.read.parquet(path).count() == 2
    land = str(tmp_path / "l")
    for rows in (5, 0):
        tables.land_batch(spark.range(rows), land, 1, "Old English: a/b")
    tables.land_batch(spark.range(3), land, 2, "Old English: a/b")
    assert [tuple(r) for r in spark.read.parquet(land).groupBy("language", "batch_id").count().collect()] == [("Old English: a/b", 2, 3)]


def test_a_retry_that_ends_otherwise(spark, tmp_path):
    sinks = _sinks(tmp_path)
    landing.land_batch_once(spark.range(10), sinks["rows"], 1, sinks, _failed(2))
    landing.land_batch_once(spark.range(10, 13), sinks["rows"], 2, sinks, F.lit("rows"))
    landing.land_batch_once(spark.range(10), sinks["rows"], 1, sinks, _failed(5))
    rows, failed = _read(spark, sinks)
    assert [r[0] for r in failed] == [0, 5] and [r[0] for r in rows] == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12]
    landing.land_batch_once(spark.range(10), sinks["rows"], 1, sinks, F.lit("failed"))
    rows, failed = _read(spark, sinks)
    assert len(rows) == 3 and len(failed) == 10


@pytest.mark.parametrize("broken", ["write", "move"])
@pytest.mark.parametrize("times", [1, 2, 3])
def test_a_run_broken_between_the_sinks_leaves_all_or_nothing(spark, tmp_path, monkeypatch, broken, times):
    sinks = _sinks(tmp_path)
    landing.land_batch_once(spark.range(10), sinks["rows"], 1, sinks, _failed(2))
    whole, seen = getattr(landing.Store, broken), [0]

    def breaks(self, *args):
        seen[0] += 1
        if seen[0] == times:
            raise OSError("broken off")
        return whole(self, *args)

    monkeypatch.setattr(landing.Store, broken, breaks)
    stopped = False
    try:
        landing.land_batch_once(spark.range(20, 30), sinks["rows"], 1, sinks, _failed(5))
    except OSError:
        stopped = True
    monkeypatch.undo()
    schema = spark.range(1).schema
    by_commit = [sorted(r["id"] for r in landing.read_landed(spark, p, schema, sinks["rows"]).collect()) for p in sinks.values()]
    old, new = [[1, 3, 5, 7, 9], [0, 2, 4, 6, 8]], [[21, 22, 23, 24, 26, 27, 28, 29], [20, 25]]
    assert by_commit in (old, new) and (stopped or by_commit == new)
    landing.settle(spark, sinks["rows"])
    assert [[r[0] for r in part] for part in _read(spark, sinks)] == by_commit
    assert os.listdir(f"{sinks['rows']}/_attempts") == []
    landing.land_batch_once(spark.range(20, 30), sinks["rows"], 1, sinks, _failed(5))
    assert [[r[0] for r in part] for part in _read(spark, sinks)] == new


def test_rows_for_an_unknown_sink_are_refused(spark, tmp_path):
    sinks = _sinks(tmp_path)
    with pytest.raises(ValueError):
        landing.land_batch_once(spark.range(3), sinks["rows"], 1, sinks, F.lit("elsewhere"))
    assert landing.read_landed(spark, sinks["rows"], spark.range(1).schema).count() == 0


def test_each_row_is_computed_once(spark, tmp_path):
    """Rows that change at every look are still in one sink only."""
    sinks = _sinks(tmp_path)
    df = spark.range(2000).withColumn("x", F.rand())
    landing.land_batch_once(df, sinks["rows"], 1, sinks, F.when(F.col("x") < 0.5, "failed").otherwise("rows"))
    parts = [spark.read.parquet(p) for p in sinks.values()]
    assert parts[0].unionByName(parts[1]).select("id").distinct().count() == 2000
    assert parts[0].where("x < 0.5").count() == 0 and parts[1].where("x >= 0.5").count() == 0


@pytest.mark.parametrize("breaks_in", [0, 1, 4])
def test_a_run_broken_inside_a_batch(spark, tmp_path, breaks_in):
    p = lambda n: str(tmp_path / n)
    spark.range(60).repartition(6).write.parquet(p("in"))
    schema = spark.range(1).schema
    seen = []

    def step(batch):
        seen.append(0)
        bad = F.lit(len(seen) == breaks_in + 1)
        return inc.with_status(batch.where(~bad | F.raise_error(F.lit("broken off")).isNull()), F.col("id") % 3 != 0, F.lit("third"))

    def run():
        inc.run_increments(spark, p("in"), schema, step, p("out"), p("cp"), p("bad"), files_per_batch=1)

    before = spark.conf.get("spark.sql.streaming.minBatchesToRetain", None)
    with pytest.raises(StreamingQueryException):
        run()
    assert len(seen) == breaks_in + 1
    run()
    assert len(seen) == 7    # the broken batch once more, no other
    assert spark.conf.get("spark.sql.streaming.minBatchesToRetain", None) == before
    done, bad = (spark.read.parquet(p(n)) for n in ("out", "bad"))
    assert sorted(r["id"] for r in done.unionByName(bad).collect()) == list(range(60))
    assert done.where("id % 3 = 0").count() == 0 and bad.count() == 20
    for kept in ("commits", "offsets"):
        assert len([n for n in os.listdir(f"{p('cp')}/{kept}") if n.isdigit()]) <= inc.KEPT_POINTS
