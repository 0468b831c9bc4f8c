"""Approximate neighbours against the exact search."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from lexstrata.operators import approximate as ap
from lexstrata.operators import neighbours as nn
from lexstrata.plans.prediction import word_neighbours

VECTORS = "row_id long, vector array<double>"


def _frame(spark, vectors, parts=4):
    return spark.createDataFrame([(i, v if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], VECTORS).repartition(parts)


def _queries(df, share=1):
    from pyspark.sql import functions as F
    return df.where(F.col("row_id") % share == 0).withColumnRenamed("row_id", "query_id")


def _exact(queries, df, n=10):
    from pyspark.sql import functions as F
    return nn.nearest_with_coverage(queries, df.withColumn("time_period", F.lit(None).cast("int")), n, ())


def _clusters(seed, n, dim=64, groups=100, spread=0.3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("vectors", [
    _clusters(1, 6000), _clusters(2, 6000, groups=5, spread=0.05), np.random.default_rng(3).normal(size=(3000, 64))],
    ids=["clusters", "tight clusters", "Gaussian"])
def test_recall(spark, vectors):
    df = _frame(spark, vectors)
    queries = _queries(df, 10)
    found = ap.approximate_neighbours(queries, df)
    share = ap.recall(found, _exact(queries, df)).first()
    assert share["pairs"] == 10 * queries.count() and share["recall"] >= 0.9


def test_distances_and_ranks_are_exact(spark):
    vectors = _clusters(4, 700, dim=8, groups=10)
    df = _frame(spark, vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    by = {}
    for r in ap.approximate_neighbours(_queries(df), df, 5, bucket_rows=64).collect():
        assert r["distance"] == pytest.approx(1 - unit[r["query_id"]] @ unit[r["row_id"]], abs=2e-9)
        by.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["row_id"]))
    for rows in by.values():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


@pytest.mark.parametrize("broadcast", [True, False])
def test_hot_buckets_are_cut_and_sliced(spark, monkeypatch, broadcast):
    """A third of the rows in one narrow cone and some hundred copies in another: all answers, no large cell."""
    if not broadcast:
        monkeypatch.setattr(ap, "HOT_BROADCAST", 0)
    monkeypatch.setattr(ap, "SLICE_ROWS", 100)
    rng = np.random.default_rng(5)
    cone = np.ones(16) + 0.05 * rng.normal(size=(1000, 16))
    copies = np.tile(-np.ones(16), (300, 1)) * rng.choice([1.0, 2.0], (300, 1))
    df = _frame(spark, np.concatenate([cone, copies, rng.normal(size=(1700, 16))]))
    queries = _queries(df, 4)
    found = ap.approximate_neighbours(queries, df, bucket_rows=32, tables=24)
    assert ap.recall(found, _exact(queries, df)).first()["recall"] >= 0.9
    copied = found.where("query_id >= 1000 and query_id < 1300")
    assert copied.count() == 750 and copied.agg({"row_id": "max"}).first()[0] < 1300 and copied.agg({"distance": "max"}).first()[0] == 0


def test_odd_vectors(spark):
    good = np.random.default_rng(6).normal(size=(40, 4)).tolist()
    df = _frame(spark, [*good, None, [], [0.0] * 4, [1.0] * 5, [float("nan")] * 4, [1e-3] * 4, [1e3] * 4])
    found = ap.approximate_neighbours(_queries(df), df, 50)
    assert {r[0] for r in found.select("row_id").collect()} == {*range(40), 45, 46}
    assert {r[0] for r in found.select("query_id").collect()} == {*range(40), 45, 46}
    assert found.count() == 42 * 42    # fewer rows than asked for: all are found
    none = spark.createDataFrame([], VECTORS)
    assert ap.approximate_neighbours(_queries(none), none).count() == 0


def test_coverage_in_place_of_the_exact_search(spark):
    """With few rows all are found: the answer is that of the exact search, also as the search of a prediction."""
    rng = np.random.default_rng(8)
    periods = [-5000, -1100, -300, 0, 40]
    lexicon = spark.createDataFrame([(i, f"w{i}", periods[0 if i == 17 else 1 + i % 4], f"/{i}/", rng.normal(size=6).tolist()) for i in range(120)],
                                    "row_id long, word string, time_period int, phonetic_representation string, vector array<double>")
    queries = lexicon.where("row_id % 7 = 0").select(lexicon["row_id"].alias("query_id"), "vector")
    exact = nn.nearest_with_coverage(queries, lexicon, 6, keep=("word",))
    near = ap.approximate_with_coverage(queries, lexicon, 6, keep=("word",))
    assert near.columns == exact.columns and sorted(near.collect()) == sorted(exact.collect())
    words = lexicon.where("row_id < 5").select("word", "vector")
    assert sorted(word_neighbours(words, lexicon, 6, nearest=ap.approximate_with_coverage).collect()) == sorted(word_neighbours(words, lexicon, 6).collect())


def test_vectors_move_as_they_are_stored(spark):
    """Every copy of a row carries single-precision numbers where the table does."""
    df = _frame(spark, _clusters(9, 40, dim=4, groups=3)).withColumn("vector", F.col("vector").cast("array<float>"))
    dealt = ap._dealt(df, "row_id", np.ones((2, 1, 4)), np.ones((2, 24, 4)), 1, 4)
    assert dealt.schema["vector"].dataType == df.schema["vector"].dataType and dealt.count() == 40 * 4


def _hot_rows(spark):
    rng = np.random.default_rng(11)
    cone = np.ones(8) + 0.05 * rng.normal(size=(500, 8))
    copies = np.tile(-np.ones(8), (200, 1)) * rng.choice([1.0, 2.0], (200, 1))
    return _frame(spark, np.concatenate([cone, copies, rng.normal(size=(800, 8))]))


@pytest.mark.parametrize("block_bytes", [1 << 20, 8 * 8 * 100])
def test_blocks_answer_as_buckets_do(spark, monkeypatch, block_bytes):
    """Whole blocks of queries and slices of rows find what a copy for every bucket finds, hot buckets and ties among them."""
    df = _hot_rows(spark)
    queries = _queries(df, 3)
    settings = {"top_n": 7, "bucket_rows": 32, "tables": 5}
    met = []
    for name in ("_met_in_blocks", "_met_in_buckets"):
        monkeypatch.setattr(ap, name, lambda *a, f=getattr(ap, name): met.append(f) or f(*a))
    monkeypatch.setattr(ap, "BLOCK_BYTES", 1)
    monkeypatch.setattr(ap, "SLICE_ROWS", 50)
    by_bucket = ap.approximate_neighbours(queries, df, **settings).collect()
    monkeypatch.setattr(ap, "BLOCK_BYTES", block_bytes)
    by_block = ap.approximate_neighbours(queries, df, **settings).collect()
    assert [f.__name__ for f in met] == ["_met_in_buckets", "_met_in_blocks"]
    assert len(by_block) == 7 * queries.count() and sorted(by_block) == sorted(by_bucket)


def test_vectors_do_not_move_for_every_bucket(spark, monkeypatch):
    """A query goes to each slice of rows once, a row to each block of queries, whatever the buckets."""
    moved = []
    first = ap._met_in_blocks
    monkeypatch.setattr(ap, "_met_in_blocks", lambda *a: moved.append(a[-1]) or first(*a))
    df = _frame(spark, _clusters(10, 3000))
    assert ap.approximate_neighbours(_queries(df), df, bucket_rows=64).count() == 30_000
    ((blocks, slices),) = moved
    assert blocks + slices < 16 * (1 + 3) + 16
    assert ap._grid(720_000, 720_000, 16, 3, 64, 4) == (11, 6)
    assert ap._grid(72_000_000, 72_000_000, 16, 3, 64, 4) is None
