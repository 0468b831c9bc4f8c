"""Exact search against brute force, for every way the blocks can meet."""

import numpy as np
import pytest

from lexstrata import fixed
from lexstrata.functions.vectors import cosine_similarity
from lexstrata.operators import neighbours as nn
from lexstrata.session import collect_if_small

LEX = "row_id long, time_period int, vector array<double>, word string"


def brute(queries, rows, top_n, periods=fixed.ANCHOR_PERIODS):
    out = {}
    for qid, q in queries:
        scored = []
        for rid, period, v, _ in rows:
            if v is None or len(v) != len(q) or not np.isfinite(v).all() or not np.linalg.norm(v):
                continue
            d = round(1 - float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)), 9)
            scored.append((d, rid, period))
        scored.sort()
        anchors = [next((s for s in scored if s[2] == p), None) for p in periods]
        anchors = [a for a in anchors if a]
        fill = [s for s in scored if s not in anchors][:max(0, top_n - len(anchors))]
        out[qid] = [s[1] for s in anchors + fill]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["row_id"])
    return out


def test_small_fixture(spark):
    lex = spark.createDataFrame([
        (0, -5000, [0.0, 1.0], "a"), (1, -5000, [1.0, 1.0], "b"), (2, -1100, [-1.0, 0.0], "c"), (3, 100, [1.0, 0.0], "d"),
        (4, 50, [2.0, 0.0], "e"), (5, 0, [0.0, 0.0], "f"), (6, 7, [1.0, 1.0], "g")], LEX)
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, vector array<double>")
    got = nn.nearest_with_coverage(q, lex, 3, keep=("word",)).orderBy("rank").collect()
    assert [r["row_id"] for r in got] == [1, 2, 3] and [r["word"] for r in got] == ["b", "c", "d"]
    assert [r["similarity"] for r in got] == pytest.approx([0.7071068, -1, 1], abs=1e-6)
    assert found(nn.nearest_with_coverage(q, lex, 1)) == {9: [1, 2]}
    assert found(nn.nearest_with_coverage(q, lex, 3, min_similarity=0.0)) == {9: [1, 3]}


@pytest.mark.parametrize("way", ["lexicon broadcast", "queries broadcast", "blocks"])
def test_brute_force(spark, way, monkeypatch):
    rng = np.random.default_rng(7)
    periods = [-5000, -1100, -300, 0, 40, -900]
    rows = []
    for i in range(400):
        v = rng.integers(-2, 3, size=6).astype(float).tolist()    # small integers: many ties and some zeros
        rows.append((i * 3, periods[int(rng.integers(0, 6))] if i % 50 else None, None if i % 97 == 5 else v, f"w{i}"))
    rows.append((9001, 0, [1.0], "short"))
    rows.append((9002, 0, [float("nan")] * 6, "nan"))
    queries = [(f"q{i}", rng.normal(size=6).tolist()) for i in range(60)] + [("tie", [1.0] + [0.0] * 5)]
    lex = spark.createDataFrame(rows, LEX).repartition(5)
    qdf = spark.createDataFrame(queries, "query_id string, vector array<double>").repartition(3)
    budget = {"lexicon broadcast": 1 << 20, "queries broadcast": 61 * 90, "blocks": 10 * 48}[way]
    monkeypatch.setattr(nn, "BLOCK_BYTES", 70 * 48)
    for top_n in (1, 7):
        near = nn.nearest_with_coverage(qdf, lex, top_n, keep=("word",), budget=budget)
        assert found(near) == brute(queries, rows, top_n)
    words = {r[0]: r[3] for r in rows}
    assert all(r["word"] == words[r["row_id"]] for r in near.collect())


@pytest.mark.parametrize("way, budget", [("lexicon broadcast", 1 << 20), ("queries broadcast", 1200), ("blocks", 100)])
@pytest.mark.parametrize("parts", [1, 8])
def test_odd_vectors_stand_beside_good_ones(spark, way, budget, parts, monkeypatch):
    """Wherever short, empty, null and zero vectors stand, the others are answered as if alone."""
    monkeypatch.setattr(nn, "BLOCK_BYTES", 70 * 24)
    rng = np.random.default_rng(1)
    rows = [(i, 0, rng.normal(size=3).tolist(), "w") for i in range(200)]
    odd_rows = [(1000 + i, 0, v, "odd") for i, v in enumerate([[1.0], [], None, [0.0] * 3, [1.0] * 5])]
    good = [(f"q{i}", rng.normal(size=3).tolist()) for i in range(8)]
    odd = [("a", [1.0]), ("b", []), ("c", None), ("d", [0.0] * 3), ("e", [1.0] * 5)]
    want = brute(good, rows, 4)
    for queries in (odd + good, good + odd, odd):
        lex = spark.createDataFrame(odd_rows + rows, LEX).coalesce(1).repartition(parts)
        asked = spark.createDataFrame(queries, "query_id string, vector array<double>").coalesce(1)
        asked = asked if parts == 1 else asked.repartition(parts)
        got = found(nn.nearest_with_coverage(asked, lex, 4, keep=("word",), budget=budget))
        assert got == (want if queries is not odd else {})


def test_no_queries_and_no_lexicon(spark):
    lex = spark.createDataFrame([(0, 0, [1.0], "a")], LEX)
    none = spark.createDataFrame([], "query_id string, vector array<double>")
    one = spark.createDataFrame([("a", [1.0]), ("zero", [0.0]), ("null", None)], "query_id string, vector array<double>")
    assert nn.nearest_with_coverage(none, lex).count() == 0
    assert nn.nearest_with_coverage(one, lex.limit(0)).count() == 0
    assert found(nn.nearest_with_coverage(one, lex)) == {"a": [0]}


def test_similar_words(spark):
    lex = spark.createDataFrame([(0, 0, [1.0, 0.0], "a"), (1, 0, [1.0, 0.0], "b"), (2, 0, [0.9, 0.1], "c"),
                                 (3, 0, [0.0, 1.0], "a")], LEX)
    words = spark.createDataFrame([("a",), ("missing",)], "word string")
    got = [tuple(r)[:3] for r in nn.similar_words(words, lex, 2).orderBy("rank").collect()]
    assert got == [("a", 1, 1), ("a", 2, 2)]


def test_cosine_of_nothing(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [3.0, 4.0]), (None, [1.0])],
                               "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine_similarity("a", "b")).collect()] == [None, pytest.approx(1.0), None]


def test_size_check_counts_every_column(spark):
    df = spark.createDataFrame([(1, [1.0] * 4, "x" * 100)], "row_id long, vector array<double>, word string")
    assert collect_if_small(df, 200, "vector", 32).num_rows == 1
    assert collect_if_small(df, 100, "vector", 32) is None     # the word is over
    assert collect_if_small(df, 30, "vector", 32) is None      # the vector is over


def _adversarial():
    """Vectors for which bounds are tight, equal or useless."""
    rng = np.random.default_rng(12)
    axes = np.eye(8)
    ring = np.stack([np.cos(np.arange(60) / 60 * 2 * np.pi), np.sin(np.arange(60) / 60 * 2 * np.pi)] + [np.zeros(60)] * 6, axis=1)
    return {
        "all alike": np.tile(np.ones(8), (90, 1)),
        "axes and their opposites": np.concatenate([axes, -axes] * 6),
        "a ring of equal steps": ring,
        "one far group": np.concatenate([np.ones((80, 8)) + 1e-9 * rng.normal(size=(80, 8)), -np.ones((3, 8))]),
        "no groups": rng.normal(size=(150, 8)),
        "tight groups": (rng.normal(size=(6, 8))[rng.integers(0, 6, 200)] + 1e-4 * rng.normal(size=(200, 8))) * rng.choice([1e-6, 1.0, 1e6], (200, 1)),
    }


@pytest.mark.parametrize("name", list(_adversarial()))
def test_pivot_groups_lose_nothing(spark, monkeypatch, name):
    monkeypatch.setattr(nn, "BLOCK_BYTES", 40 * 64)
    vectors = _adversarial()[name]
    periods = [-5000, -1100, -300, 0, 40]
    rows = [(i, periods[i % 5] if i % 7 else None, [float(x) for x in v], f"w{i}") for i, v in enumerate(vectors)]
    queries = [(f"q{i}", r[2]) for i, r in enumerate(rows) if i % 3 == 0] + [("far", [-1.0] * 7 + [3.0])]
    lex = spark.createDataFrame(rows, LEX).repartition(4)
    qdf = spark.createDataFrame(queries, "query_id string, vector array<double>").repartition(3)
    assert found(nn.nearest_with_coverage(qdf, lex, 6, budget=0)) == brute(queries, rows, 6)
    assert found(nn.nearest_with_coverage(qdf, lex, 3, (), budget=0)) == brute(queries, rows, 3, ())


def test_groups_that_hold_no_answer_are_skipped(spark):
    rng = np.random.default_rng(13)
    vectors = rng.normal(size=(40, 16))[np.arange(4000) % 40] + 0.05 * rng.normal(size=(4000, 16))
    lex = spark.createDataFrame([(i, None, v.tolist(), "w") for i, v in enumerate(vectors)], LEX).repartition(4)
    queries = lex.where("row_id % 20 = 0").select(lex["row_id"].alias("query_id"), "vector")
    share = nn.skipped_share(queries, lex, 10, ()).first()
    assert share["pairs"] == 4000 * 200 and share["skipped"] > 0.9


def test_copies_follow_blocks_and_not_groups(spark):
    """Where no group can be skipped, a query goes once to each slice and a row once to each block; a block is full or all cores are busy."""
    rng = np.random.default_rng(14)
    lex = spark.createDataFrame([(i, i % 3, rng.normal(size=16).tolist()) for i in range(3000)], "row_id long, time_period int, vector array<double>")
    queries = lex.select(lex["row_id"].alias("query_id"), "vector")
    for block_rows, slices in ((3000, 1), (500, 3)):
        left, right, found = nn._cells(queries, lex, 5, (), 16, block_rows)
        blocks = left.select("_q").distinct().count()
        assert slices <= found <= 2 * slices and left.count() <= 3000 * found and right.count() <= 3000 * blocks
        assert left.groupBy("_q", "_l").count().agg({"count": "max"}).first()[0] <= block_rows
        assert right.groupBy("_q", "_l").count().agg({"count": "max"}).first()[0] <= 2 * block_rows


@pytest.mark.parametrize("budget", [1 << 20, 100])
def test_rows_looked_at_in_small_batches(spark, monkeypatch, budget):
    """What was found in one batch bounds the next one: ties, anchors and kept columns come out as from one look."""
    monkeypatch.setattr(nn, "_BATCH", 7)
    monkeypatch.setattr(nn, "_CELLS", 50)
    rng = np.random.default_rng(15)
    periods = [-5000, -1100, -300, 0, 40]
    rows = [(i * 7 % 311, periods[i % 5], rng.integers(-1, 2, size=4).astype(float).tolist(), f"w{i * 7 % 311}") for i in range(300)]
    queries = [(f"q{i}", rng.integers(-1, 2, size=4).astype(float).tolist()) for i in range(30)]
    queries = [q for q in queries if any(q[1])]
    near = nn.nearest_with_coverage(spark.createDataFrame(queries, "query_id string, vector array<double>"),
                                    spark.createDataFrame(rows, LEX), 6, keep=("word",), budget=budget)
    assert found(near) == brute(queries, rows, 6)
    assert all(r["word"] == f"w{r['row_id']}" for r in near.collect())


def test_a_query_given_twice_is_one_query_to_the_cells(spark):
    """Its rows are ranked together, however many slices there are."""
    rng = np.random.default_rng(16)
    lex = spark.createDataFrame([(i, None, rng.normal(size=4).tolist(), "w") for i in range(50)], LEX)
    q = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0])] * 2, "query_id string, vector array<double>")
    got = nn.nearest_with_coverage(q, lex, 4, (), budget=0)
    assert sorted(r["rank"] for r in got.collect()) == [1, 2, 3, 4]
