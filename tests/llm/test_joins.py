"""Jaccard join, substring dedup and components against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexstrata.llm import jaccard, repeats
from lexstrata.llm.components import components
from lexstrata.llm.words import SPACE, WordReader

from . import brute

DOCS = "doc_id long, text string"


def _words(rng, n, size=3000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def _near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def _family(seed):
    """Copies, near copies in chains, shared passages, short texts."""
    rng = random.Random(seed)
    passage = _words(rng, 60)
    texts = [[], ["a"], ["a"], ["a", "b", "c", "d"], ["a", "b", "c", "d"], ["a", "b", "c", "e"]]
    for size in (6, 12, 30, 80, 200, 330, 800):
        base = _words(rng, size)
        texts += [base, base]
        for edits in (1, 1, 2, 3, size // 40, size // 30, size // 25, size // 20):
            base = _near(rng, base, edits)
            texts.append(base)
        texts.append(base[: size * 3 // 4])
        texts.append(base[: size * 4 // 5])
    for _ in range(60):
        texts.append(_words(rng, rng.randint(1, 40)) + passage + _words(rng, rng.randint(1, 40)))
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,hot", [(1, 16), (2, 2), (3, 1)])
def test_jaccard_join(spark, monkeypatch, seed, hot):
    """A low bound for hot chunks sends most documents through the join of hot ones."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = _family(seed)
    got = {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == brute.jaccard_components(rows)


def test_hot_documents_hand_on_what_decides(spark, monkeypatch):
    """Of documents with many hot chunks a quarter of the shingles travels, and none that stands alone; no link is lost."""
    monkeypatch.setattr(jaccard, "HOT", 1)
    kept, first = [], jaccard.saved
    monkeypatch.setattr(jaccard, "saved", lambda df: kept.append(first(df)) or kept[-1])
    rows = _family(2)
    got = {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute.jaccard_components(rows)
    travelled = [df for df in kept if "s" in df.columns and "comp" in df.columns]
    assert travelled
    for df in travelled:
        told = df.groupBy("id").agg(F.count("*").alias("c"), F.first("n").alias("n"))
        assert told.where("c > n - ceil(3 * n / 4) + 1").isEmpty()


def test_rarest_follows_one_order_and_drops_what_stands_alone():
    shingles = np.arange(1, 101, dtype=np.uint64)
    counts = np.ones(1 << 10, np.int32)
    assert len(jaccard.rarest(shingles, counts)[0]) == 0
    counts[jaccard._bucket(shingles[:90], len(counts))] = 5
    found, place = jaccard.rarest(shingles, counts)
    alone = int((counts[jaccard._bucket(shingles, len(counts))] == 1).sum())
    assert len(found) == 26 - alone and place.tolist() == list(range(alone + 1, 27))


def test_jaccard_join_without_a_first_round(spark, monkeypatch):
    """The sketches alone find every link."""
    monkeypatch.setattr(jaccard, "FEW", 10**6)
    rows = _family(4)
    got = {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute.jaccard_components(rows)


def test_sketches_differ_in_no_more_chunks_than_sets():
    rng = np.random.default_rng(3)
    for n in (10, 100, 260, 900, 3000):
        a = rng.integers(1, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[n // 10:], rng.integers(1, 2**63, n // 20, dtype=np.uint64)])
        x, y = (set(jaccard.sketch(s, jaccard.band_of(n)).tolist()) for s in (a, b))
        gap = len(np.setxor1d(a, b))
        assert len(x - y) <= gap and len(y - x) <= gap
        for band in jaccard.bands(n):
            assert len(jaccard.sketch(a, band)) >= min(n, jaccard.kept_chunks(n, band))


def test_parity_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 5, 15, 16, 63, 64, 250, 300, 5000, 90_000):
        a = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        for gone, new in ((0, 0), (n // 4, 0), (0, n // 3), (n // 10, n // 9), (n - 1, 3 * n)):
            b = np.concatenate([a[gone:], rng.integers(1, 2**63, new, dtype=np.uint64)])
            apart = jaccard.bits_apart(jaccard.parity(a), jaccard.parity(b))
            assert apart <= len(np.setxor1d(a, b)) and (len(a) + len(b) - apart) % 2 == 0
    x, y = (rng.integers(1, 2**63, 200, dtype=np.uint64) for _ in range(2))
    assert jaccard.bits_apart(jaccard.parity(x), jaccard.parity(y)) > 400 - 2 * 172


def test_jaccard_join_in_more_parts(spark, monkeypatch):
    """Parts that follow the data, hot shingles cut into slices."""
    monkeypatch.setattr(jaccard, "PART_SHINGLES", 40)
    rows = _family(5)
    got = {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute.jaccard_components(rows)


def test_jaccard_join_of_odd_input(spark, odd, no_docs):
    got = sorted(tuple(r) for r in jaccard.near_duplicates(odd.where("doc_id is not null")).collect())
    assert [r[0] for r in got] == [1, 2, 3, 4, 5, 5, 6, 7] and all(r[0] == r[2] for r in got)
    assert {r[0]: r[1] for r in got}[4] > 20000 and [r[1] for r in got][:3] == [0, 0, 0]
    assert jaccard.near_duplicates(odd).count() == odd.count()
    assert jaccard.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("task_links", [500_000, 20])
def test_components_of_chains_and_stars(spark, task_links):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long"), task_links).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}


def _repeat_rows(seed):
    rng = random.Random(seed)
    passage = _words(rng, 70)
    rows = []
    for i in range(60):
        kind = rng.randrange(6)
        if kind == 0:
            words = _words(rng, rng.randint(0, 90), 4)
        elif kind == 1:
            words = _words(rng, 20) + passage[rng.randrange(20):rng.randint(34, 70)] + _words(rng, 20)
        elif kind == 2:
            words = ["ha"] * rng.randint(20, 90) + _words(rng, 10)
        elif kind == 3:
            words = ("la li lu " * rng.randint(5, 30)).split()
        elif kind == 4:
            words = passage[:35] + _words(rng, 5) + passage[:35]
        else:
            words = _words(rng, rng.randint(30, 120))
        rows.append((i, "  ".join(words)))
    return rows


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 5), (3, 8)])
def test_repeats(spark, seed, parts):
    rows = _repeat_rows(seed)
    got = sorted(tuple(r) for r in repeats.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(parts)).collect())
    assert [(i, n, kept) for i, n, _, kept in got] == brute.repeats(rows)


def test_repeats_of_one_id_with_several_texts(spark):
    """Rows of one id are judged each by its own text, short and long ones."""
    rng = random.Random(12)
    shared, own = _words(rng, 60), _words(rng, 400)
    rows = [(1, shared), (1, shared[:4]), (2, _words(rng, 3) + shared), (3, own), (3, own[100:160] + _words(rng, 5)), (3, _words(rng, 50)),
            (3, shared[:34]), (4, own[:40])]
    rows = [(i, " ".join(words)) for i, words in rows]
    got = sorted(tuple(r)[:2] + (r[3],) for r in repeats.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted(brute.repeats(rows))


def test_equal_windows_have_equal_anchors():
    """Whatever stands around a window, its anchor is the same."""
    rng = random.Random(9)
    for trial in range(150):
        size = rng.choice([2, 3, 10, 1000])
        window = _words(rng, 35, size)
        found = []
        for _ in range(4):
            before = _words(rng, rng.randint(0, 30), size)
            text = " ".join(before + window + _words(rng, rng.randint(0, 30), size))
            block = next(WordReader(SPACE).blocks(pa.array([text])))
            windows = repeats._Windows(block, repeats._Powers())
            found.append((int(windows.anchor[len(before)]) - len(before), int(windows.keys(np.array([len(before)]))[0])))
        assert len(set(found)) == 1, trial


def test_repeats_of_odd_input(spark, odd, no_docs):
    got = {r[0]: tuple(r) for r in repeats.remove_repeats(odd).collect()}
    assert got[1][1:3] == (0, 0) and got[4][1] == 32000 and got[None][1:3] == (3, 0) and got[5][3] == "one two"
    assert repeats.remove_repeats(odd).count() == odd.count() and repeats.remove_repeats(no_docs).count() == 0
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2
    twice = spark.createDataFrame([(1, long), (1, long), (2, "q " * 40)], DOCS)
    assert sorted((r[0], r[2]) for r in repeats.remove_repeats(twice).collect()) == [(1, 52), (1, 52), (2, 40)]
