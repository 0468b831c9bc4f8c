"""License scan, decontamination and token totals against plain versions and odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexstrata.llm import contamination, licenses, rollups
from lexstrata.llm.words import ALNUM, LOWER, SPACE, WordReader

from . import brute


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_word_reader_cuts_as_the_patterns_do():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aZ9 \t\n\x0b\x1f.,-é日😀\x7f\x00") for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, ""]
    for table, pattern, text_of in ((SPACE, brute.SPACES, lambda t: t or ""), (ALNUM, brute.ALNUM, brute.lower)):
        reader = WordReader(table, LOWER if table is ALNUM else np.arange(256, dtype=np.uint8))
        got = {}
        for b in reader.blocks(pa.array(texts, pa.string())):
            for row, x, y in b.texts():
                got[row] = [bytes(b.data[b.starts[i]:b.ends[i]]).decode() for i in range(x, y)]
        assert [got[i] for i in range(len(texts))] == [pattern.findall(text_of(t)) for t in texts]


def test_licenses(spark):
    long = licenses.TEMPLATES[1][1]
    words = long.split()
    rows = [(1, "x " * 500 + "Apache  LICENSE. apache license"), (2, "pad " * 90 + " ".join(words[:-3]) + " pad" * 90),
            (3, " ".join(words[:len(words) // 2])), (4, "CC BY-NC 4.0 licensed, under"), (5, "released under a licence of some kind")]
    got = {r["doc_id"]: r for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 500, 502, "apache")
    assert got[2]["labels"] == "apache,apache-2.0" and got[2]["score"] == 1.0
    assert "apache-2.0" not in got[3]["labels"].split(",") or got[3]["n_base"]
    assert got[4]["labels"] == "cc-by,cc-by-nc-4.0" and got[5]["labels"] == "" and got[5]["score"] == 0.0


def test_license_filters_lose_nothing():
    """The prefix, length and position filters give what counting gives."""
    rng = np.random.default_rng(2)
    for _ in range(3000):
        tokens = np.unique(rng.integers(0, 40, rng.integers(1, 12)))
        need = max(1, int(np.ceil(0.8 * len(tokens))))
        block = np.unique(rng.integers(0, 40, rng.integers(1, 30)))
        n = len(np.intersect1d(tokens, block))
        assert licenses._Template("x", tokens, need).shared(block, len(block) + int(rng.integers(0, 3))) == (n if n >= need else 0)


@pytest.mark.parametrize("window", [10, 3])
def test_contamination(spark, window):
    rng = random.Random(window)
    words = ["a", "b", "c", "The", "é"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))) for i in range(12)] + [(98, None), (99, "...")]
    rows = [(i, ", ".join(rng.choice(words) for _ in range(rng.randint(0, 400)))) for i in range(40)] + [(77, items[0][1])]
    got = contamination.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"),
                                           spark.createDataFrame(items, "item_id long, text string"), window=window)
    got = {r[0]: (r[1], sum(h["end"] - h["start"] for h in r[2]), r[3]) for r in got.collect()}
    assert got == brute.contamination(rows, items, window)


def test_contamination_in_parts(spark, monkeypatch):
    rows = [(1, "one two three four"), (2, "five six seven"), (3, "none of these")]
    items = [(1, "two three"), (2, "six seven"), (3, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(contamination, "PART_BYTES", 80)
    got = {r[0]: (r[1], sum(h["end"] - h["start"] for h in r[2]), r[3]) for r in contamination.find_contamination(docs, bench).collect()}
    assert got == brute.contamination(rows, items)
    assert [r["doc_id"] for r in contamination.keep_clean(docs, bench).collect()] == [3]


def test_scans_of_odd_input(spark, odd, no_docs):
    items = spark.createDataFrame([(1, "one two"), (None, "no id here")], "item_id long, text string")
    got = {r["doc_id"]: r for r in contamination.contamination_report(odd, items).collect()}
    assert got[1]["n_words"] == 0 and got[5]["contaminated"] and not got[4]["contaminated"] and got[None]["n_hit"] == 3
    assert contamination.contamination_report(odd, items).count() == odd.count()
    assert not contamination.contamination_report(odd, items.limit(0)).where("contaminated").count()
    assert contamination.contamination_report(no_docs, items).count() == 0
    assert licenses.license_report(odd).count() == odd.count() and licenses.license_report(no_docs).count() == 0
    assert {r["n_words"] for r in licenses.license_report(odd.where("doc_id = 4")).collect()} == {32000}


def test_rollup_counts_each_batch_once(spark, tmp_path, odd, no_docs):
    store = rollups.TokenRollup(spark, str(tmp_path / "totals"))
    counts = rollups.count_tokens(odd)
    assert store.totals().count() == 0
    assert store.apply(1, rollups.inserts(counts)) and not store.apply(1, rollups.inserts(counts))
    first = _rows(store.totals())
    assert sum(r[3] for r in first if r[2] == "space-1") == odd.count()
    part = rollups.count_tokens(odd.where("doc_id in (4, 5)"))
    store.apply(2, rollups.deletes(part))
    (tmp_path / "totals" / "batch=3").mkdir()    # broke off before its end
    store.apply(3, rollups.revisions(counts.where("tokens > 99999"), part))
    assert store.committed() == [1, 2, 3] and _rows(store.totals()) == first
    store.apply(4, rollups.deletes(counts))
    store.apply(5, rollups.inserts(rollups.count_tokens(no_docs)))
    assert store.totals().count() == 0


def test_rollup_takes_any_tokenizer(spark, tmp_path):
    import tiktoken
    from pyspark.sql.functions import pandas_udf

    import public_tokenizers as P
    import base64
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = P.PATTERN

    @pandas_udf("long")
    def bpe(texts):
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return texts.map(lambda t: len(enc.encode_ordinary(t or "")))

    docs = spark.createDataFrame([("hello world", "s", "en"), (None, "s", "en")], "text string, source string, lang string")
    store = rollups.TokenRollup(spark, str(tmp_path / "t"))
    store.apply(1, rollups.inserts(rollups.count_tokens(docs, F.col("text"), {"bpe": bpe})))
    assert _rows(store.totals()) == [("s", "en", "bpe", 2, 2)]
