"""The queries against SQL on the smallest tables, and the pipeline against plain versions of its stages."""

import os

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from lexstrata.llm import language, personal
from lexstrata.llm.queries import QUERIES, SQL
from tests.oracle import connect

from . import brute
from .oracle import compare

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@needs_tables
@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, key):
    assert compare(spark, connect(SF_DIR), key, SF_DIR) is None


def test_each_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@needs_tables
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    field = language.learn(docs)
    known = [r["doc_id"] for r in language.identify(docs, field).collect() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE]
    groups = brute.jaccard_components([(i, rows[i]["text"]) for i in known])
    first = [i for i in known if groups[i][1] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    hit = brute.contamination([(i, rows[i]["text"]) for i in first], items)
    clean = sorted(i for i in first if not hit[i][1])
    kept = docs.where(docs["doc_id"].isin(clean))
    net = personal.learn(kept)
    spans = personal.find_spans(net, [rows[i]["text"] for i in clean])
    theirs = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: theirs.encode(personal.masked(rows[i]["text"], s), add_bos=True, add_eos=True) for i, s in zip(clean, spans)}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert sorted(got) == clean
    assert sum(got[i] != want[i] for i in clean) == 0


@needs_tables
def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), SF_DIR)
        assert empty.dtypes == docs.dtypes and empty.count() == 0, name


@needs_tables
def test_stages_on_odd_rows(spark, odd):
    got = {name: stage(spark, odd, SF_DIR) for name, stage in corpus_pipeline.STAGES}
    ids = {name: sorted((r["doc_id"] for r in df.collect()), key=str) for name, df in got.items()}
    everything = sorted((r["doc_id"] for r in odd.collect()), key=str)
    assert ids["n-gram Jaccard join"] == sorted([1, 2, 3, 4, 5, 6, 7, None], key=str)    # the repeated row once, the null id too
    for name in ("benchmark decontamination", "personal data", "SentencePiece encoding and decoding"):
        assert ids[name] == everything, name
    assert not {1, 2, 3} & set(ids["language ID"]) and None in ids["language ID"]
    assert all(got[name].columns == odd.columns for name, _ in corpus_pipeline.STAGES[:-1])


@needs_tables
def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long, "en", "a"), (None, long, "en", "b"), (3, long, "en", "a"), (3, long, "en", "b"), (8, long + " more", "en", "a"), (9, None, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF_DIR).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "9", "None", "None"]
