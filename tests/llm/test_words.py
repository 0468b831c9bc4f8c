"""Size of the batches that functions of whole texts are given."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexstrata.llm import words


@pytest.fixture
def texts(spark):
    """64 texts of 100,000 bytes, two of them null, in one partition."""
    return spark.range(0, 64, 1, 1).select("id", F.expr("if(id % 40 = 7, null, repeat(char(97 + id % 26), 100000))").alias("text"))


def _sizes(rows: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([len(rows)]), pa.array([rows.nbytes]), pa.array([rows.column(0).to_pylist()])],
                                      names=["n", "size", "ids"])


def test_batches_of_whole_texts_are_small(texts):
    found = words.mapped(texts, _sizes, "n long, size long, ids array<long>").collect()
    assert max(r["size"] for r in found) <= words.BATCH_BYTES + 300_000 <= 2 << 20
    assert [i for r in found for i in r["ids"]] == list(range(64))


def test_gathered_batches_are_put_together(texts, monkeypatch):
    found = words.mapped(texts, _sizes, "n long, size long, ids array<long>", gathered=True).collect()
    assert [r["n"] for r in found] == [64]
    assert found[0]["ids"] == list(range(64))
    monkeypatch.setattr(words, "GATHERED_BYTES", 3 << 20)
    batches = [pa.record_batch({"text": pa.array(["x" * 1_000_000])}) for _ in range(7)]
    assert [len(b) for b in words._gathered(iter(batches))] == [4, 3]


def test_no_rows(texts):
    assert words.mapped(texts.where("id < 0"), _sizes, "n long, size long, ids array<long>", gathered=True).collect() == []
