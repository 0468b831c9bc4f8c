"""User hooks: text to vector, and batch body to reply."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup

EmbedFn = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def embed(df: DataFrame, column: str, fn: EmbedFn, spread: str, out: str = "vector") -> DataFrame:
    """Add a vector per text from an iterator function over batches of texts.

    The model runs once per distinct text. A text it fails on gets null and the
    reason as ``<out>_error``: a batch that raises is tried again text by text.
    Texts are counted and joined by digest and length; the text itself moves once,
    to the model.
    """
    text = F.col(column)
    keyed = df.withColumn("_digest", F.when(text.isNotNull(), F.concat(F.sha2(text, 256), F.length(text).cast("string"))))
    model = F.pandas_udf(_isolated(fn), "vector array<float>, error string")
    distinct = keyed.where(text.isNotNull()).select("_digest", text.alias("_text")).dropDuplicates(["_digest"])
    vectors = distinct.select("_digest", model("_text").alias("_v")) \
        .select("_digest", F.col("_v.vector").alias(out), F.col("_v.error").alias(f"{out}_error"))
    return lookup(keyed, vectors, "_digest", spread).drop("_digest")


def _isolated(fn: EmbedFn):
    """The hook with failures turned into rows. The function is started once and started again only after a failure."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        waiting: deque = deque()

        def feed():
            while True:
                yield waiting.popleft()

        def told(texts: pd.Series, running) -> tuple[list, object]:
            waiting.append(texts)
            found = list(next(running))
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return found, running

        def one(text: str) -> tuple[object, str | None]:
            try:
                found = list(next(iter(fn(iter([pd.Series([text])])))))
                return found[0], None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        running = None
        for texts in batches:
            try:
                vectors, running = told(texts, running or iter(fn(feed())))
                errors = [None] * len(texts)
            except Exception:
                running = None
                waiting.clear()
                vectors, errors = zip(*[one(t) for t in texts])
            yield pd.DataFrame({"vector": pd.Series(list(vectors), dtype=object),
                                "error": pd.Series(list(errors), dtype=object)})

    return run


def ngram_vectors(dim: int = 64, n: int = 3) -> EmbedFn:
    """A stand-in model: hashed character n-grams, the same on every run."""
    def one(text: str) -> np.ndarray:
        out = np.zeros(dim, dtype=np.float32)
        padded = f"^{text}$"
        for i in range(max(1, len(padded) - n + 1)):
            h = crc32(padded[i:i + n].encode())
            out[h % dim] += 1.0 if (h >> 16) & 1 else -1.0
        return out

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype=object)

    return run


def ask(batches: DataFrame, reply_fn: Callable[[str], str | None]) -> DataFrame:
    """Send each batch body to a reply function: (batch, body) -> (batch, reply, error).

    A failing call gives a null reply with the reason, and the run goes on.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies, errors = [], []
            for body in frame["body"]:
                try:
                    replies.append(reply_fn(body))
                    errors.append("no reply" if replies[-1] is None else None)
                except Exception as e:
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"batch": frame["batch"], "reply": pd.Series(replies, dtype=object),
                                "error": pd.Series(errors, dtype=object)})

    return batches.select("batch", "body").mapInPandas(run, "batch bigint, reply string, error string")
