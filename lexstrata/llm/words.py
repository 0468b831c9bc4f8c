"""Words of Arrow text columns as arrays: positions and digests, without a Python object per word.

Texts are read as UTF-8 bytes. A byte table says which bytes belong to words;
bytes of letters beyond ASCII always do. Nulls are read as empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 1 << 20
BATCH_BYTES = 1 << 20        # of an Arrow batch on its way to Python: the JVM's heap grows with it
GATHERED_BYTES = 32 << 20    # of batches put together in Python
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

SPACE = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
KEEP_CASE = np.arange(256, dtype=np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scramble 64-bit numbers; different salts give unrelated digests."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(seq: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Digest of the ``k`` numbers starting at every place where ``k`` are left."""
    n = len(seq) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(k if n > 0 else 0):
        out = mix(out ^ seq[i:i + n], salt + i + 1)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each, the end last."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


@dataclass
class Block:
    """Words of texts ``first`` to ``last`` of a batch."""

    first: int
    last: int
    data: np.ndarray       # bytes of the texts, mapped
    offsets: np.ndarray    # of the texts within data
    starts: np.ndarray     # of words within data
    ends: np.ndarray
    bounds: np.ndarray     # words of text i: bounds[i] to bounds[i + 1]
    digests: np.ndarray | None

    @property
    def docs(self) -> np.ndarray:
        """The text, counted from ``first``, of each word."""
        return np.repeat(np.arange(self.last - self.first), np.diff(self.bounds))

    def texts(self) -> Iterator[tuple[int, int, int]]:
        """Row of the batch and its first and last word."""
        for i in range(self.last - self.first):
            yield self.first + i, int(self.bounds[i]), int(self.bounds[i + 1])


class WordReader:
    """Cuts texts into words; make one per task."""

    def __init__(self, inside: np.ndarray, mapped: np.ndarray = KEEP_CASE, digests: int = 1):
        self.inside, self.mapped, self.digests = inside, mapped, digests
        self._powers = self._inverses = np.empty(0, np.uint64)

    def blocks(self, column: pa.Array) -> Iterator[Block]:
        """Blocks of whole texts of about ``BLOCK_BYTES``, a longer text being a block of its own."""
        data, offsets = text_bytes(column)
        first, n = 0, len(offsets) - 1
        while first < n:
            last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1
            last = min(max(last, first + 1), n)
            yield self._block(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], first, last)
            first = last

    def _block(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> Block:
        data = self.mapped[data]
        inside = self.inside[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        filled = np.flatnonzero(np.diff(offsets))
        before[offsets[filled]] = False
        after[offsets[filled + 1] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        bounds = np.searchsorted(starts, offsets)
        digests = self._digests(data, starts, ends) if self.digests else None
        return Block(first, last, data, offsets, starts, ends, bounds, digests)

    def _digests(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) + 1 > len(self._powers):
            size = max(len(data) + 1, BLOCK_BYTES + (BLOCK_BYTES >> 2))
            steps = np.full(size, _BASE, np.uint64)
            steps[0] = 1
            self._powers = np.multiply.accumulate(steps)
            steps[1:] = _INVERSE
            self._inverses = np.multiply.accumulate(steps)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[0][data] * self._powers[:len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self._inverses[starts] + (ends - starts).astype(np.uint64))


def word_digest(word: bytes) -> int:
    """The digest that a reader gives to this one word."""
    return int(WordReader(np.ones(256, bool)).blocks(pa.array([word.decode()])).__next__().digests[0])


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch],
           schema: str, state: Callable[[], object] | None = None, gathered: bool = False) -> DataFrame:
    """``mapInArrow`` of a function of one batch to one or several; ``state`` is made once per task and given first.

    ``gathered`` batches are put together to ``GATHERED_BYTES``, for functions that sum up what a batch holds.
    """
    bounded_batches(df.sparkSession)

    def run(batches):
        held = (state(),) if state else ()
        for batch in _gathered(batches) if gathered else batches:
            out = fn(*held, batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
        pa.default_memory_pool().release_unused()    # the worker lives on

    return df.mapInArrow(run, schema)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHERED_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to about 1 MB, so that texts do not pile up in a task.

    Only Spark's own default, 64 MB or none by its version, is replaced.
    """
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
