"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of ``window`` consecutive words of the benchmark items; an
item of fewer words is one pattern. Patterns of one length are searched together:
a shift table over blocks of two words says how far a window may move without
passing an occurrence, windows whose last block ends some pattern look up the bucket
of that block, and the words themselves are compared before an occurrence counts.
Many stretches of text move at once, as arrays.

Texts are read in place and nothing is shuffled. The benchmark is measured first and
handed to the tasks in parts of up to ``PART_BYTES`` of text; beyond one part the
texts are passed once per part, with a checkpoint between.

Defined results: null and empty texts and items have no words, hit nothing and are
hit by nothing; items of equal text are all named; repeated rows are answered each;
an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import saved
from .words import ALNUM, LOWER, WordReader, mapped, mix

WINDOW = 10
PART_BYTES = 32 << 20
_STRETCH = 128    # window starts that one lane of the search walks over
_TABLE_BITS = 16


class WuManber:
    """Patterns of ``length`` words, given by the places of their first words in ``sequence``."""

    def __init__(self, sequence: np.ndarray, starts: np.ndarray, length: int):
        self.sequence, self.length, self.block = sequence, length, min(2, length)
        far = length - self.block + 1
        self.shift = np.full(1 << _TABLE_BITS, far, np.uint8 if far < 256 else np.int32)
        for end in range(self.block, length + 1):
            slots = self._blocks(sequence, starts + end - 1) >> np.uint64(64 - _TABLE_BITS)
            np.minimum.at(self.shift, slots, length - end)
        last = self._blocks(sequence, starts + length - 1)
        order = np.argsort(last, kind="stable")
        self.last, self.starts = last[order], starts[order]

    def _blocks(self, seq: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Digest of the block of words that ends at each place."""
        return mix(seq[ends]) if self.block == 1 else mix(seq[ends] ^ mix(seq[ends - 1]))

    def search(self, seq: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``seq`` and pattern starts of all occurrences inside texts ``bounds[i]`` to ``bounds[i + 1]``."""
        counts = np.maximum(np.diff(bounds) - self.length + 1, 0)
        lanes = -(-counts // _STRETCH)
        first = np.repeat(bounds[:-1], lanes)
        step = np.arange(len(first)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first + step * _STRETCH
        end = np.minimum(at + _STRETCH, first + np.repeat(counts, lanes))
        found_at, found = [], []
        while len(at):
            blocks = self._blocks(seq, at + self.length - 1)
            shift = self.shift[blocks >> np.uint64(64 - _TABLE_BITS)].astype(np.int64)
            stop = np.flatnonzero(shift == 0)
            if len(stop):
                places, patterns = self._compare(seq, at[stop], blocks[stop])
                found_at.append(places)
                found.append(patterns)
            at = at + np.maximum(shift, 1)
            live = at < end
            at, end = at[live], end[live]
        none = np.empty(0, np.int64)
        return (np.concatenate(found_at), np.concatenate(found)) if found else (none, none)

    def _compare(self, seq: np.ndarray, at: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each block, compared word by word."""
        lo, hi = np.searchsorted(self.last, blocks), np.searchsorted(self.last, blocks, "right")
        sizes = hi - lo
        place = np.repeat(at, sizes)
        pattern = self.starts[np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)]
        for k in range(self.length):
            same = seq[place + k] == self.sequence[pattern + k]
            place, pattern = place[same], pattern[same]
        return place, pattern


class _Items:
    """Benchmark items of one part, as words; occurrences give the items that hold them."""

    def __init__(self, ids: list, texts: list, window: int):
        blocks = list(WordReader(ALNUM, LOWER).blocks(pa.array(texts, pa.string())))
        self.ids = ids
        self.words = [bytes(b.data[s:e]) for b in blocks for s, e in zip(b.starts, b.ends)]
        sequence = np.concatenate([b.digests for b in blocks]) if blocks else np.empty(0, np.uint64)
        sizes = np.concatenate([np.diff(b.bounds) for b in blocks]) if blocks else np.empty(0, np.int64)
        firsts = np.cumsum(sizes) - sizes
        self.item_of = np.repeat(np.arange(len(sizes)), sizes)
        self.searches = []
        for length in np.unique(np.minimum(sizes[sizes > 0], window)):
            own = np.flatnonzero(sizes == length) if length < window else np.flatnonzero(sizes >= window)
            starts = np.concatenate([np.arange(firsts[i], firsts[i] + sizes[i] - length + 1) for i in own])
            self.searches.append(WuManber(sequence, starts, int(length)))

    def occurrences(self, block) -> Iterator[tuple[int, int, int]]:
        """First word, number of words and item of each occurrence in a block of texts."""
        for search in self.searches:
            places, patterns = search.search(block.digests, block.bounds)
            if not len(places):
                continue
            words = [bytes(block.data[block.starts[p]:block.ends[p]]) for p in places]
            for p, q, word in zip(places.tolist(), patterns.tolist(), words):
                rest = range(1, search.length)
                if word == self.words[q] and all(
                        bytes(block.data[block.starts[p + k]:block.ends[p + k]]) == self.words[q + k] for k in rest):
                    yield p, search.length, int(self.item_of[q])


def _merged(ranges: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def _parts(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, in parts that fit ``PART_BYTES``; the sizes are measured before anything is fetched."""
    items = benchmark.select(F.col(item).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-size // PART_BYTES)
    for part in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == part).toArrow()
        yield rows["i"].to_pylist(), rows["t"].to_pylist()


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                       item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: ``key, n_words, hits`` (merged word ranges, end exclusive) and ``items`` (ids, sorted as strings)."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = f"_key {kind}, _text string, n_words bigint, hits array<struct<start: bigint, end: bigint>>, items array<string>"
    out = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.lit(0).cast("long").alias("n_words"),
                      F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("hits"),
                      F.expr("cast(array() as array<string>)").alias("items"))

    def searched(df: DataFrame, ids: list, texts: list, last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, texts))

        def find(state, rows: pa.RecordBatch) -> pa.RecordBatch:
            reader, items = state
            n = len(rows)
            n_words = np.zeros(n, np.int64)
            ranges = [[(r["start"], r["end"]) for r in old] for old in rows.column(3).to_pylist()]
            named = [set(old) for old in rows.column(4).to_pylist()]
            for block in reader.blocks(rows.column(1)):
                n_words[block.first:block.last] = np.diff(block.bounds)
                for place, length, i in items.occurrences(block):
                    d = int(np.searchsorted(block.bounds, place, "right")) - 1
                    start = place - int(block.bounds[d])
                    ranges[block.first + d].append((start, start + length))
                    named[block.first + d].add(str(items.ids[i]))
            texts_on = pa.nulls(n, pa.string()) if last else rows.column(1)
            return pa.RecordBatch.from_arrays(
                [rows.column(0), texts_on, pa.array(n_words), pa.array([_merged(r) for r in ranges], rows_type),
                 pa.array([sorted(x) for x in named], pa.list_(pa.string()))],
                names=["_key", "_text", "n_words", "hits", "items"])

        return mapped(df, find, schema, lambda: (WordReader(ALNUM, LOWER), _Items(*shared.value, window)))

    waiting = ([], [])
    for part in _parts(benchmark, item, item_text):
        if waiting[0]:
            out = saved(searched(out, *waiting, last=False))
        waiting = part
    out = searched(out, *waiting, last=True)
    return out.select(F.col("_key").alias(key), "n_words", "hits", "items")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
               window: int = WINDOW) -> DataFrame:
    """The rows that no pattern of the benchmark occurs in, all columns as they are."""
    spark, at = docs.sparkSession, docs.columns.index(text)

    def clean(df: DataFrame, ids: list, texts: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, texts))

        def run(state, rows: pa.RecordBatch) -> pa.RecordBatch:
            reader, items = state
            keep = np.ones(len(rows), bool)
            for block in reader.blocks(rows.column(at)):
                places = np.array([place for place, _, _ in items.occurrences(block)], np.int64)
                keep[block.first + np.searchsorted(block.bounds, places, "right") - 1] = False
            return rows.filter(pa.array(keep))

        return mapped(df, run, df.schema, lambda: (WordReader(ALNUM, LOWER), _Items(*shared.value, window)))

    for number, part in enumerate(_parts(benchmark, item, item_text)):
        docs = clean(saved(docs) if number else docs, *part)
    return docs


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(docs, benchmark)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
