"""Substring dedup by recompression: words covered by a long window that also stands elsewhere.

Every document is recompressed in rounds: runs of one word get a name, then
neighbouring symbols are paired where the first falls to the left and the second to
the right half of all names, and pairs get a name. Names are digests of what they
replace, so all tasks agree on them without a table of names, and equal stretches of
words are cut alike but near their ends. Runs above ``RUN`` words and pairs above
``SYMBOL`` words stay apart, so that how a place is cut depends on at most
``BEFORE`` words before it and ``AFTER`` behind it.

Each window of ``WINDOW`` words takes as its anchor the symbol with the least name
among those that start where only words of the window decide. Equal windows have
equal anchors in equal surroundings, so a window can stand elsewhere only if its
anchor's surroundings do. Anchors are joined first; then only windows with a shared
anchor are compared, by 128-bit digests of all their words. No window is lost and
none added.

Before each shuffle a task joins what it has itself: of equal anchors or windows it
sends one and marks it, so one that stands in a third of all texts costs a row per
batch. Texts move only for documents with a shared anchor.

Defined results: ids need not be unique, rows are told apart by id and text (an equal
row is judged alike); a null text has no words; texts of fewer than ``WINDOW`` words keep
all; a row given twice stands elsewhere for itself; a row without an id keeps its
words and covers none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .components import saved
from .words import SPACE, Block, WordReader, mapped, mix

WINDOW = 35
RUN = SYMBOL = 4
ROUNDS = 2
BEFORE = RUN + 1 + (ROUNDS - 1) * SYMBOL     # words before a place that decide whether a symbol starts there
AFTER = BEFORE + SYMBOL                      # words from a place on that decide the symbol that starts there
BROADCAST_IDS = 1_000_000
_ID = pa.int64()
MARKED = -1    # in place of a start: one of several equal windows of a batch
PART_BYTES = 64 << 20    # of text, for each part
_ENTRY = np.dtype([("w1", "<u8"), ("w2", "<u8"), ("id", "<i8"), ("row", "<i8"), ("start", "<i4")])
_START = np.dtype([("id", "<i8"), ("row", "<i8"), ("start", "<i4")])
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _name_runs(names: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after naming runs of 2 to ``RUN`` words: place of the first word, name, words."""
    if not len(names):
        return np.empty(0, np.int64), names, np.empty(0, np.int64)
    new = np.concatenate([[True], (names[1:] != names[:-1]) | (docs[1:] != docs[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(names)))
    named = (size >= 2) & (size <= RUN)
    run = np.cumsum(new) - 1
    at = np.flatnonzero(new | ~named[run])
    run = run[at]
    sizes = np.where(named[run], size[run], 1)
    return at, np.where(sizes > 1, mix(names[at] ^ mix(sizes.astype(np.uint64), 41), 42), names[at]), sizes


def _name_pairs(at: np.ndarray, names: np.ndarray, sizes: np.ndarray, docs: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after pairing a left name with a right one behind it."""
    if len(at) < 2:
        return at, names, sizes
    right = mix(names, salt) >> np.uint64(63) == 1
    joined = ~right[:-1] & right[1:] & (docs[at[1:]] == docs[at[:-1]]) & (sizes[:-1] + sizes[1:] <= SYMBOL)
    i = np.flatnonzero(joined)
    names, sizes = names.copy(), sizes.copy()
    names[i] = mix(names[i] ^ mix(names[i + 1], salt + 1), salt + 2)
    sizes[i] += sizes[i + 1]
    keep = np.ones(len(at), bool)
    keep[i + 1] = False
    return at[keep], names[keep], sizes[keep]


def recompress(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """First word and name of every symbol of a block after all rounds."""
    docs = block.docs
    at, names, sizes = _name_runs(block.digests, docs)
    for r in range(ROUNDS):
        at, names, sizes = _name_pairs(at, names, sizes, docs, 50 + 10 * r)
    return at, names


class _Windows:
    """Windows of the texts of a block, their anchors and digests."""

    def __init__(self, block: Block, powers: _Powers):
        self.block = block
        n = len(block.starts)
        counts = np.maximum(np.diff(block.bounds) - WINDOW + 1, 0)
        self.docs = np.repeat(np.arange(len(counts)), counts)
        self.starts = np.arange(len(self.docs)) - np.repeat(np.cumsum(counts) - counts, counts) + block.bounds[self.docs]
        self.sums = [powers.sums(mix(block.digests, 60 + i), i) for i in range(2)]
        self.powers = powers
        at, names = recompress(block)
        order = np.full(n, 2**64 - 1, np.uint64)
        order[at] = mix(names, 70)
        anchor = self.starts + BEFORE
        best = order[anchor]
        for offset in range(BEFORE + 1, WINDOW - AFTER + 1):
            here = order[self.starts + offset]
            less = here < best
            best = np.where(less, here, best)
            anchor = np.where(less, self.starts + offset, anchor)
        self.anchor = anchor

    def _digest(self, first: np.ndarray, size: int, which: int) -> np.ndarray:
        return self.powers.digest(self.sums[which], first, size, which)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and surroundings of every anchor, each once."""
        new = np.ones(len(self.anchor), bool)
        new[1:] = self.anchor[1:] != self.anchor[:-1]
        at = np.flatnonzero(new)
        return self.docs[at], self.keys(at)

    def keys(self, at: np.ndarray) -> np.ndarray:
        return self._digest(self.anchor[at] - BEFORE, BEFORE + AFTER, 0)

    def digests(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._digest(self.starts[at], WINDOW, 0), self._digest(self.starts[at], WINDOW, 1)


class _Powers:
    """Sums from which the digest of any stretch of words follows at once."""

    def __init__(self):
        self.forward = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.backward = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def _grow(self, n: int, which: int) -> None:
        if n > len(self.forward[which]):
            for held, base in ((self.forward, _BASES[which]), (self.backward, pow(_BASES[which], -1, 1 << 64))):
                steps = np.full(max(n, 1 << 18), base, np.uint64)
                steps[0] = 1
                held[which] = np.multiply.accumulate(steps)

    def sums(self, seq: np.ndarray, which: int) -> np.ndarray:
        self._grow(len(seq) + 1, which)
        out = np.zeros(len(seq) + 1, np.uint64)
        np.cumsum(seq * self.forward[which][:len(seq)], out=out[1:])
        return out

    def digest(self, sums: np.ndarray, first: np.ndarray, size: int, which: int) -> np.ndarray:
        return mix((sums[first + size] - sums[first]) * self.backward[which][first], 80 + which)


def _state() -> tuple[WordReader, _Powers]:
    return WordReader(SPACE), _Powers()


def _repeated(values: list[np.ndarray], marked: np.ndarray) -> np.ndarray:
    """Which rows hold a value that another row holds too, or one that is marked."""
    if not len(marked):
        return np.zeros(0, bool)
    order = np.lexsort(values[::-1])
    same = np.ones(len(order) - 1, bool)
    for v in values:
        v = v[order]
        same &= v[1:] == v[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.diff(np.append(first, len(order)))
    out = np.empty(len(order), bool)
    out[order] = np.repeat((size > 1) | np.logical_or.reduceat(marked[order], first), size)
    return out


def _first_of_each(values: list[np.ndarray]) -> np.ndarray:
    order = np.lexsort(values[::-1])
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = False
        for v in values:
            v = v[order]
            new[1:] |= v[1:] != v[:-1]
    return order[new]


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """``deal, id, row, key, kind`` of ``id, row, text``: 0 an anchor, 1 one of several equal in the batch, 2 an anchor known to repeat."""
    names = ["deal", "id", "row", "key", "kind"]

    def run(state, rows: pa.RecordBatch) -> pa.RecordBatch:
        reader, powers = state
        texts, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for block in reader.blocks(rows.column(2)):
            at, key = _Windows(block, powers).anchors()
            texts.append(block.first + at)
            keys.append(key)
        texts, keys = np.concatenate(texts), np.concatenate(keys)
        ids, own = (rows.column(i).to_numpy()[texts] for i in range(2))
        known = _repeated([keys], np.zeros(len(keys), bool))
        again = np.flatnonzero(known)
        sent = again[_first_of_each([keys[again]])] if len(again) else again
        single = np.flatnonzero(~known)
        told = again[_first_of_each([ids[again].view(np.uint64), own[again].view(np.uint64), keys[again]])] if len(again) else again
        at = np.concatenate([single, sent, told])
        kind = np.repeat(np.array([0, 1, 2], np.int8), [len(single), len(sent), len(told)])
        deal = np.where(kind == 2, mix(own[at].view(np.uint64) ^ keys[at]), keys[at])
        return pa.RecordBatch.from_arrays([pa.array(deal.view(np.int64)), pa.array(ids[at]), pa.array(own[at]),
                                           pa.array(keys[at].view(np.int64)), pa.array(kind)], names=names)

    return mapped(docs, run, "deal long, id long, row long, key long, kind tinyint", _state, gathered=True)


def _shared_anchors(rows: DataFrame, parts: int) -> DataFrame:
    """``id, row, key`` of the anchors whose surroundings stand more than once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.Table.from_batches([b]) for b in batches]
        if not held:
            return
        table = pa.concat_tables(held)
        ids, own, keys, kind = (table[c].to_numpy() for c in ("id", "row", "key", "kind"))
        found = kind == 2
        judged = np.flatnonzero(~found)
        found[judged] = _repeated([keys[judged]], kind[judged] == 1) & (kind[judged] == 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(own[found]), pa.array(keys[found])], names=["id", "row", "key"])

    return rows.repartition(parts, "deal").mapInArrow(run, "id long, row long, key long")


def _dealt(part: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    """Parts that have values, and each one's values as bytes."""
    order = np.argsort(part, kind="stable")
    part, values = part[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
    return part[first].tolist(), [values[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(part)))]


def _by_row(ids: np.ndarray, rows: np.ndarray, starts: np.ndarray, parts: int) -> tuple[list, list]:
    """Window starts dealt by their row."""
    values = np.empty(len(ids), _START)
    values["id"], values["row"], values["start"] = ids, rows, starts
    return _dealt((mix(rows.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64), values)


def _window_rows(docs: DataFrame, parts: int) -> DataFrame:
    """``part, known, windows`` of ``id, row, text, keys``: windows with a shared anchor, dealt by their digests.

    Windows that repeat within the batch are known, and dealt by their row.
    """
    names = ["part", "known", "windows"]

    def run(state, rows: pa.RecordBatch) -> pa.RecordBatch:
        reader, powers = state
        lists = rows.column(3)
        texts, starts, w1, w2 = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for block in reader.blocks(rows.column(2)):
            windows = _Windows(block, powers)
            keys = windows.keys(np.arange(len(windows.anchor)))
            held = []
            cuts = np.searchsorted(windows.docs, np.arange(block.last - block.first + 1))
            for d in range(block.last - block.first):
                shared = lists[block.first + d].values.to_numpy().view(np.uint64)
                held.append(cuts[d] + np.flatnonzero(np.isin(keys[cuts[d]:cuts[d + 1]], shared)))
            at = np.concatenate(held)
            one, two = windows.digests(at)
            texts.append(block.first + windows.docs[at])
            starts.append(windows.starts[at] - block.bounds[windows.docs[at]])
            w1.append(one)
            w2.append(two)
        texts, starts, w1, w2 = (np.concatenate(x) for x in (texts, starts, w1, w2))
        ids, own = (rows.column(i).to_numpy()[texts] for i in range(2))
        known = _repeated([w1, w2], np.zeros(len(w1), bool))
        again = np.flatnonzero(known)
        sent = again[_first_of_each([w1[again], w2[again]])] if len(again) else again
        at = np.concatenate([np.flatnonzero(~known), sent])
        values = np.empty(len(at), _ENTRY)
        values["w1"], values["w2"], values["id"], values["row"] = w1[at], w2[at], ids[at], own[at]
        values["start"] = np.where(known[at], MARKED, starts[at])
        part, data = _dealt((w1[at] % np.uint64(parts)).astype(np.int64), values)
        known_part, known_data = _by_row(ids[again], own[again], starts[again], parts)
        return pa.RecordBatch.from_arrays(
            [pa.array(part + known_part, pa.int32()), pa.array([False] * len(part) + [True] * len(known_part)),
             pa.array(data + known_data, pa.binary())], names=names)

    return mapped(docs, run, "part int, known boolean, windows binary", _state, gathered=True)


def _repeated_windows(rows: DataFrame, parts: int) -> DataFrame:
    """``id, row, starts`` of the windows that stand more than once, one row per text."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = []
        for batch in batches:
            known = batch.column(1)
            told = batch.filter(known)
            yield pa.RecordBatch.from_arrays([told.column(0), told.column(2)], names=["part", "starts"])
            values += batch.filter(pc.invert(known)).column(2).to_pylist()
        value = np.frombuffer(b"".join(values), _ENTRY)
        marked = value["start"] == MARKED
        found = value[_repeated([value["w1"], value["w2"]], marked) & ~marked]
        part, data = _by_row(found["id"], found["row"], found["start"], parts)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())], names=["part", "starts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.frombuffer(b"".join(x for batch in batches for x in batch.column(1).to_pylist()), _START)
        value = value[np.lexsort((value["row"], value["id"]))]
        ids, own, starts = value["id"], value["row"], np.ascontiguousarray(value["start"])
        new = (ids[1:] != ids[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(np.concatenate([[True], new])) if len(ids) else np.empty(0, np.int64)
        lists = [starts[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(ids)))]
        yield pa.RecordBatch.from_arrays([pa.array(ids[first], _ID), pa.array(own[first], _ID), pa.array(lists, pa.binary())],
                                         names=["id", "row", "starts"])

    judged = rows.repartition(parts, "part").mapInArrow(judge, "part int, starts binary")
    return judged.repartition(parts, "part").mapInArrow(gather, "id long, row long, starts binary")


def _kept(rows: pa.RecordBatch, reader: WordReader) -> tuple[list, list, list]:
    """Words, removed words and the kept text of each row of ``id, text`` and, if there, lists of window starts."""
    n_words, n_removed, texts = [], [], []
    for block in reader.blocks(rows.column(1)):
        for row, a, b in block.texts():
            covered = np.zeros(b - a + 1, np.int64)
            if rows.num_columns > 2:
                starts = np.unique(np.frombuffer(rows.column(2)[row].as_py(), "<i4"))
                covered[starts] += 1
                ends, count = np.unique(starts + WINDOW, return_counts=True)
                covered[ends] -= count
            kept = np.flatnonzero(np.cumsum(covered[:b - a]) == 0) + a
            n_words.append(b - a)
            n_removed.append(b - a - len(kept))
            texts.append(b" ".join(bytes(block.data[block.starts[i]:block.ends[i]]) for i in kept))
    return n_words, n_removed, texts


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per row: ``key, n_words, n_removed`` and the kept words joined by a space, or their digest ``kept_sha256``."""
    own = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(key).cast("long"), F.col(text)).alias("row"), F.col(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), size // PART_BYTES)
    shared = _shared_anchors(_anchor_rows(own.where("id is not null")), parts)
    keys = saved(shared.groupBy("id", "row").agg(F.collect_list("key").alias("keys")))    # a text's own anchors
    few = keys.count() <= BROADCAST_IDS
    rows = F.broadcast(keys.select("id", "row")) if few else keys.select("id", "row")
    met = own.join(rows, ["id", "row"], "left_semi")
    windows = _window_rows(met.join(keys, ["id", "row"]).select("id", "row", "text", "keys"), parts)
    starts = _repeated_windows(windows, parts)
    column = "kept_sha256" if digest else "kept"

    def run(reader: WordReader, rows: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, texts = _kept(rows, reader)
        told = [hashlib.sha256(t).hexdigest() if digest else t.decode("utf-8", "replace") for t in texts]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_words, _ID), pa.array(n_removed, _ID), pa.array(told, pa.string())],
                                          names=["id", "n_words", "n_removed", column])

    schema = f"id long, n_words long, n_removed long, {column} string"
    cut = mapped(met.join(starts, ["id", "row"], "left").select("id", "text", F.coalesce("starts", F.lit(b"")).alias("starts")),
                 run, schema, lambda: WordReader(SPACE))
    rest = mapped(own.join(rows, ["id", "row"], "left_anti").select("id", "text"), run, schema, lambda: WordReader(SPACE))
    return cut.unionByName(rest).withColumnRenamed("id", key)
