"""Substring dedup by distributed prefix doubling over bytes.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts elsewhere. A
suffix array over all bytes would shuffle some 24 bytes per byte of text and round, so
the first round sorts picked positions only. A start ``s`` picks the position with the
least gram among the ``PICK`` positions from ``s`` on. Equal strings pick alike, and
the ``PREFIX`` bytes from the picked position on lie inside every string that picks it.

Round one: Spark sorts the picked positions by the name of their ``PREFIX`` bytes. A
position whose prefix is unique leaves, with all strings that pick it.
Round two: what is left is dealt by that name, each position with the bytes of its
strings. Equal stretches become one. In each part all start positions are ranked by
pairs of their rank and the name at the growing offsets of ``OFFSETS``, and reranked
until they are unique or past ``LENGTH``.

Names are 128-bit digests of the bytes they stand for, which all tasks give alike.

Groups of copies: of equal prefixes, and of equal stretches, a batch sends one with
their number. A prefix that holds more than half of its part is hot; its strings are
dealt by their own names instead, so no task gets them all.

Defined results: a null text is empty; shorter texts keep all; ids need not be unique,
rows are told apart by id and text; a row given twice stands elsewhere for itself; a
row without an id is judged like any other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .components import saved
from .words import mapped, mix, text_bytes

LENGTH = 200
GRAM = 16
PICK = 161
PREFIX = LENGTH - PICK + 1
OFFSETS = ((0, 64), (64, 64), (128, LENGTH - 128))    # of the pairs: offset and bytes of what is named there
PIECE = 1 << 20               # start positions looked at together; a longer text is taken in pieces
_PLACES = 4 * PIECE           # more than a piece has bytes
SLICE = 4 << 20               # bytes of stretches ranked together, groups of one prefix whole
PART_BYTES = 64 << 20         # of text, for each part
HOT_LEAST = 20_000            # positions of one prefix below which it is never hot
BROADCAST_ROWS = 1_000_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_VALUES = np.random.default_rng(20240613).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64)
_KEY = [("id", "<i8"), ("row", "<i8")]
_PLACE = np.dtype([*_KEY, ("at", "<i4"), ("far", "u1"), ("near", "u1")])    # strings start far to near bytes before ``at``
_ASKED = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("count", "<i4"), *_PLACE.descr])
_STRETCH = np.dtype([("d1", "<u8"), *_PLACE.descr, ("marked", "u1")])
_STRING = np.dtype([("d1", "<u8"), ("d2", "<u8"), *_KEY, ("start", "<i4"), ("marked", "u1")])
_SPAN = np.dtype([*_KEY, ("low", "<i4"), ("high", "<i4")])
_NAME = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("count", "<i8")])
ASK, TOLD, STRINGS, HOT = range(4)
_ROWS = "part int, kind tinyint, data binary"


class Names:
    """128-bit names of any stretch of bytes, from running sums."""

    def __init__(self):
        self._up, self._down = [np.ones(1, np.uint64)] * 2, [np.ones(1, np.uint64)] * 2
        self._sums: list[np.ndarray] = []

    def read(self, data: np.ndarray) -> Names:
        n = len(data)
        if n + 1 > len(self._up[0]):
            for i, base in enumerate(_BASES):
                for held, step in ((self._up, base), (self._down, pow(base, -1, 1 << 64))):
                    steps = np.full(n + 1 + (n >> 2), step, np.uint64)
                    steps[0] = 1
                    held[i] = np.multiply.accumulate(steps)
        self._sums = [np.zeros(n + 1, np.uint64) for _ in range(2)]
        for i in range(2):
            np.cumsum(_VALUES[i][data] * self._up[i][:n], out=self._sums[i][1:])
        return self

    def name(self, first, size, which: int) -> np.ndarray:
        sums = self._sums[which]
        return mix((sums[first + size] - sums[first]) * self._down[which][first], 90 + which)


@dataclass
class Piece:
    """Texts, or a stretch of one, as bytes, and the row and first byte of each."""

    data: np.ndarray
    rows: np.ndarray
    bounds: np.ndarray     # of the texts within data
    skipped: np.ndarray    # bytes of the text before its stretch


def pieces(column: pa.Array) -> Iterator[Piece]:
    """Texts of a batch in pieces of about ``PIECE`` start positions; a longer text gives pieces that overlap by ``LENGTH`` - 1 bytes."""
    data, offsets = text_bytes(column)
    held, size = [], 0

    def piece() -> Piece:
        lengths = np.array([b - a for _, a, b in held])
        return Piece(np.concatenate([data[a:b] for _, a, b in held]), np.array([r for r, _, _ in held]),
                     np.concatenate([[0], np.cumsum(lengths)]), np.array([a - offsets[r] for r, a, _ in held]))

    for row in range(len(offsets) - 1):
        first, last = int(offsets[row]), int(offsets[row + 1])
        while last - first >= LENGTH:
            end = min(first + PIECE + LENGTH - 1, last)
            held.append((row, first, end))
            size += end - first
            first = end - LENGTH + 1
            if size >= PIECE:
                yield piece()
                held, size = [], 0
    if held:
        yield piece()


def _starts(bounds: np.ndarray) -> np.ndarray:
    """Every position from which ``LENGTH`` bytes are left in its text."""
    counts = np.maximum(np.diff(bounds) - LENGTH + 1, 0)
    return np.arange(counts.sum()) + np.repeat(bounds[:-1] - np.cumsum(counts) + counts, counts)


def picked(piece: Piece, names: Names) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The picked positions of a piece, and the first and last start that picks each."""
    grams = names.name(np.arange(len(piece.data) - GRAM + 1), GRAM, 0)
    low = np.uint64(_PLACES - 1)    # the same bits of every gram count, however long a piece is
    best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)    # of equal ones the first
    size = 1
    while 2 * size <= PICK:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    best = np.minimum(best[:len(best) - (PICK - size)], best[PICK - size:])
    starts = _starts(piece.bounds)
    at = (best[starts] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], starts[first], starts[np.append(first[1:], len(at)) - 1]


def _repeated(values: list[np.ndarray], marked: np.ndarray) -> np.ndarray:
    """Which rows hold values that another row holds too, or one that is marked."""
    if not len(marked):
        return np.zeros(0, bool)
    order = np.lexsort(values[::-1])
    first = _new(values, order)
    sizes = np.diff(np.append(first, len(order)))
    out = np.empty(len(order), bool)
    out[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(marked[order], first), sizes)
    return out


def _new(values: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Where new values begin in rows sorted by ``order``."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for v in values:
            v = v[order]
            new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _one_of_each(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One row of each group of equal values, and the sizes of the groups."""
    order = np.lexsort(values[::-1])
    first = _new(values, order)
    return order[first], np.diff(np.append(first, len(order)))


def _dealt(part: np.ndarray, values: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    order = np.argsort(part, kind="stable")
    part, values = part[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
    return [(int(part[a]), kind, values[a:b].tobytes()) for a, b in zip(first, np.append(first[1:], len(part)))]


def _by_row(values: np.ndarray, parts: int, kind: int = TOLD) -> list[tuple[int, int, bytes]]:
    return _dealt((mix(values["row"].view(np.uint64)) % np.uint64(parts)).astype(np.int64), values, kind)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int8()), pa.array(data, pa.binary())],
                                      names=["part", "kind", "data"])


def _keyed(dtype: np.dtype, n: int, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.zeros(n, dtype)
    out["id"], out["row"] = ids, keys
    return out


def _prefixes(docs: DataFrame, parts: int) -> DataFrame:
    """Of ``id, row, text``: picked positions with the names of their prefixes, those known to repeat dealt by their row."""
    def run(names: Names, rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys = (rows.column(i).to_numpy() for i in range(2))
        found = [np.empty(0, _ASKED)]
        for piece in pieces(rows.column(2)):
            at, first, last = picked(piece, names.read(piece.data))
            text = np.searchsorted(piece.bounds, at, "right") - 1
            asked = _keyed(_ASKED, len(at), ids[piece.rows[text]], keys[piece.rows[text]])
            asked["at"] = at - piece.bounds[text] + piece.skipped[text]
            asked["far"], asked["near"] = at - first, at - last
            asked["d1"], asked["d2"] = (names.name(at, PREFIX, i) for i in range(2))
            found.append(asked)
        found = np.concatenate(found)
        names_ = [found["d1"], found["d2"]]
        told = found[_repeated(names_, np.zeros(len(found), bool))][list(_PLACE.names)]
        one, count = _one_of_each(names_)
        asked = found[one]
        asked["count"] = count
        # What is told already still has to be counted, and to answer for others.
        return _batch(_dealt((asked["d1"] % np.uint64(parts)).astype(np.int64), asked, ASK) + _by_row(told.astype(_PLACE), parts))

    return mapped(docs, run, _ROWS, Names, gathered=True)


def _read(held: dict[int, list[bytes]], kind: int, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(held.pop(kind, [])), dtype)


def _each_part(rows: DataFrame, parts: int, judge) -> DataFrame:
    """Apply ``judge`` to all data of a task by kind; told rows pass as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, kind, data in zip(*[c.to_pylist() for c in batch.columns]):
                if kind == TOLD:
                    yield _batch([(part, kind, data)])
                else:
                    held.setdefault(kind, []).append(data)
        for out in judge(held):
            yield _batch(out)

    return rows.repartition(parts, "part").mapInArrow(run, _ROWS)


def _shared_prefixes(rows: DataFrame, parts: int) -> DataFrame:
    """Positions whose prefix is held by another, dealt by row, and the hot prefixes."""
    def judge(held):
        asked = _read(held, ASK, _ASKED)
        shared = _repeated([asked["d1"], asked["d2"]], asked["count"] > 1) & (asked["count"] == 1)
        yield _by_row(asked[shared][list(_PLACE.names)].astype(_PLACE), parts)
        if len(asked):
            order = np.lexsort((asked["d2"], asked["d1"]))
            first = _new([asked["d1"], asked["d2"]], order)
            counts = np.add.reduceat(asked["count"][order].astype(np.int64), first)
            hot = np.flatnonzero(counts > max(HOT_LEAST, counts.sum() // 2))    # one at most, or none
            told = np.zeros(len(hot), _NAME)
            told["d1"], told["d2"], told["count"] = asked["d1"][order[first[hot]]], asked["d2"][order[first[hot]]], counts[hot]
            yield [(0, HOT, told.tobytes())] if len(hot) else []

    return _each_part(rows, parts, judge)


def _gathered(rows: DataFrame, parts: int, dtype: np.dtype, out: str) -> DataFrame:
    """``id, row`` and the rest of all records of each, as bytes."""
    rest = [n for n in dtype.names if n not in ("id", "row")]
    own = np.dtype([(n, dtype[n]) for n in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.frombuffer(b"".join(x for b in batches for x in b.column(2).to_pylist()), dtype)
        order = np.lexsort((values[rest[0]], values["row"], values["id"]))
        values = values[order]
        first = _new([values["id"], values["row"]], np.arange(len(values)))
        own_values = values[rest].astype(own)
        lists = [own_values[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(values)))]
        yield pa.RecordBatch.from_arrays([pa.array(values["id"][first]), pa.array(values["row"][first]), pa.array(lists, pa.binary())],
                                         names=["id", "row", out])

    return rows.where(F.col("kind") == TOLD).repartition(parts, "part").mapInArrow(run, f"id long, row long, {out} binary")


def _ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches, one behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)


def _packed(stretches: np.ndarray, data: np.ndarray) -> bytes:
    raw = stretches.tobytes() + data.tobytes()
    head = np.array([len(stretches), len(raw)], np.int64).tobytes()
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    stretches, data = [np.empty(0, _STRETCH)], [np.empty(0, np.uint8)]
    for blob in blobs:
        n, size = np.frombuffer(blob[:16], np.int64)
        raw = pa.decompress(blob[16:], decompressed_size=int(size), codec="zstd", asbytes=True)
        stretches.append(np.frombuffer(raw, _STRETCH, int(n)))
        data.append(np.frombuffer(raw, np.uint8, offset=int(n) * _STRETCH.itemsize))
    return np.concatenate(stretches), np.concatenate(data)


def _spans(ids: np.ndarray, keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Bytes covered by strings that start at ``first`` to ``last``."""
    out = _keyed(_SPAN, len(ids), ids, keys)
    out["low"], out["high"] = first, last + LENGTH
    return out


def _runs(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Spans of strings given one by one, those of adjoining starts joined."""
    if not len(ids):
        return np.empty(0, _SPAN)
    order = np.lexsort((starts, keys, ids))
    ids, keys, starts = ids[order], keys[order], starts[order]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (starts[1:] > starts[:-1] + 1)])
    first = np.flatnonzero(new)
    return _spans(ids[first], keys[first], starts[first], starts[np.append(first[1:], len(ids)) - 1])


def _stretches(docs: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """Of ``id, row, text, places``: the bytes of all strings that pick a shared prefix, dealt by that prefix; strings of a hot one by themselves."""
    def run(names: Names, rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys = (rows.column(i).to_numpy() for i in range(2))
        places = rows.column(3)
        own = np.dtype([(n, _PLACE[n]) for n in ("at", "far", "near")])
        told, found, data, one_by_one = [np.empty(0, _SPAN)], [np.empty(0, _STRETCH)], [np.empty(0, np.uint8)], [np.empty(0, _STRING)]
        unions = [np.empty((2, 0), np.uint64)]
        for piece in pieces(rows.column(2)):
            names.read(piece.data)
            for text, row in enumerate(piece.rows):
                place = np.unique(np.frombuffer(places[int(row)].as_py(), own))
                offset = int(piece.bounds[text] - piece.skipped[text])
                # A piece takes the places whose strings it holds whole.
                first, last = place["at"].astype(np.int64) - place["far"] + offset, place["at"].astype(np.int64) - place["near"] + offset
                whole = (first >= piece.bounds[text]) & (last + LENGTH <= piece.bounds[text + 1])
                place, first, last = place[whole], first[whole], last[whole]
                at = place["at"] + offset
                d1, d2 = (names.name(at, PREFIX, i) for i in range(2))
                is_hot = np.isin(d1, hot["d1"]) if len(hot) else np.zeros(len(at), bool)
                if is_hot.any():
                    starts = _ragged(first[is_hot], last[is_hot] - first[is_hot] + 1)
                    strings = _keyed(_STRING, len(starts), ids[row], keys[row])
                    strings["start"] = starts - offset
                    strings["d1"], strings["d2"] = (names.name(starts, LENGTH, i) for i in range(2))
                    one_by_one.append(strings)
                cold = ~is_hot
                stretch = _keyed(_STRETCH, int(cold.sum()), ids[row], keys[row])
                for n in own.names:
                    stretch[n] = place[n][cold]
                stretch["d1"] = d1[cold]
                sizes = last[cold] - first[cold] + LENGTH
                unions.append(np.stack([names.name(first[cold], sizes, i) for i in range(2)]))
                found.append(stretch)
                data.append(piece.data[_ragged(first[cold], sizes)])
        found, data, strings = np.concatenate(found), np.concatenate(data), np.concatenate(one_by_one)
        union = np.concatenate(unions, axis=1)
        out: list[tuple[int, int, bytes]] = []
        if len(found):
            sizes = found["far"].astype(np.int64) - found["near"] + LENGTH
            begin = np.cumsum(sizes) - sizes
            same = [union[0], union[1], sizes.astype(np.uint64)]
            twice = _repeated(same, np.zeros(len(found), bool))
            told.append(_spans(found["id"][twice], found["row"][twice], found["at"][twice] - found["far"][twice].astype(np.int32),
                               found["at"][twice] - found["near"][twice].astype(np.int32)))
            one, count = _one_of_each(same)
            found["marked"] = twice
            part = (found["d1"][one] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            one, part = one[order], part[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            for a, b in zip(cuts, np.append(cuts[1:], len(one))):
                mine = one[a:b]
                out.append((int(part[a]), ASK, _packed(found[mine], data[_ragged(begin[mine], sizes[mine])])))
        if len(strings):
            values = [strings["d1"], strings["d2"]]
            twice = _repeated(values, np.zeros(len(strings), bool))
            told.append(_runs(strings["id"][twice], strings["row"][twice], strings["start"][twice]))
            strings["marked"] = twice
            one, _ = _one_of_each(values)
            out += _dealt((strings["d2"][one] % np.uint64(parts)).astype(np.int64), strings[one], STRINGS)
        return _batch(out + _by_row(np.concatenate(told), parts))

    return mapped(docs, run, _ROWS, Names, gathered=True)


def ranked(names: Names, starts: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Which of the strings of ``LENGTH`` bytes are not unique, or equal one that is marked.

    Starts are sorted by rank and the name at an offset; what is unique leaves, the rest
    gets new ranks and goes on to the next offset.
    """
    live, rank = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for offset, size in OFFSETS:
        pair = [rank, *[names.name(starts[live] + offset, size, i) for i in range(2)]]
        number = mix(pair[1] ^ mix(rank.view(np.uint64)))
        order = np.argsort(number)
        first = _new(pair, order)
        if len(first) != len(_new([number], order)):
            order = np.lexsort(pair[::-1])    # two pairs met in one number
            first = _new(pair, order)
        sizes = np.diff(np.append(first, len(order)))
        stays = (sizes > 1) | (np.logical_or.reduceat(marked[live[order]], first) if len(order) else np.zeros(0, bool))
        kept = np.repeat(stays, sizes)
        rank = np.repeat(np.arange(len(first)), sizes)[kept]
        live = live[order[kept]]
    return live


def _covered(rows: DataFrame, parts: int) -> DataFrame:
    """Spans covered by strings that stand more than once, dealt by row."""
    def judge(held):
        names = Names()
        strings = _read(held, STRINGS, _STRING)
        marked = strings["marked"] == 1
        found = strings[_repeated([strings["d1"], strings["d2"]], marked) & ~marked]
        yield _by_row(_runs(found["id"], found["row"], found["start"]), parts)
        stretches, data = _unpacked(held.pop(ASK, []))
        if not len(stretches):
            return
        counts = stretches["far"].astype(np.int64) - stretches["near"] + 1
        sizes = counts + LENGTH - 1
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(stretches["d1"], kind="stable")    # groups of one prefix together
        done = 0
        ends = np.append(_new([stretches["d1"]], order)[1:], len(order))
        load = np.cumsum(sizes[order])
        while done < len(order):
            # As many groups as fit a slice, one at least.
            base = load[done - 1] if done else 0
            reach = int(np.searchsorted(load, base + SLICE, "right"))
            fits = int(np.searchsorted(ends, reach, "right"))
            end = int(ends[max(fits - 1, int(np.searchsorted(ends, done, "right")))])
            yield _by_row(_judged(stretches, data, begin, sizes, counts, order[done:end], names), parts)
            done = end

    return _each_part(rows, parts, judge)


def _judged(stretches: np.ndarray, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, counts: np.ndarray,
            mine: np.ndarray, names: Names) -> np.ndarray:
    """Spans of the repeated strings of some stretches; equal stretches are ranked once."""
    text = data[_ragged(begin[mine], sizes[mine])]
    at = np.cumsum(sizes[mine]) - sizes[mine]
    names.read(text)
    whole = [names.name(at, sizes[mine], 0), names.name(at, sizes[mine], 1), sizes[mine].astype(np.uint64)]
    marked = stretches["marked"][mine] == 1
    twice = _repeated(whole, marked)
    first = (stretches["at"].astype(np.int64) - stretches["far"])[mine]
    told = twice & ~marked
    spans = [_spans(stretches["id"][mine[told]], stretches["row"][mine[told]], first[told], first[told] + counts[mine[told]] - 1)]
    one, _ = _one_of_each(whole)
    string = np.repeat(one, counts[mine[one]])
    starts = _ragged(at[one], counts[mine[one]])
    hit = ranked(names, starts, twice[string])
    hit = hit[~twice[string[hit]]]
    string, starts = string[hit], starts[hit]
    spans.append(_runs(stretches["id"][mine[string]], stretches["row"][mine[string]], starts - at[string] + first[string]))
    return np.concatenate(spans)


def _cut(text: bytes, spans: bytes) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes that go and the number of runs they make."""
    covered = np.frombuffer(spans, np.dtype([("low", "<i4"), ("high", "<i4")]))    # sorted by their first byte
    kept, end, removed, n_runs = [], 0, 0, 0
    reach = -1
    for low, high in covered.tolist():
        if low > reach:
            kept.append(text[end:low])
            n_runs += 1
            removed += high - low
            end = reach = high
        elif high > reach:
            removed += high - reach
            end = reach = high
    kept.append(text[end:])
    return b"".join(kept), removed, n_runs


def remove_repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per row: ``key, n_bytes, n_removed, n_spans`` and the bytes ``kept``, or their digest ``kept_sha256``."""
    spark = docs.sparkSession
    wide = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = wide.select(F.coalesce("id", F.lit(0)).alias("key"), F.xxhash64("id", "text").alias("row"), "id", "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), size // PART_BYTES)
    long = own.where(F.octet_length("text") >= LENGTH)
    judged = saved(_shared_prefixes(_prefixes(long.select("key", "row", "text"), parts), parts))
    hot = b"".join(r["data"] for r in judged.where(F.col("kind") == HOT).select("data").collect())    # one name per part at most
    places = saved(_gathered(judged, parts, _PLACE, "places").withColumnRenamed("id", "key"))
    few = places.count() <= BROADCAST_ROWS
    keys = F.broadcast(places.select("key", "row")) if few else places.select("key", "row")
    met = own.join(keys, ["key", "row"], "left_semi")
    asked = met.join(places, ["key", "row"]).select("key", "row", "text", "places")
    spans = _gathered(_covered(_stretches(asked, parts, np.frombuffer(hot, _NAME)), parts), parts, _SPAN, "spans") \
        .withColumnRenamed("id", "key")
    column = "kept_sha256" if digest else "kept"

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(rows.column(1))
        out = []
        for i, cut in enumerate(rows.column(2).to_pylist()):
            whole = bytes(data[offsets[i]:offsets[i + 1]])
            kept, removed, n_spans = _cut(whole, cut or b"")
            out.append((len(whole), removed, n_spans, hashlib.sha256(kept).hexdigest() if digest else kept))
        columns = list(zip(*out)) or [()] * 4
        kinds = [pa.int64()] * 3 + [pa.string() if digest else pa.binary()]
        return pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                          names=["id", "n_bytes", "n_removed", "n_spans", column])

    schema = f"id long, n_bytes long, n_removed long, n_spans long, {column} {'string' if digest else 'binary'}"
    changed = mapped(met.join(spans, ["key", "row"], "left").select("id", "text", "spans"), run, schema)
    rest = own.join(keys, ["key", "row"], "left_anti").select("id", "text", F.lit(None).cast("binary").alias("spans"))
    return changed.unionByName(mapped(rest, run, schema)).withColumnRenamed("id", key)
