"""Vector codes by Lloyd's rounds in which whole tree nodes are assigned at once.

Vectors are cut into equal parts; each part position has a codebook. In a task the
parts of a block of vectors form a tree (halved at the middle of the widest side, with
the box, count and sum of every node), the entries another. Both trees are walked
together from their roots: for pairs of nodes the least and greatest distance between
boxes bound what can be nearest, and pairs that cannot win are dropped. Where one entry
remains for a node, all its parts are assigned by the node's cached sum. What is left
at the leaves is decided by integer distances, ties to the lower entry.

All numbers are integers, so results depend on no order of sums. A round is one pass:
tasks send a sum per entry that has parts, Spark adds them, and the codebooks (parts x
entries, however many rows there are) go back with the tasks of the next pass.

Defined results: rows whose vector is null or holds a null or non-finite component are
dropped, with them components so large that squared distances do not fit a long
(``largest``: 524,288 at 64 components), and rows of another length than most rows that can be cut into equal parts; equal ids go by vector
and null ids come last when the first entries are taken; a repeated row counts as often
as it stands; with fewer rows than entries the codebook is as short; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..session import land

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK_VALUES = 1 << 20         # numbers of vectors in one tree
LEAF = 16
_PAIR_VALUES = 1 << 21         # numbers compared at once at the leaves


@dataclass
class _Level:
    """The nodes of one level: bounds in the order of the tree, boxes."""

    bounds: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)


class Tree:
    """Points halved level by level; the children of node i are 2i and 2i + 1."""

    def __init__(self, points: np.ndarray, leaf: int):
        order = np.arange(len(points))
        self.levels: list[_Level] = []
        bounds = np.array([0, len(points)])
        while True:
            sorted_points = points[order]
            # An empty node has no box; its neighbour's numbers are never read.
            at = np.minimum(bounds[:-1], len(points) - 1)
            low, high = np.minimum.reduceat(sorted_points, at), np.maximum.reduceat(sorted_points, at)
            self.levels.append(_Level(bounds, low, high))
            if np.diff(bounds).max() <= leaf:
                break
            node = np.repeat(np.arange(len(at)), np.diff(bounds))
            widest = (high - low).argmax(axis=1)[node]
            value = sorted_points[np.arange(len(order)), widest] - low[node, widest]
            order = order[np.lexsort((value, node))]
            halves = np.empty(2 * len(at) + 1, np.int64)
            halves[::2], halves[1::2] = bounds, (bounds[:-1] + bounds[1:] + 1) // 2
            bounds = halves
        self.order, self.points = order, points[order]
        self.before = np.zeros((len(points) + 1, points.shape[1]), np.int64)    # sums of any stretch by two lookups
        np.cumsum(self.points, axis=0, out=self.before[1:])

    def sums(self, level: _Level, nodes: np.ndarray) -> np.ndarray:
        return self.before[level.bounds[nodes + 1]] - self.before[level.bounds[nodes]]


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def nearest_entries(points: np.ndarray, entries: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of every point, and count and sum of the points of every entry, by walking two trees."""
    tree, codes = Tree(points, leaf), Tree(entries, 1)
    labels = np.empty(len(points), np.int64)    # in the order of the tree
    counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    depth = 0
    while len(p):
        mine = tree.levels[min(depth, len(tree.levels) - 1)]
        theirs = codes.levels[min(depth, len(codes.levels) - 1)]
        stays = (mine.sizes[p] > 0) & (theirs.sizes[e] > 0)
        p, e = p[stays], e[stays]
        above, below = theirs.high[e] - mine.low[p], mine.high[p] - theirs.low[e]
        least = (np.maximum(np.maximum(-above, -below), 0) ** 2).sum(axis=1)
        most = (np.maximum(above, below) ** 2).sum(axis=1)
        first = _firsts(p)
        bound = np.repeat(np.minimum.reduceat(most, first), np.diff(np.append(first, len(p))))
        stays = least <= bound
        p, e = p[stays], e[stays]
        first = _firsts(p)
        alone = np.diff(np.append(first, len(p))) == 1
        done = first[alone & (theirs.sizes[e[first]] == 1)]
        if len(done):
            entry = codes.order[theirs.bounds[e[done]]]
            np.add.at(counts, entry, mine.sizes[p[done]])
            np.add.at(sums, entry, tree.sums(mine, p[done]))
            at, place = _spread(mine, p[done])
            labels[at] = entry[place]
            stays = np.ones(len(p), bool)
            stays[done] = False
            p, e = p[stays], e[stays]
        if depth >= max(len(tree.levels), len(codes.levels)) - 1:
            break
        grow_p, grow_e = depth < len(tree.levels) - 1, depth < len(codes.levels) - 1
        for grows, which in ((grow_e, "e"), (grow_p, "p")):
            if grows and which == "e":
                p, e = np.repeat(p, 2), (2 * e[:, None] + [0, 1]).ravel()
            elif grows:
                p, e = (2 * p[:, None] + [0, 1]).ravel(), np.repeat(e, 2)
        order = np.argsort(p, kind="stable")
        p, e = p[order], e[order]
        depth += 1
    if len(p):
        _leaves(tree, codes, entries, p, e, labels, counts, sums)
    out = np.empty(len(points), np.int64)
    out[tree.order] = labels
    return out, counts, sums


def _spread(level: _Level, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all points of these nodes, and which of the nodes each is of."""
    sizes = level.sizes[nodes]
    place = np.repeat(np.arange(len(nodes)), sizes)
    return np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + level.bounds[nodes][place], place


def _leaves(tree: Tree, codes: Tree, entries: np.ndarray, p: np.ndarray, e: np.ndarray, labels: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
    """Assign the points of uncertain leaves, given with the entries that may be nearest."""
    level, entry = tree.levels[-1], codes.order[codes.levels[-1].bounds[e]]
    first = _firsts(p)
    step = max(1, _PAIR_VALUES // (tree.points.shape[1] * int(level.sizes.max()) * len(entries)))
    for start in range(0, len(first), step):
        a = first[start]
        b = first[start + step] if start + step < len(first) else len(p)
        at, pair = _spread(level, p[a:b])
        order = np.lexsort((entry[a:b][pair], at))    # by point, then entry
        at, candidate = at[order], entry[a:b][pair[order]]
        distance = ((tree.points[at] - entries[candidate]) ** 2).sum(axis=1)
        points = _firsts(at)
        least = np.repeat(np.minimum.reduceat(distance, points), np.diff(np.append(points, len(at))))
        hit = np.flatnonzero(distance == least)
        hit = hit[_firsts(at[hit])]
        labels[at[hit]] = candidate[hit]
        np.add.at(counts, candidate[hit], 1)
        np.add.at(sums, candidate[hit], tree.points[at[hit]])


def _parts(column: pa.Array, parts: int) -> np.ndarray:
    """The vectors of a column as (row, part, component)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, -1)


def _blocks(batches: Iterator[pa.RecordBatch], name: str, parts: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in blocks of about ``BLOCK_VALUES`` numbers, with their parts."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += len(batch.column(batch.schema.get_field_index(name)).flatten())
        if size >= BLOCK_VALUES:
            table = pa.Table.from_batches(held)
            yield table, _parts(table.column(name).combine_chunks(), parts)
            held, size = [], 0
    if held:
        table = pa.Table.from_batches(held)
        yield table, _parts(table.column(name).combine_chunks(), parts)


def largest(components: Column) -> Column:
    """The bound of a component: squared differences of vectors within it sum to less than 2^63."""
    return F.sqrt(F.lit(float(1 << 62)) / components) / (2 * SCALE)


def whole_numbers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                  parts: int = PARTS) -> DataFrame:
    """``id, label, v`` of the rows that take part, components as integers, written once for all passes."""
    good = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < largest(F.size("v"))))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"),
                          F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.coalesce(good, F.lit(False)) & (F.size("v") > 0) & (F.size("v") % parts == 0))
    rows = land(rows.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("int"))), "whole-numbers")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(part, entry, component) of the smallest ids."""
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").toArrow().column("v")
    return np.ascontiguousarray(_parts(first.combine_chunks(), parts).transpose(1, 0, 2)) if len(first) else np.zeros((parts, 0, 1), np.int64)


def lloyd_round(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: entries become the floored means of their parts, unused ones stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for _, cut in _blocks(batches, "v", parts):
            for i in range(parts):
                _, n, s = nearest_entries(np.ascontiguousarray(cut[:, i]), books[i])
                counts[i] += n
                sums[i] += s
        slot = np.flatnonzero(counts)
        columns = [pa.array(slot), pa.array(counts.reshape(-1)[slot])]
        columns += [pa.array(c) for c in sums.reshape(-1, width)[slot].T]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "n"] + [f"s{j}" for j in range(width)])

    named = [f"s{j}" for j in range(width)]
    told = rows.select("v").mapInArrow(run, "slot long, n long, " + ", ".join(f"{c} long" for c in named))
    total = told.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ["n", *named]]).toArrow()    # a row per used entry
    out = books.reshape(-1, width).copy()
    if total.num_rows:
        sums = np.stack([total.column(c).to_numpy() for c in named], axis=1)
        out[total.column("slot").to_numpy()] = sums // total.column("n").to_numpy()[:, None]    # floors towards minus infinity
    return out.reshape(books.shape)


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, label, codes, error``: the nearest entry of every part, and the squared distances summed."""
    parts = len(books)
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cut in _blocks(batches, "v", parts):
            codes, error = np.empty((len(cut), parts), np.int16), np.zeros(len(cut), np.int64)
            for i in range(parts):
                points = np.ascontiguousarray(cut[:, i])
                codes[:, i], _, _ = nearest_entries(points, books[i])
                error += ((points - books[i][codes[:, i]]) ** 2).sum(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays(
                [table.column("id").combine_chunks(), table.column("label").combine_chunks(), lists, pa.array(error)],
                names=["id", "label", "codes", "error"])

    return rows.select("id", "label", "v").mapInArrow(run, f"id long, label {kind}, codes array<smallint>, error long")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The codes of all rows that take part, and the codebooks they refer to."""
    rows = whole_numbers(vectors, key, vector, label, parts)
    books = first_codebooks(rows, parts, entries)
    if books.shape[1]:
        for _ in range(rounds):
            books = lloyd_round(rows, books)
    return encode(rows, books), books


def code_report(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row that takes part."""
    found, books = compress(vectors)
    told = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # A null label is a label like any other here, and the join must meet it.
    found = land(found.withColumn("_label", F.to_json(F.struct("label"))), "codes")
    totals = found.groupBy("_label").agg(F.sum("error").alias("label_error"))
    hexed = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")
    return lookup(found, totals, "_label", "id").select(
        F.col("id").alias("vec_id"), hexed.alias("code"), "error", "label_error", F.lit(told).alias("codebooks_sha256"))
