"""Exact nearest vectors for many queries at once.

No pair table is ever built: every task multiplies two blocks of vectors and
keeps only the few rows per query that can still be in the answer, and one
shuffle of those rows finishes the ranking. The sizes decide how blocks meet:

* a lexicon within the byte budget is broadcast and the queries are read in
  place, each task finishing its own queries;
* else a query set within the budget is broadcast and the lexicon is read in
  place, each task keeping its best rows per query;
* else both sides are grouped around pivots (``pivots``), groups are packed into blocks
  of queries and slices of lexicon rows, and each (block, slice) is one bounded task.
  Cells that cannot hold an answer are never built; inside a cell a query looks only
  at batches of rows with a group that can hold an answer of it.

Distances are compared at 9 decimals, ties going to the lower row id, so results
do not depend on how the sums were ordered. One vector length holds for the whole
search: that of most lexicon rows, unless given. Vectors that are null, of another
length, or without length have no distance: such rows are never chosen and such
queries get no answer, whatever stands beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.vectors import cosine_distance
from ..session import collect_if_small, land, shuffle_partitions
from . import pivots
from .ranking import keep_first

BROADCAST_BYTES = 64 << 20
# Query vectors of a cell. What a task holds follows from this and not from the size of either side.
BLOCK_BYTES = 32 << 20
SLICE_BLOCKS = 2     # blocks of lexicon rows in a cell: they are read in batches, so they cost less than queries
_CELLS = 1_000_000   # distances looked at together
_BATCH = 4096        # lexicon rows looked at together


def _unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors of this length, and their unit vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.list_(pa.float64()))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    lengths = np.nan_to_num(lengths.astype(float), nan=-1)
    at = np.flatnonzero(lengths == dim)
    if not len(at):
        return at, np.empty((0, dim))
    rows = column if len(at) == len(column) else column.take(pa.array(at))
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim)
    norms = np.sqrt((flat * flat).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    return at[good], flat[good] / norms[good, None]


class _Best:
    """Rows still in the running: the k nearest per query and the nearest per anchor period."""

    def __init__(self, query_ids: pa.Array, queries: np.ndarray, k: int, periods: tuple[int, ...], keep: list[str], again: bool = False):
        """``again``: a row may be looked at more than once and counts once."""
        self.query_ids, self.queries, self.k, self.periods, self.keep, self.again = query_ids, queries, k, periods, keep, again
        self.pool = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0, np.int64)]
        self.found: list[list[np.ndarray]] = []    # not in the pool yet
        self.rows: list[pa.Table] = []    # kept columns of the rows in the pool and of those found since
        self.base = 0
        self.bound = np.full(len(queries), np.inf)    # of the pool: the k-th distance of each query
        self.least = np.full((len(periods), len(queries)), np.inf)    # and the least of each period

    def _prune(self, q, ids, per, dist, slot):
        order = np.lexsort((ids, dist, q))
        q, ids, per, dist, slot = q[order], ids[order], per[order], dist[order], slot[order]
        if self.again and len(q):
            new = np.append(True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (dist[1:] != dist[:-1]))
            q, ids, per, dist, slot = q[new], ids[new], per[new], dist[new], slot[new]
        stay = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        for p in self.periods:
            at = np.flatnonzero(per == p)
            stay[at[np.diff(q[at], prepend=-1) != 0]] = True
        return [c[stay] for c in (q, ids, per, dist, slot)]

    def add(self, table: pa.Table, only: np.ndarray | None = None) -> None:
        """Take in lexicon rows: row_id, time_period, vector and the kept columns. ``only``: the queries that look at them."""
        for start in range(0, table.num_rows, _BATCH):
            self._add(table.slice(start, _BATCH), only)

    def _add(self, table: pa.Table, only: np.ndarray | None) -> None:
        at, units = _unit_rows(table.column("vector"), self.queries.shape[1])
        if not len(at):
            return
        table = table.select(["row_id", "time_period", *self.keep]).take(pa.array(at))
        ids = table.column("row_id").to_numpy()
        per = table.column("time_period").to_numpy().astype(float)
        place = np.full(len(per), len(self.periods))
        for n, p in enumerate(self.periods):
            place[per == p] = n
        order = np.argsort(place, kind="stable")    # rows of one period side by side
        units, ids, per = units[order], ids[order], per[order]
        ends = np.searchsorted(place[order], np.arange(len(self.periods) + 1))
        self.look(units, ids, per, self.base + order, ends, only)
        if self.keep:
            self.rows.append(table.select(self.keep))
            self.base += len(ids)
        self.settle()

    def look(self, units: np.ndarray, ids: np.ndarray, per: np.ndarray, slot: np.ndarray, ends: np.ndarray, only: np.ndarray | None) -> None:
        """Find rows, those of one period side by side up to its end in ``ends``."""
        asked = len(self.queries) if only is None else len(only)
        step = max(1, _CELLS // len(ids))
        for start in range(0, asked, step):
            mine = slice(start, min(start + step, asked)) if only is None else only[start:start + step]
            dist = self.queries[mine] @ units.T
            np.subtract(1.0, dist, out=dist)
            np.round(dist, 9, out=dist)
            dist += 0.0   # no negative zero
            bound = self.bound[mine]
            if len(ids) > self.k and np.isinf(bound).any():
                bound = np.minimum(bound, np.partition(dist, self.k - 1, axis=1)[:, self.k - 1])
            hit = dist <= bound[:, None]
            for n, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                if a < b:
                    part = dist[:, a:b]
                    hit[:, a:b] |= part <= np.minimum(self.least[n, mine], part.min(axis=1))[:, None]
            q, j = np.nonzero(hit)
            whose = q + start if only is None else mine[q]
            self.found.append(self._prune(whose, ids[j], per[j], dist[q, j], slot[j]))

    def settle(self) -> None:
        """What was found goes into the pool when it has become much."""
        if 4 * sum(len(f[0]) for f in self.found) > len(self.pool[0]):
            self._merge()

    def _merge(self) -> None:
        if not self.found:
            return
        self.pool = self._prune(*[np.concatenate(c) for c in zip(self.pool, *self.found)])
        self.found = []
        q, _, per, dist, slot = self.pool
        if self.keep:
            used, self.pool[4] = np.unique(slot, return_inverse=True)
            self.rows, self.base = [pa.concat_tables(self.rows).take(pa.array(used))], len(used)
        first = np.searchsorted(q, np.arange(len(self.queries) + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.bound[full] = dist[first[full] + self.k - 1]
        for n, p in enumerate(self.periods):
            at = np.flatnonzero(per == p)
            at = at[np.diff(q[at], prepend=-1) != 0]
            self.least[n, q[at]] = dist[at]

    def _order(self, top_n: int) -> tuple[np.ndarray, np.ndarray]:
        """Final order of the pool (anchors by period, then by distance) and the ranks kept."""
        q, ids, per, dist, _ = self.pool    # sorted by query, distance, id
        place = np.full(len(q), len(self.periods))
        for n, p in enumerate(self.periods):
            at = np.flatnonzero(per == p)
            place[at[np.diff(q[at], prepend=-1) != 0]] = n
        order = np.lexsort((ids, dist, place, q))
        q, place = q[order], place[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
        kept = (rank <= top_n) | (place < len(self.periods))
        return order[kept], rank[kept]

    def result(self, top_n: int | None = None) -> pa.Table | None:
        """The pool; with ``top_n`` the finished answer with its ``rank``."""
        self._merge()
        if not len(self.pool[0]):
            return None
        columns = {}
        if top_n is not None:
            order, rank = self._order(top_n)
            self.pool = [c[order] for c in self.pool]
            columns["rank"] = pa.array(rank.astype(np.int32))
        q, ids, per, dist, slot = self.pool
        none = np.isnan(per)
        columns = {
            "query_id": self.query_ids.take(pa.array(q)), **columns,
            "row_id": pa.array(ids),
            "time_period": pa.array(np.where(none, 0, per).astype(np.int32), mask=none),
            "distance": pa.array(dist),
        }
        rows = self.rows[0].take(pa.array(slot)) if self.keep else None
        return pa.table({**columns, **{n: rows.column(n) for n in self.keep}})


def _dimension(lexicon: DataFrame) -> int:
    """The length of most vectors; of equally frequent ones the longest."""
    sizes = lexicon.select(F.size("vector").alias("n")).where(F.col("n") > 0).groupBy("n").agg(F.count("*").alias("rows"))
    row = sizes.orderBy(F.desc("rows"), F.desc("n")).first()
    return row["n"] if row else 1


def _search(queries: DataFrame, lexicon: DataFrame, top_n: int, periods: tuple[int, ...], keep: list[str],
            budget: int, scan_tasks: int | None, dim: int | None) -> DataFrame:
    """The answer with its ``rank``, or rows without one that can still be in the answer."""
    spark = queries.sparkSession
    types = {f.name: f.dataType.simpleString() for f in lexicon.schema.fields}
    kind = queries.schema["query_id"].dataType.simpleString()
    rest = ", ".join(["row_id bigint, time_period int, distance double"] + [f"{n} {types[n]}" for n in keep])
    dim = dim or _dimension(lexicon)
    row_bytes = 8 * dim
    k = top_n + len(periods)
    schema = f"query_id {kind}, {rest}"

    def answer(query_ids: pa.Array, units: np.ndarray, tables: Iterator[pa.Table],
               last: int | None = None, keep: list[str] = keep) -> list[pa.RecordBatch]:
        best = _Best(query_ids, units, k, periods, keep)
        for t in tables:
            best.add(t)
        found = best.result(last)
        return [] if found is None else found.combine_chunks().to_batches()

    stored = collect_if_small(lexicon, budget, "vector", row_bytes)
    if stored is not None:
        shared = spark.sparkContext.broadcast(stored)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, units = _unit_rows(b.column("vector"), dim)
                if len(at):
                    yield from answer(b.column("query_id").take(pa.array(at)), units, iter([shared.value]), top_n)

        # A query costs far more to answer than to move, so the few bytes of a
        # small query set must not end up in one task.
        return queries.repartition(shuffle_partitions(spark), "query_id").mapInArrow(
            ask, f"query_id {kind}, rank int, {rest}")

    # The upstream work is done once, for the size check and all that follows.
    queries = land(queries, "queries")
    asked = collect_if_small(queries, budget, "vector", row_bytes)
    if asked is not None:
        at, units = _unit_rows(asked.column("vector"), dim)
        sent = spark.sparkContext.broadcast((asked.column("query_id").combine_chunks().take(pa.array(at)), units))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, units = sent.value
            if len(units):
                yield from answer(query_ids, units, (pa.Table.from_batches([b]) for b in batches))

        # Every task hands on a few rows per query, so fewer, longer tasks may pay; that is the caller's choice.
        read = lexicon.coalesce(scan_tasks) if scan_tasks else lexicon
        return read.mapInArrow(scan, schema)

    left, right, _ = _cells(queries, lexicon, k, periods, dim, max(1, BLOCK_BYTES // row_bytes))

    def cell(lt: pa.Table, rt: pa.Table) -> pa.Table:
        if lt.num_rows and rt.num_rows:
            at, units = _unit_rows(lt.column("vector"), dim)
            lt = lt.select(["query_id", "needs"]).take(pa.array(at))
            best = _Best(lt.column("query_id").combine_chunks(), units, k, periods, [])
            needs = pivots.unpacked(lt.column("needs"))
            group = rt.column("group").to_numpy()
            order = np.argsort(group, kind="stable")
            for start in range(0, len(order), _BATCH):
                rows = order[start:start + _BATCH]
                only = np.flatnonzero(needs[:, np.unique(group[rows])].any(axis=1))
                if len(only):
                    best.add(rt.take(pa.array(rows)), None if len(only) == len(units) else only)
            found = best.result()
            if found is not None:
                return found
        fields = [lt.schema.field("query_id"), pa.field("row_id", pa.int64()), pa.field("time_period", pa.int32()),
                  pa.field("distance", pa.float64())]
        return pa.schema(fields).empty_table()

    cells = ["_q", "_l"]
    return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(
        cell, f"query_id {kind}, row_id bigint, time_period int, distance double")


def _needs(lexicon: DataFrame, periods: tuple[int, ...], dim: int) -> tuple[DataFrame, pivots.Bounds]:
    """Lexicon rows with their group, and what is known of the groups."""
    points = pivots.choose(lexicon, dim, _unit_rows)
    rows = pivots.grouped(lexicon, points, dim, _unit_rows)
    return rows, pivots.Bounds(rows, points, periods)


def _cells(queries: DataFrame, lexicon: DataFrame, k: int, periods: tuple[int, ...], dim: int,
           block_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with the cells in which they meet, and the number of slices of the lexicon.

    Queries are packed into blocks and lexicon rows into slices, both by their group, groups
    near one another together. A query goes once to each slice that has a group it needs, a
    lexicon row to each block with a query that needs its slice: copies follow the blocks of
    the other side, not the groups.
    """
    spark = queries.sparkSession
    rows, bounds = _needs(lexicon, periods, dim)
    counts, met = pivots.meetings(queries, bounds, k, dim, _unit_rows)
    slices = pivots.packed(bounds.count, SLICE_BLOCKS * block_rows, bounds.chain)
    # Blocks are made smaller where the cores would not all be busy.
    cells = 4 * spark.sparkContext.defaultParallelism
    busy = max(-(-block_rows // 32), -(-int(counts.sum()) * slices.total // cells))
    blocks = pivots.packed(counts, min(block_rows, busy), bounds.chain)
    left = pivots.dealt(queries, bounds, blocks, slices, k, dim, _unit_rows)
    pairs = spark.createDataFrame(slices.meeting(blocks, met), "_l int, _q array<int>")
    # Every copy of a row carries its vector alone; the kept columns join the few winners later.
    right = rows.select("row_id", "time_period", "vector", "group", slices.column("group", "row_id").alias("_l")) \
        .join(F.broadcast(pairs), "_l").withColumn("_q", F.explode("_q"))
    return left, right, slices.total


def skipped_share(queries: DataFrame, lexicon: DataFrame, top_n: int = 10, periods: tuple[int, ...] = fixed.ANCHOR_PERIODS,
                  dim: int | None = None) -> DataFrame:
    """One row: pairs of a query and a lexicon row, and the share that the bounds keep from meeting."""
    dim = dim or _dimension(lexicon)
    lexicon = lexicon.select(F.col("row_id").cast("bigint"), F.col("time_period").cast("int"), "vector")
    rows, bounds = _needs(lexicon, periods, dim)
    _, met = pivots.meetings(queries.select("query_id", "vector"), bounds, top_n + len(periods), dim, _unit_rows)
    pairs = int(met.sum(axis=0) @ bounds.count)
    all_pairs = queries.agg(F.count("*").alias("q")).scalar() * rows.agg(F.count("*").alias("l")).scalar()
    return queries.sparkSession.range(1).select(all_pairs.alias("pairs"), (F.lit(1.0) - F.try_divide(F.lit(pairs), all_pairs)).alias("skipped"))


def nearest_with_coverage(queries: DataFrame, lexicon: DataFrame, top_n: int = 10,
                          periods: tuple[int, ...] = fixed.ANCHOR_PERIODS,
                          min_similarity: float | None = None, keep: tuple[str, ...] = (),
                          budget: int = BROADCAST_BYTES,
                          scan_tasks: int | None = None, dim: int | None = None) -> DataFrame:
    """Nearest lexicon rows of every query, with each anchor period covered.

    ``queries``: (query_id, vector). ``lexicon``: (row_id bigint, time_period int,
    vector, ...). Result: (query_id, rank, row_id, time_period, distance, similarity)
    and the lexicon columns named in ``keep``.
    The best row of each anchor period that exists comes first, in the order of
    ``periods``; the rest is filled by distance up to ``top_n``. All anchors stay
    even when there are more of them than ``top_n``.
    """
    lexicon = lexicon.select(F.col("row_id").cast("bigint"), F.col("time_period").cast("int"), "vector", *keep)
    found = _search(queries.select("query_id", "vector"), lexicon, top_n, periods, list(keep), budget, scan_tasks, dim)
    if "rank" not in found.columns:
        found = _rank(found, top_n, periods)
    missing = [c for c in keep if c not in found.columns]
    if missing:
        found = found.join(lexicon.select("row_id", *missing), "row_id")
    out = found.select("query_id", "rank", "row_id", "time_period", "distance",
                       (F.lit(1.0) - F.col("distance")).alias("similarity"), *keep)
    return out if min_similarity is None else out.where(F.col("similarity") >= min_similarity)


def _rank(found: DataFrame, top_n: int, periods: tuple[int, ...]) -> DataFrame:
    # One exchange on the query serves every window below.
    found = found.repartition("query_id")
    best = Window.partitionBy("query_id", "time_period").orderBy("distance", "row_id")
    order = F.array_position(F.array(*[F.lit(p) for p in periods]).cast("array<int>"), F.col("time_period"))
    anchor = ((F.row_number().over(best) == 1) & (order > 0)) if periods else F.lit(False)
    ranked = found.withColumn("_anchor", F.coalesce(anchor, F.lit(False)))
    whole = Window.partitionBy("query_id").orderBy(
        F.desc("_anchor"), F.when(F.col("_anchor"), order), "distance", "row_id")
    ranked = ranked.withColumn("rank", F.row_number().over(whole))
    return ranked.where((F.col("rank") <= top_n) | F.col("_anchor"))


def first_vectors(lexicon: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """The first stored row of each word (of ``words`` only, when given).

    Rows are cut to one per word first, so a word that is stored very often meets the words once.
    """
    first = keep_first(lexicon, ["word"], ["row_id"])
    return first if words is None else first.join(words.select("word").distinct(), "word", "left_semi")


def similar_words(words: DataFrame, lexicon: DataFrame, n: int = 5, budget: int = BROADCAST_BYTES,
                  scan_tasks: int | None = None, dim: int | None = None) -> DataFrame:
    """The n stored rows most similar to each stored word, the word's own row left out.

    Words that are not stored give no rows. Result: (word, rank, row_id, similarity).
    """
    own = first_vectors(lexicon, words).select(F.struct("word", "row_id").alias("query_id"), "vector")
    near = nearest_with_coverage(own, lexicon, n + 1, (), budget=budget, scan_tasks=scan_tasks, dim=dim)
    others = near.where(F.col("row_id") != F.col("query_id.row_id"))
    w = Window.partitionBy("query_id").orderBy("rank")
    return others.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n) \
        .select("query_id.word", F.col("_place").alias("rank"), "row_id", "similarity")


def query_distances(lexicon: DataFrame, query_vector) -> DataFrame:
    """The distance of every lexicon row to one query vector."""
    return lexicon.withColumn("distance", cosine_distance("vector", query_vector))
