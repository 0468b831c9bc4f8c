"""Approximate nearest vectors by random-projection buckets.

Each of several tables cuts the space by random planes through the origin; the sides on
which a vector lies name its bucket, and near vectors often share one. Lexicon rows are
dealt to their bucket of every table, queries also to the buckets across the planes
they lie closest to. The buckets are join keys: where both sides meet, one task ranks
exactly by cosine distance, and the few best of all tables are ranked once more.

Where whole blocks of both sides move less than a copy for every bucket, a task gets a
block of queries and a slice of rows and deals them to the same buckets by itself, all
tables after one another; what is found and what may be missed is the same.

The number of planes follows the rows, so buckets hold about ``bucket_rows`` whatever the
size. A bucket with many more is cut by further planes; what planes cannot part (rows of
one direction) is sliced, and queries go to every slice. Of equal vectors only those with
the lowest ids can be chosen, so the rest stay out of the buckets.

Distances are exact and compared as in the exact search; only rows that share no bucket
with a query can be missed. Vectors that are null, of another length or without length
are never chosen and get no answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from .neighbours import _BATCH, _Best, _dimension, _rank, _unit_rows

TABLES = 16
BUCKET_ROWS = 1024
HOT = 4                  # times ``bucket_rows`` at which a bucket is cut
FURTHER = 24             # planes kept ready for hot buckets
SLICE_ROWS = 20_000      # of one side that meet in a task
HOT_BROADCAST = 1_000_000
BLOCK_BYTES = 32 << 20   # of query vectors that meet a slice of rows in a task
SLICE_BLOCKS = 2         # blocks of row vectors in a slice


def _scored(units: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return (units @ planes.reshape(-1, planes.shape[2]).T).reshape(len(units), *planes.shape[:2])


def _sides(scores: np.ndarray) -> np.ndarray:
    """(row, table, plane) as numbers by row and table."""
    powers = 1 << np.arange(scores.shape[2], dtype=np.int64)[::-1]
    return ((scores >= 0) * powers).sum(axis=2) if scores.shape[2] else np.zeros(scores.shape[:2], np.int64)


def _buckets(units: np.ndarray, planes: np.ndarray, probes: int) -> list[np.ndarray]:
    """The buckets by row and table: the own ones, then those across the closest planes."""
    scores = _scored(units, planes)
    own = _sides(scores)
    closest = np.argsort(np.abs(scores), axis=2)[:, :, :probes]
    return [own, *(own ^ (np.int64(1) << (planes.shape[1] - 1 - closest[:, :, p])) for p in range(closest.shape[2]))]


def _dealt(df: DataFrame, key: str, planes: np.ndarray, further: np.ndarray, probes: int, dim: int) -> DataFrame:
    """``key, vector, bucket, rest``: a row per table, and one per plane crossed.

    ``rest`` holds the sides of the further planes, the first in the highest bit.
    """
    kind, vector = (df.schema[c].dataType.simpleString() for c in (key, "vector"))    # numbers move as they are stored
    tables = len(planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                at, units = _unit_rows(batch.column(1), dim)
                if not len(at):
                    continue
                buckets, rest = _buckets(units, planes, probes), _sides(_scored(units, further))
                numbers = np.stack(buckets) + (np.arange(tables, dtype=np.int64) << 48)
                rows = pa.array(np.tile(np.repeat(at, tables), len(buckets)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(numbers.ravel()),
                     pa.array(np.tile(rest.ravel(), len(buckets)))], names=[key, "vector", "bucket", "rest"])

    return df.select(key, "vector").mapInArrow(run, f"{key} {kind}, vector {vector}, bucket long, rest long")


def _hot(counts: DataFrame, hot: DataFrame) -> DataFrame:
    """A table of hot buckets, broadcast where it is small."""
    return F.broadcast(hot) if counts.limit(HOT_BROADCAST + 1).count() <= HOT_BROADCAST else hot


def _cut(counts: DataFrame, bucket_rows: int) -> DataFrame:
    """Hot buckets with the further ``_planes`` that bring them to size."""
    return counts.where(F.col("n") > HOT * bucket_rows).select(
        "bucket", F.least(F.lit(FURTHER), F.ceil(F.log2(F.col("n") / bucket_rows))).cast("int").alias("_planes"))


def _refined(sides: list[DataFrame], counts: DataFrame, bucket_rows: int) -> list[DataFrame]:
    """Hot buckets cut by as many of the further planes as bring them to size."""
    cut = _cut(counts, bucket_rows)
    cut = _hot(cut, cut)
    side = F.call_function("shiftright", "rest", F.lit(FURTHER) - F.col("_planes"))
    return [s.join(cut, "bucket", "left").withColumn(
        "bucket", F.when(F.col("_planes").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", "_planes", side)))
        .drop("_planes", "rest") for s in sides]


def _sliced(asked: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a slice of each, every pair of slices of a bucket meeting once."""
    def slices(df: DataFrame, name: str) -> DataFrame:
        big = df.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > SLICE_ROWS)
        big = big.select("bucket", F.ceil(F.col("n") / SLICE_ROWS).cast("int").alias(name))
        return _hot(big, big)

    mine, theirs = slices(asked, "_qs"), slices(rows, "_ls")

    def placed(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        both = df.join(mine, "bucket", "left").join(theirs, "bucket", "left")
        n = {c: F.coalesce(F.col(c), F.lit(1)) for c in ("_qs", "_ls")}
        return both.withColumn(own[1:], F.pmod(F.xxhash64(key), n[own]).cast("int")) \
            .withColumn(other[1:], F.explode(F.sequence(F.lit(0), n[other] - 1))).drop("_qs", "_ls")

    return placed(asked, "query_id", "_qs", "_ls"), placed(rows, "row_id", "_ls", "_qs")


def _met_in_buckets(queries: DataFrame, rows: DataFrame, top_n: int, planes: np.ndarray, further: np.ndarray, probes: int, bucket_rows: int) -> DataFrame:
    """(query_id, row_id, distance): the best of every bucket, which is a task's."""
    dim, kind = planes.shape[2], queries.schema["query_id"].dataType.simpleString()
    dealt = _dealt(rows, "row_id", planes, further, 0, dim)
    asked = _dealt(queries, "query_id", planes, further, probes, dim)
    counts = dealt.groupBy("bucket").agg(F.count("*").alias("n"))
    asked, dealt = _sliced(*_refined([asked, dealt], counts, bucket_rows))

    def cell(lt: pa.Table, rt: pa.Table) -> pa.Table:
        fields = [lt.schema.field("query_id"), pa.field("row_id", pa.int64()), pa.field("distance", pa.float64())]
        if not (lt.num_rows and rt.num_rows):
            return pa.schema(fields).empty_table()
        at, units = _unit_rows(lt.column("vector"), dim)
        best = _Best(lt.column("query_id").combine_chunks().take(pa.array(at)), units, top_n, (), [])
        best.add(rt.append_column("time_period", pa.nulls(rt.num_rows, pa.int32())))
        found = best.result()
        return pa.schema(fields).empty_table() if found is None else found.select(["query_id", "row_id", "distance"])

    cells = ["bucket", "qs", "ls"]
    return asked.groupBy(*cells).cogroup(dealt.groupBy(*cells)).applyInArrow(cell, f"query_id {kind}, row_id long, distance double")


def _grid(asked: int, stored: int, tables: int, probes: int, dim: int, cores: int) -> tuple[int, int] | None:
    """Blocks of queries and slices of rows, or None where copies for every bucket are fewer than those for every block."""
    block = max(1, BLOCK_BYTES // (8 * dim))
    blocks = max(-(-asked // block), min(2 * cores, -(-asked // BUCKET_ROWS)), 1)
    slices = max(-(-stored // (SLICE_BLOCKS * block)), 1)
    return (blocks, slices) if asked * slices + stored * blocks <= tables * (asked * (1 + probes) + stored) else None


def _bucket_counts(rows: DataFrame, planes: np.ndarray) -> DataFrame:
    """(bucket, n) of rows, counted where they lie."""
    dim = planes.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                _, units = _unit_rows(whole.slice(start, 2000).column(0), dim)
                numbers = _sides(_scored(units, planes)) + (np.arange(len(planes), dtype=np.int64) << 48)
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in np.unique(numbers, return_counts=True)], names=["bucket", "n"])

    return rows.select("vector").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _met_in_blocks(queries: DataFrame, rows: DataFrame, top_n: int, planes: np.ndarray, further: np.ndarray, probes: int, bucket_rows: int,
                   grid: tuple[int, int]) -> DataFrame:
    """(query_id, row_id, distance): the best of a slice of rows over its buckets of all tables, each vector moved once a block or slice."""
    (tables, bits, dim), (blocks, slices) = planes.shape, grid
    kind = queries.schema["query_id"].dataType.simpleString()
    hot: list[dict[int, int]] = [{} for _ in range(tables)]
    if bits:    # without planes all is one bucket of every table
        for r in _cut(_bucket_counts(rows, planes), bucket_rows).collect():    # fewer than tables x rows / (HOT x bucket_rows)
            hot[r["bucket"] >> 48][r["bucket"] & ((1 << 48) - 1)] = r["_planes"]

    def numbered(units: np.ndarray, t: int, probes: int) -> np.ndarray:
        """(probe, row): the buckets of one table, hot ones cut by further planes."""
        out = []
        codes, cuts = np.array(sorted(hot[t]), np.int64), np.array([hot[t][c] for c in sorted(hot[t])], np.int64)
        for start in range(0, len(units), 20_000):
            part = units[start:start + 20_000]
            found = np.stack(_buckets(part, planes[t:t + 1], probes))[:, :, 0]
            inner = np.zeros_like(found)
            if len(codes):
                rest = _sides(_scored(part, further[t:t + 1]))[:, 0]
                at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
                inner = np.where(codes[at] == found, rest >> (FURTHER - cuts[at]), 0)
            out.append((found << FURTHER) + inner)
        return np.concatenate(out, axis=1)

    def cell(lt: pa.Table, rt: pa.Table) -> pa.Table:
        fields = [lt.schema.field("query_id"), pa.field("row_id", pa.int64()), pa.field("distance", pa.float64())]
        none = pa.schema(fields).empty_table()
        if not (lt.num_rows and rt.num_rows):
            return none
        at, units = _unit_rows(lt.column("vector"), dim)
        own, stored = _unit_rows(rt.column("vector"), dim)
        if not (len(at) and len(own)):
            return none
        best = _Best(lt.column("query_id").combine_chunks().take(pa.array(at)), units, top_n, (), [], True)
        ids = rt.column("row_id").combine_chunks().take(pa.array(own)).to_numpy(zero_copy_only=False)
        del lt, rt
        for t in range(tables if bits else 1):
            theirs = numbered(stored, t, 0)[0]
            order = np.argsort(theirs, kind="stable")
            codes, first = np.unique(theirs[order], return_index=True)
            ends = np.append(first[1:], len(order))
            mine = numbered(units, t, probes)
            place = np.searchsorted(codes, mine)
            there = codes[np.minimum(place, len(codes) - 1)] == mine
            place, asks = place[there], np.broadcast_to(np.arange(len(units)), mine.shape)[there]
            turn = np.argsort(place, kind="stable")
            place, asks = place[turn], asks[turn]
            for bucket, start, end in zip(*_runs(place)):
                for a in range(first[bucket], ends[bucket], _BATCH):
                    chosen = order[a:min(a + _BATCH, ends[bucket])]
                    best.look(stored[chosen], ids[chosen], np.full(len(chosen), np.nan), chosen, np.zeros(1, np.int64), asks[start:end])
                    best.settle()
        found = best.result()
        return none if found is None else found.select(["query_id", "row_id", "distance"])

    def spread(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key, "vector"), F.lit(n)).cast("int")    # ids may repeat

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select("query_id", "vector", spread("query_id", blocks).alias("_q")).withColumn("_l", every(slices))
    right = rows.select("row_id", "vector", spread("row_id", slices).alias("_l")).withColumn("_q", every(blocks))
    cells = ["_q", "_l"]
    return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(cell, f"query_id {kind}, row_id long, distance double")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each value of a sorted array with its first place and the place after its last."""
    found, first = np.unique(values, return_index=True)
    return found, first, np.append(first[1:], len(values))


def approximate_neighbours(queries: DataFrame, lexicon: DataFrame, top_n: int = 10, tables: int = TABLES,
                           bucket_rows: int = BUCKET_ROWS, probes: int = 3, seed: int = 0, dim: int | None = None, asked: int | None = None) -> DataFrame:
    """(query_id, rank, row_id, distance, similarity) of rows near each query, nearest first.

    ``queries``: (query_id, vector), ``asked`` of them, ``lexicon``: (row_id, vector), a stored table.
    More tables, larger buckets and more probes find more and cost more.
    """
    dim = dim or _dimension(lexicon)
    equal = Window.partitionBy("vector").orderBy("row_id")
    rows = lexicon.select(F.col("row_id").cast("long").alias("row_id"), "vector").where(F.col("vector").isNotNull()) \
        .withColumn("_n", F.row_number().over(equal)).where(F.col("_n") <= top_n).drop("_n")
    stored = lexicon.count()
    bits = max(0, math.ceil(math.log2(max(1, stored) / bucket_rows)))
    rng = np.random.default_rng(seed)
    planes, further = rng.normal(size=(tables, bits, dim)), rng.normal(size=(tables, FURTHER, dim))
    grid = _grid(queries.count() if asked is None else asked, stored, tables, probes, dim, lexicon.sparkSession.sparkContext.defaultParallelism)
    found = _met_in_blocks(queries, rows, top_n, planes, further, probes, bucket_rows, grid) if grid \
        else _met_in_buckets(queries, rows, top_n, planes, further, probes, bucket_rows)
    order = Window.partitionBy("query_id").orderBy("distance", "row_id")
    # One exchange on the query serves both the doubles of several tables and the ranks.
    ranked = found.repartition("query_id").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    return ranked.select("query_id", "rank", "row_id", "distance", (F.lit(1.0) - F.col("distance")).alias("similarity"))


def approximate_with_coverage(queries: DataFrame, lexicon: DataFrame, top_n: int = 10, periods: tuple[int, ...] = fixed.ANCHOR_PERIODS,
                              keep: tuple[str, ...] = (), dim: int | None = None, **settings) -> DataFrame:
    """As ``nearest_with_coverage``, from buckets: each anchor period is searched by itself too, so it is covered.

    A period of few rows has no planes and is searched whole, so a rare period is never missed.
    """
    rows = lexicon.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("time_period").cast("int").alias("time_period"), "vector", *keep)
    dim = dim or _dimension(rows)
    settings = {"asked": queries.count(), "dim": dim, **settings}
    found = [approximate_neighbours(queries, rows, top_n + len(periods), **settings)]
    found += [approximate_neighbours(queries, rows.where(F.col("time_period") == p), 1, **settings) for p in periods]
    near = reduce(DataFrame.unionByName, [f.select("query_id", "row_id", "distance") for f in found]).distinct()
    ranked = _rank(near.join(rows.drop("vector"), "row_id"), top_n, periods)
    return ranked.select("query_id", "rank", "row_id", "time_period", "distance", (F.lit(1.0) - F.col("distance")).alias("similarity"), *keep)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: pairs of the exact answer, and the share of them that was found."""
    hits = exact.select("query_id", "row_id").join(found.select("query_id", "row_id", F.lit(1).alias("hit")), ["query_id", "row_id"], "left")
    return hits.agg(F.count("*").alias("pairs"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
