"""Keep-first selections, numbering, batches, top-n and sampling."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import land, shuffle_partitions


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the first in ``order``, which must be total within a key.

    The filter sits on the window, so each task keeps one row per key before the
    shuffle and a hot key costs no more than the number of tasks.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def keep_smallest(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per key: the smallest when ordered by all columns, nulls last."""
    return keep_first(df, keys, [F.asc_nulls_last(c) for c in columns or df.columns])


def sort_nulls_last(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*[F.asc_nulls_last(c) for c in columns])


def smallest(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    """The n smallest; missing values only when nothing else is left."""
    return df.orderBy(F.asc_nulls_last(F.nanvl(F.col(column), F.lit(None))), F.asc(tie)).limit(n)


def first_n(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


_SORTED = 100_000    # rows of one digest range that are few enough to be cut exactly


def _range_with(keyed: DataFrame, n: int, width: int = 3) -> tuple[str, int]:
    """The digest prefix in whose range the n-th row lies, and how many rows come before that range.

    Ranges are counted, 16^``width`` at a time, and the one with the n-th row is counted
    on until it is small: no rows are sorted.
    """
    prefix, before = "", 0
    while True:
        size = len(prefix) + width
        counts = keyed.where(F.col("_digest").startswith(prefix)).groupBy(F.left("_digest", F.lit(size)).alias("p")).agg(F.count("*").alias("rows"))
        for r in sorted(counts.collect()):    # at most 16^width rows
            if before + r["rows"] >= n:
                break
            before += r["rows"]
        prefix = r["p"]
        if r["rows"] <= _SORTED or size >= 32:
            return prefix, before


def sample_n(df: DataFrame, n: int | None, row_id: str, seed: int = 42) -> DataFrame:
    """Exactly n rows without replacement, the same ones on every run; 0 and None give all rows.

    Rows with the n least digests of their id: a threshold is found by counting digest
    ranges and cutting one small range, and every task then keeps what is below it.
    ``row_id`` is unique; fewer rows than n are all given.
    """
    if not n:
        return df
    digest = F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed))))
    keyed = df.select(digest.alias("_digest"), row_id)
    if keyed.limit(n + 1).count() <= n:
        return df
    prefix, before = _range_with(keyed, n)
    cut = keyed.where(F.col("_digest").startswith(prefix)).orderBy("_digest", row_id).limit(n - before) \
        .agg(F.max(F.struct("_digest", row_id)).alias("m")).first()["m"]
    return df.where((digest < cut["_digest"]) | ((digest == cut["_digest"]) & (F.col(row_id).isNull() | (F.col(row_id) <= F.lit(cut[row_id])))))


def with_position(df: DataFrame, order: str, out: str = "position", slices: int | None = None) -> DataFrame:
    """Dense global positions 0, 1, 2, ... in the order of a unique column.

    The range of a number is cut at approximate quantiles; rows of any other kind
    are dealt out by range and landed, so that their slices stay as they are. Rows
    are numbered inside each slice and the slice's offset is added, so no task sees
    the whole table. Only the cuts and one offset per slice leave the tasks.
    """
    slices = slices or 4 * shuffle_partitions(df.sparkSession)
    if isinstance(df.schema[order].dataType, T.NumericType):
        points = [i / slices for i in range(1, slices)]
        cuts = sorted(set(df.approxQuantile(order, points, 0.2 / slices))) if points else []
        bounds = [-float("inf"), *(cuts or [0.0]), float("inf")]
        sliced = Bucketizer(splits=bounds, inputCol="_at", outputCol="_slice") \
            .transform(df.withColumn("_at", F.col(order).cast("double"))).drop("_at")
    else:
        sliced = land(df.repartitionByRange(slices, order).withColumn("_slice", F.spark_partition_id()), "positions")
    counts = sliced.groupBy("_slice").agg(F.count("*").alias("n"))
    offsets = counts.withColumn(
        "before", F.coalesce(F.sum("n").over(
            Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    table = offsets.agg(F.map_from_entries(F.collect_list(F.struct("_slice", "before"))).alias("m")).scalar()
    w = Window.partitionBy("_slice").orderBy(order)
    return sliced.withColumn(
        out, F.row_number().over(w) - 1 + F.element_at(table, F.col("_slice"))).drop("_slice")


def with_batches(df: DataFrame, size: int, position: str = "position", out: str = "batch") -> DataFrame:
    """Fixed-size batches of consecutive positions, numbered from 0."""
    return df.withColumn(out, F.floor(F.col(position) / size).cast("long"))


def with_chunks(df: DataFrame, size: int, order: str) -> DataFrame:
    """Chunk number, number of chunks and rows in the chunk of every row."""
    placed = with_position(df, order)
    total = df.agg(F.count("*").alias("n")).scalar()
    number = F.floor(F.col("position") / size) + 1
    return placed.select(
        *df.columns,
        number.cast("long").alias("chunk_number"),
        F.ceil(total / size).cast("long").alias("total_chunks"),
        F.least(F.lit(size), total - (number - 1) * size).cast("long").alias("words_in_chunk"),
    )
