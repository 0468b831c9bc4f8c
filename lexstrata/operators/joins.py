"""Equi-joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from ..session import shuffle_partitions


def hot_keys(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Keys holding more than 1/parts of the rows, null among them, with the slices each needs.

    At most ``parts`` rows come out, and their slices add up to at most twice that.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    share = F.col("n") * parts / total
    return counts.where(share > 1).select(key, F.ceil(share).cast("int").alias("_slices"))


def _with_slices(df: DataFrame, hot: list[Row], found: DataFrame, key: str) -> DataFrame:
    """The rows with the ``_slices`` of their key, null where it is not hot; numbers and strings need no join for that."""
    kinds = (df.schema[key].dataType, found.schema[key].dataType)
    if kinds[0] != kinds[1] or not isinstance(kinds[0], (LongType, IntegerType, StringType)):
        return df.join(F.broadcast(df.sparkSession.createDataFrame(hot, found.schema)), key, "left")
    keys: dict[int, list] = {}
    for r in hot:
        keys.setdefault(r["_slices"], []).append(r[key])
    told = F.lit(None).cast("int")
    for n, own in sorted(keys.items()):
        told = F.when(F.col(key).isin(own), F.lit(n)).otherwise(told)
    return df.withColumn("_slices", told)


def lookup(left: DataFrame, right: DataFrame, key: str, spread: Column | str, how: str = "left",
           parts: int | None = None) -> DataFrame:
    """Join a large table to a table with one row per ``key``, slicing hot keys.

    A key with more than its share of rows is cut into slices by ``spread`` (any
    column that varies inside a key) and its one right row is copied per slice,
    so no task gets more than about 1/parts of the left rows. Rows without a key
    meet nothing and are sliced likewise. The keys are counted first, by a job
    over the key column alone; without a hot one this is a plain join.
    """
    spark = left.sparkSession
    parts = parts or 4 * shuffle_partitions(spark)
    found = hot_keys(left, key, parts)
    rows = found.collect()    # at most ``parts`` rows
    if not rows:
        return left.join(right, key, how)
    hot = [r for r in rows if r[key] is not None]
    spread = F.col(spread) if isinstance(spread, str) else spread
    slices = F.when(F.col(key).isNull(), F.lit(parts)).otherwise(F.col("_slices"))
    slice_no = F.coalesce(F.pmod(F.xxhash64(spread), slices), F.lit(0)).cast("int")
    sliced = _with_slices(left, hot, found, key).withColumn("_slice", slice_no).drop("_slices")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1))
    copied = _with_slices(right, hot, found, key).withColumn("_slice", copies).drop("_slices")
    return sliced.join(copied, [key, "_slice"], how).drop("_slice")


def not_done(df: DataFrame, done: DataFrame, key: str, spread: str | None = None) -> DataFrame:
    """Rows whose key is not in the table of finished work.

    ``spread`` names a column that varies inside a key, for keys that may be hot.
    """
    keys = done.select(key).distinct()
    if spread is None:
        return df.join(keys, key, "left_anti")
    return lookup(df, keys.withColumn("_done", F.lit(True)), key, spread).where(F.col("_done").isNull()).drop("_done")


def chosen(df: DataFrame, picks: DataFrame, key: str, spread: str | None = None) -> DataFrame:
    """Rows whose key was chosen; ``spread`` as above."""
    keys = picks.select(key).distinct()
    return df.join(keys, key, "left_semi") if spread is None else lookup(df, keys, key, spread, "inner")
