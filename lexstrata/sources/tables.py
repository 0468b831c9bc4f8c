"""Landed tables and sinks. Parquet is the working format; CSV is an edge format."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import first_n, with_chunks
from .landing import land_batch_once


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        return len(spark.read.parquet(path).columns) > 0
    except AnalysisException:
        return False


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], limit: int | None = None,
                  order: str = "page_id", refresh: bool = False) -> DataFrame:
    """The landed table if it has rows, else build and land it; ``limit`` only cuts the result."""
    if refresh or not table_exists(spark, path) or spark.read.parquet(path).isEmpty():
        build().write.mode("overwrite").parquet(path)
    return first_n(spark.read.parquet(path), limit, order)


def save_table(df: DataFrame, path: str, raw_path: str | None = None, fmt: str = "parquet") -> str:
    """Write the table (and its raw copy). An empty table writes nothing: 'no data'."""
    if df.isEmpty():
        return "no data"
    options = {"header": True, "quote": '"', "escape": '"'} if fmt == "csv" else {}
    df.write.mode("overwrite").options(**options).format(fmt).save(path)
    if raw_path is not None:
        # The copy is made from the written table where that loses nothing.
        source = df.sparkSession.read.parquet(path) if fmt == "parquet" else df
        source.write.mode("overwrite").options(**options).format(fmt).save(raw_path)
    return "saved"


def land_batch(df: DataFrame, path: str, batch_id: int, language: str) -> None:
    """Land a raw batch in one commit; landing the same batch again replaces it, also with no rows."""
    name = re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda c: f"%{ord(c[0]):02X}", language)    # as Spark names folders
    place = f"{path}/language={name}"
    land_batch_once(df.withColumn("ingested_at", F.current_timestamp()), place, batch_id, {"rows": place})


def save_chunks(df: DataFrame, path: str, order: str, chunk_rows: int = 10_000) -> None:
    """Write rows with their chunk columns, in files of a chunk's rows at most.

    The chunk's number is a column and not a folder, so the number of folders does
    not grow with the table; files are few per task.
    """
    with_chunks(df, chunk_rows, order).withColumn("saved_at", F.current_timestamp()) \
        .write.mode("overwrite").option("maxRecordsPerFile", max(chunk_rows, 1_000_000)).parquet(path)


def compact_chunks(spark: SparkSession, path: str, target: str, files: int | None = None) -> int:
    """Rewrite all chunks as one table and return its rows.

    The chunks are left in place; ``drop_chunks`` removes them once the counts
    agree.
    """
    chunks = spark.read.parquet(path)
    out = chunks.drop("chunk_number", "total_chunks", "words_in_chunk", "saved_at")
    (out.coalesce(files) if files else out).write.mode("overwrite").parquet(target)
    total, written = chunks.count(), spark.read.parquet(target).count()
    if total != written:
        raise RuntimeError(f"{total} rows in the chunks, {written} in the compacted table")
    return written


def drop_chunks(spark: SparkSession, path: str, target: str) -> bool:
    """Remove the chunks if the compacted table has all their rows."""
    if spark.read.parquet(path).count() != spark.read.parquet(target).count():
        return False
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True))
