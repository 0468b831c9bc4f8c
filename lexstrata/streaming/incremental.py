"""Restartable runs over folders that grow.

Progress lives in the query's checkpoint, so a run that is stopped goes on with
the files it has not finished. A batch is landed as one commit over all its sinks
(``sources.landing``), so a batch that runs again replaces itself everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.landing import land_batch_once, settle

KEPT_POINTS = 3
_RETAIN = "spark.sql.streaming.minBatchesToRetain"


def run_available(spark: SparkSession, source: str, schema: T.StructType, handle: Callable[[DataFrame, int], None],
                  checkpoint: str, fmt: str = "parquet", files_per_batch: int = 100, kept_points: int = KEPT_POINTS) -> StreamingQuery:
    """Hand every new file to ``handle(batch, batch_id)`` and stop when none is left.

    The last ``kept_points`` progress points (two at least) stay on disk. A run that breaks off inside
    a batch hands that batch over again when it is started anew.
    """
    before = spark.conf.get(_RETAIN, None)
    spark.conf.set(_RETAIN, max(1, kept_points - 1))    # besides the one in progress
    try:
        stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(source)
        query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint) \
            .trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_RETAIN)
        else:
            spark.conf.set(_RETAIN, before)
    return query


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Land a batch under its number; a repeated batch replaces itself, also with no rows."""
    land_batch_once(df, path, batch_id, {"rows": path})


def run_increments(spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame],
                   target: str, checkpoint: str, quarantine: str | None = None, fmt: str = "parquet",
                   files_per_batch: int = 100, kept_points: int = KEPT_POINTS) -> StreamingQuery:
    """Transform new files batch by batch into ``target``.

    With ``quarantine``, rows whose ``status`` is 'failed' go there instead, in the same commit.
    """
    settle(spark, target)

    def handle(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch)
        if quarantine is None:
            append_batch(out, target, batch_id)
            return
        failed = F.coalesce(F.col("status"), F.lit("")) == "failed"
        land_batch_once(out, target, batch_id, {"rows": target, "failed": quarantine}, F.when(failed, "failed").otherwise("rows"))

    return run_available(spark, source, schema, handle, checkpoint, fmt, files_per_batch, kept_points)


def with_status(df: DataFrame, ok: Column, error: Column) -> DataFrame:
    """Mark rows as processed or failed, with the reason, instead of ending the run."""
    return df.withColumns({
        "status": F.when(F.coalesce(ok, F.lit(False)), F.lit("processed")).otherwise(F.lit("failed")),
        "error": F.when(~F.coalesce(ok, F.lit(False)), error),
    })
