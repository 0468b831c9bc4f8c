"""Session helpers: shared scratch space and bounded collection."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN_DIR = "lexstrata.scratch.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexstrata")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; on a single machine it is made where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_DIR, None)
    if not named:
        master = spark.conf.get("spark.master", "local")
        if not master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lexstrata-")
        spark.conf.set(_OWN_DIR, named)    # the setting of the cluster cannot be changed in a running session
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def collect_if_small(df: DataFrame, budget: int, vector: str, row_bytes: int) -> pa.Table | None:
    """All rows when their vectors and other columns are within ``budget`` bytes, else None.

    Rows are counted first: that costs little on a stored table and keeps a large
    one off the driver. Only a table that passes is measured and fetched.
    """
    if df.count() * row_bytes > budget:
        return None
    others = F.octet_length(F.to_json(F.struct(*[c for c in df.columns if c != vector])))
    size = df.agg(F.sum(F.greatest(F.size(vector), F.lit(0)) * 8 + others).alias("n")).first()["n"]
    return df.toArrow() if (size or 0) <= budget else None


def land(df: DataFrame, name: str) -> DataFrame:
    """The rows written once under the shared folder, for jobs that read them more than once.

    They stay there as long as results that read them may be used; who owns the
    session clears the shared folder afterwards (a lifetime rule of the store, or a
    folder per run).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
