"""Landing that counts once: a batch is one commit, over all its sinks.

A batch is written to a fresh hidden folder first, all its sinks in one write, so each
row is computed once and is in one sink. Then one small commit file is put in place by a
rename, which either happens or does not; from then on the batch is what that file says,
whatever ran before. Only then are the written folders moved to where plain readers look
(``sink/batch_id=7``); a run that breaks off in between leaves that to the next one
(``settle``). A batch landed again replaces itself in every sink, also where it brings
fewer rows or none.

    place/_commits/<batch>.<attempt>     what the batch consists of
    place/_attempts/<attempt>/_sink=...   written, not yet moved
    sink/batch_id=<batch>/               moved
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Store:
    """Folders and small files of the file system that a path belongs to."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._io = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(path))] if self.exists(path) else []

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def move(self, path: str, to: str) -> None:
        self._fs.mkdirs(self._path(to).getParent())
        if not self._fs.rename(self._path(path), self._path(to)):
            raise OSError(f"{path} could not be moved to {to}")

    def write(self, path: str, text: str) -> None:
        """The whole file or none: written aside, then renamed."""
        aside = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(aside), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.move(aside, path)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()


def _commits(store: Store, place: str) -> dict[int, tuple[int, str]]:
    """The last attempt of each batch: its number and file name."""
    last: dict[int, tuple[int, str]] = {}
    for name in store.names(f"{place}/_commits"):
        batch, _, attempt = name.partition(".")
        if batch.lstrip("-").isdigit() and attempt.isdigit():
            last[int(batch)] = max(last.get(int(batch), (-1, "")), (int(attempt), name))
    return last


def _publish(store: Store, place: str, batch_id: int, commit: dict) -> None:
    """Move what a committed attempt wrote to where readers look. May be repeated at any point."""
    written = f"{place}/_attempts/{commit['attempt']}"
    if not store.exists(written):
        return    # done before
    for sink, path in commit["sinks"].items():
        shown, new = f"{path}/batch_id={batch_id}", f"{written}/_sink={sink}"
        # A moved sink is no longer among the attempts, so what is shown is not deleted again.
        if store.exists(new):
            store.delete(shown)
            store.move(new, shown)
        elif sink in commit["empty"]:
            store.delete(shown)
    store.delete(written)


def settle(spark: SparkSession, place: str) -> None:
    """Finish batches that were committed but not wholly moved; drop attempts that never were committed."""
    store = Store(spark, place)
    attempts = store.names(f"{place}/_attempts")
    if not attempts:    # all is settled, however many batches there are
        return
    known = set()
    for batch_id, (_, name) in sorted(_commits(store, place).items()):
        commit = json.loads(store.read(f"{place}/_commits/{name}"))
        known.add(commit["attempt"])
        _publish(store, place, batch_id, commit)
    for attempt in attempts:
        if attempt not in known:
            store.delete(f"{place}/_attempts/{attempt}")


def land_batch_once(df: DataFrame, place: str, batch_id: int, sinks: dict[str, str], sink: Column | None = None) -> None:
    """Land ``df`` as batch ``batch_id``, each row in the sink that ``sink`` names (the only one, when there is one).

    ``sinks``: name to path. Everything known of batches lies under ``place``.
    """
    spark = df.sparkSession
    store = Store(spark, place)
    settle(spark, place)
    attempt = uuid.uuid4().hex
    written = f"{place}/_attempts/{attempt}"
    named = sink if sink is not None else F.lit(next(iter(sinks)))
    df.withColumn("_sink", named).write.partitionBy("_sink").parquet(written)
    there = {n.partition("=")[2] for n in store.names(written) if n.startswith("_sink=")}
    if not there <= set(sinks):
        store.delete(written)
        raise ValueError(f"rows for unknown sinks: {sorted(there - set(sinks))}")
    number, old = _commits(store, place).get(batch_id, (-1, ""))
    commit = {"attempt": attempt, "sinks": sinks, "empty": sorted(set(sinks) - there)}
    store.write(f"{place}/_commits/{batch_id}.{number + 1}", json.dumps(commit))
    _publish(store, place, batch_id, commit)
    if old:
        store.delete(f"{place}/_commits/{old}")


def read_landed(spark: SparkSession, path: str, schema: T.StructType, place: str | None = None) -> DataFrame:
    """The rows of one sink with their ``batch_id``, by the commits: whole batches only, moved or not.

    All moved batches are one read; only those still waiting to be moved are read by themselves.
    """
    place = place or path
    store = Store(spark, place)
    moved, waiting = [], []
    for batch_id, (_, name) in sorted(_commits(store, place).items()):
        commit = json.loads(store.read(f"{place}/_commits/{name}"))
        for sink, shown in commit["sinks"].items():
            if shown == path and sink not in commit["empty"]:
                written = f"{place}/_attempts/{commit['attempt']}/_sink={sink}"
                if store.exists(written):
                    waiting.append((batch_id, written))
                else:
                    moved.append(f"{shown}/batch_id={batch_id}")
    whole = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    parts = [spark.read.schema(whole).option("basePath", path).parquet(*moved)] if moved else []
    parts += [spark.read.schema(schema).parquet(p).withColumn("batch_id", F.lit(b).cast("long")) for b, p in waiting]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], whole)
