"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


TASK_LINKS = 500_000


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder that the session names, so that a lost executor costs nothing."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """The links of each task as stars around the smallest node that the task can reach."""
    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        stars = [(x, find(x)) for x in root]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, r in stars if x != r], pa.int64()),
                                          pa.array([r for x, r in stars if x != r], pa.int64())], names=["a", "b"])

    return edges.coalesce(tasks).mapInArrow(run, "a long, b long")


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``node, component`` of every node of ``a, b`` links; the component is its smallest node.

    Tasks first contract up to about ``task_links`` links each to stars, which
    shuffles nothing; then rounds of alternating stars join what different tasks
    hold, a few joins and sums on a node's id. A node with very many links is
    pre-aggregated and its join can be split. Rounds grow as the logarithm of the
    longest chain.
    """
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    edges = saved(links.where("a <> b").select("a", "b"))
    before, tasks = None, -(-edges.count() // task_links)
    if tasks:
        edges = saved(_contracted(edges, tasks))
    while tasks > 1:
        edges = saved(_small_star(_large_star(edges)))
        now = edges.select(mark).first()
        if now == before:
            break
        before = now
    own = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return own.unionByName(own.select(F.col("component").alias("node"), "component").distinct())
