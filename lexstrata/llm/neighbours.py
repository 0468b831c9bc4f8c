"""Approximate nearest neighbours: a navigable small-world graph per shard.

Distinct vectors are dealt into shards of about ``SHARD_ROWS`` by hash. Each shard
becomes one row: its vectors and, per layer, the nodes and their neighbours as one
flat array. Queries visit every shard of their length: a task reads its shard's graph
once and answers the queries that stream by behind it, so an index is never copied.
A shard answers with its nearest, and the answers are merged by distance. Distances are Euclidean,
in double precision, on the vectors as given.

Equal vectors are one node that carries its ``k + 1`` smallest ids, enough for any
answer of ``k`` and for leaving out the query itself, so a vector that a third of
all rows share is found as one.

Defined results: vectors that are null, empty, zero or hold a null or a number that
is not finite neither ask nor answer; vectors are compared only with those of their
own length; equal distances go to the smaller id; a null id takes no part; repeated
rows are one; of several vectors of one id the nearest answers; with fewer than
``k`` others all are given; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import saved
from .words import bounded_batches

K = 10
SHARD_ROWS = 4000
LINKS = 16             # neighbours of a new node; twice as many are kept in the lowest layer
BUILD_WIDTH = 64       # nodes held while a new node is placed
SEARCH_WIDTH = 160     # nodes held while a query is answered


class Graph:
    """Layers of flat neighbour arrays over the rows of ``vectors``."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], entry: int):
        self.vectors, self.layers, self.entry = vectors, layers, entry
        self.row_of = [dict(zip(nodes.tolist(), range(len(nodes)))) if i else None for i, (nodes, _) in enumerate(layers)]

    def around(self, node: int, layer: int) -> np.ndarray:
        near = self.layers[layer][1][node if layer == 0 else self.row_of[layer][node]]
        return near[near >= 0]

    def distances(self, point: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        gap = self.vectors[nodes] - point
        return np.einsum("ij,ij->i", gap, gap)

    def walk(self, point: np.ndarray, entry: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        """The nearest ``width`` nodes that a best-first walk finds, with squared distances, nearest first."""
        seen = np.zeros(len(self.vectors), bool)
        seen[entry] = True
        start = list(zip(self.distances(point, np.array(entry)).tolist(), entry))
        ahead, held = sorted(start), [(-d, n) for d, n in start]
        heapq.heapify(held)
        while ahead:
            d, node = heapq.heappop(ahead)
            if d > -held[0][0] and len(held) >= width:
                break
            near = self.around(node, layer)
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            found = self.distances(point, near)
            if len(held) >= width:
                close = found < -held[0][0]
                found, near = found[close], near[close]
            for d, n in zip(found.tolist(), near.tolist()):
                if len(held) < width:
                    heapq.heappush(held, (-d, n))
                elif d < -held[0][0]:
                    heapq.heapreplace(held, (-d, n))
                else:
                    continue
                heapq.heappush(ahead, (d, n))
        return sorted((-d, n) for d, n in held)

    def descend(self, point: np.ndarray, to_layer: int) -> int:
        node = self.entry
        for layer in range(len(self.layers) - 1, to_layer, -1):
            node = self.walk(point, [node], 1, layer)[0][1]
        return node

    def nearest(self, point: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
        return np.array([n for _, n in self.walk(point, [self.descend(point, 0)], width, 0)])


def _spread_out(vectors: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
    """Nodes nearer to the point than to any node chosen before, filled up with the nearest of the rest."""
    nodes = np.array([n for _, n in found])
    if len(nodes) <= most:
        return nodes.tolist()
    to_point = np.array([d for d, _ in found])
    points = vectors[nodes]
    squares = np.einsum("ij,ij->i", points, points)
    between = squares[:, None] + squares[None] - 2 * points @ points.T
    chosen: list[int] = []
    least = np.full(len(nodes), np.inf)
    for i in range(len(nodes)):
        if to_point[i] < least[i]:
            chosen.append(i)
            if len(chosen) == most:
                break
            least = np.minimum(least, between[i])
    rest = [i for i in range(len(nodes)) if i not in set(chosen)]
    return nodes[(chosen + rest)[:most]].tolist()


def build(vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH) -> Graph:
    """Nodes are placed one after another, each in a random number of layers."""
    n = len(vectors)
    heights = (-np.log(1 - np.random.default_rng(n).random(n)) / np.log(links)).astype(int)
    layers = []
    for layer in range(int(heights.max()) + 1):
        nodes = np.flatnonzero(heights >= layer)
        layers.append((nodes, np.full((len(nodes), links * (2 if layer == 0 else 1)), -1, np.int32)))
    graph = Graph(vectors, layers[:heights[0] + 1], 0)
    whole = Graph(vectors, layers, 0)
    for node in range(1, n):
        point, top = vectors[node], int(heights[node])
        at = [graph.descend(point, min(top, len(graph.layers) - 1))]
        for layer in range(min(top, len(graph.layers) - 1), -1, -1):
            found = graph.walk(point, at, width, layer)
            at = [m for _, m in found]
            table = layers[layer][1]
            row = (lambda m: m) if layer == 0 else whole.row_of[layer].__getitem__
            chosen = _spread_out(vectors, found, links)
            table[row(node), :len(chosen)] = chosen
            for other in chosen:
                own = table[row(other)]
                free = np.flatnonzero(own < 0)
                if len(free):
                    own[free[0]] = node
                else:
                    every = np.append(own, node)
                    ranked = sorted(zip(graph.distances(vectors[other], every).tolist(), every.tolist()))
                    own[:] = _spread_out(vectors, ranked, len(own))
        if top >= len(graph.layers):
            graph = Graph(vectors, layers[:top + 1], node)
    return graph


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def distinct_vectors(vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``v, ids``: every usable vector once, with its ``k + 1`` smallest ids."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")) \
        .where(_usable(F.col("v")) & F.col("id").isNotNull()).select("id", F.transform("v", lambda x: x + 0.0).alias("v"))
    first = Window.partitionBy("v").orderBy("id")    # the limit keeps k + 1 ids a key in each task before the shuffle
    return rows.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1) \
        .groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))


_INDEX = "shard long, dim int, n int, entry int, ids array<array<long>>, vectors binary, nodes array<binary>, links array<binary>"


def build_index(nodes: DataFrame, shards: int, links: int = LINKS, width: int = BUILD_WIDTH) -> DataFrame:
    """One row per shard and vector length."""
    def made(key, table):
        table = table.combine_chunks()
        order = np.argsort([ids[0].as_py() for ids in table["ids"].combine_chunks()], kind="stable")
        table = table.take(pa.array(order))
        dim = key[1].as_py()
        flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        graph = build(flat, links, width)
        row = {"shard": [key[0].as_py()], "dim": [dim], "n": [len(flat)], "entry": [graph.entry], "ids": [table["ids"].to_pylist()],
               "vectors": [flat.tobytes()], "nodes": [[a.astype(np.int32).tobytes() for a, _ in graph.layers]],
               "links": [[b.tobytes() for _, b in graph.layers]]}
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.list_(pa.binary()),
                 pa.list_(pa.binary())]
        return pa.table([pa.array(v, k) for v, k in zip(row.values(), kinds)], names=list(row))

    dealt = nodes.select(F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"), F.size("v").alias("dim"), "v", "ids")
    return dealt.groupBy("shard", "dim").applyInArrow(made, _INDEX)


def read_graph(row: dict) -> Graph:
    nodes = [np.frombuffer(b, np.int32) for b in row["nodes"]]
    links = [np.frombuffer(b, np.int32).reshape(len(a), -1) for a, b in zip(nodes, row["links"])]
    return Graph(np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dim"]), list(zip(nodes, links)), row["entry"])


def nearest(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = K,
            shard_rows: int = SHARD_ROWS, width: int = SEARCH_WIDTH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of the rows that ``queries`` marks."""
    nodes = saved(distinct_vectors(vectors, key, vector, k))
    shards = max(1, -(-nodes.count() // shard_rows))
    index = saved(build_index(nodes, shards))
    asked = vectors.where(queries).select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v")) \
        .where(_usable(F.col("v")) & F.col("query_id").isNotNull()).dropDuplicates(["query_id", "v"])
    asked = saved(asked).select("query_id", "v", F.size("v").alias("dim"))
    sent = asked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    # A shard's graph goes to one task, before its queries; only queries are copied.
    both = index.unionByName(sent, allowMissingColumns=True).repartition(shards, "shard") \
        .sortWithinPartitions("shard", "dim", F.asc_nulls_first("query_id"))
    bounded_batches(both.sparkSession)
    names = ["query_id", "vec_id", "score"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, ids, at = None, [], None
        for batch in batches:
            of = list(zip(batch["shard"].to_pylist(), batch["dim"].to_pylist()))
            asking, points = batch["query_id"].to_pylist(), batch["v"]
            out: list[list] = [[], [], []]
            for i, query in enumerate(asking):
                if query is None:
                    row = batch.slice(i, 1).to_pylist()[0]
                    graph, ids, at = read_graph(row), row["ids"], of[i]
                elif of[i] == at:    # else the shard has no vector of this length
                    point = points[i].values.to_numpy(zero_copy_only=False)
                    found = graph.nearest(point, width)
                    score = np.sqrt(graph.distances(point, found))
                    near = sorted((s, n) for s, m in zip(score.tolist(), found.tolist()) for n in ids[m] if n != query)[:k]
                    out[0] += [query] * len(near)
                    out[1] += [n for _, n in near]
                    out[2] += [s for s, _ in near]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=names)

    found = both.mapInArrow(answer, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
