"""Which groups of vectors can hold an answer of an exact search.

Rows are grouped by the nearest of some pivot vectors, a bounded sample. On unit vectors
the straight distance is a metric, and half its square is the cosine distance, so the
triangle inequality bounds how near any row of a group can be to a query: no nearer than
its pivot less the group's radius. A query needs a group only if that bound is within
what the groups certainly offer: enough rows within pivot distance plus radius, and for
each period a row within pivot distance plus its own distance to the pivot. Groups that
are not needed hold no answer, whatever their vectors; the choice of pivots decides only
how many they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIVOTS = 256
SLACK = 2e-9      # of distances that are compared at 9 decimals
_ROWS = 2000      # looked at together

Units = Callable[[pa.Array, int], tuple[np.ndarray, np.ndarray]]


def _distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (units @ pivots.T)))


def _chain(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which near ones follow one another: each time the nearest that is left."""
    far = _distances(pivots, pivots)
    order, left = [], np.ones(len(pivots), bool)
    for _ in range(len(pivots)):
        at = int(np.where(left, far[order[-1]], np.inf).argmin()) if order else 0
        order.append(at)
        left[at] = False
    return np.array(order, np.int64)


def choose(lexicon: DataFrame, dim: int, units: Units, n: int = PIVOTS) -> np.ndarray:
    """Pivots from the rows whose ids have the least digests, equal ones once."""
    rows = lexicon.where(F.size("vector") == dim).orderBy(F.xxhash64("row_id"), "row_id").select("vector").limit(n).toArrow()
    _, found = units(rows.column("vector"), dim)
    return np.unique(found, axis=0)


def grouped(lexicon: DataFrame, pivots: np.ndarray, dim: int, units: Units) -> DataFrame:
    """``row_id, time_period, vector`` of usable rows with the group and the distance to its pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                at, vectors = units(batch.column(2), dim)
                if len(at):
                    far = _distances(vectors, pivots)
                    group = far.argmin(axis=1)
                    taken = [c.take(pa.array(at)) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([*taken, pa.array(group.astype(np.int32)), pa.array(far[np.arange(len(at)), group])],
                                                     names=["row_id", "time_period", "vector", "group", "far"])

    kind = lexicon.schema["vector"].dataType.simpleString()
    return lexicon.select("row_id", "time_period", "vector") \
        .mapInArrow(run, f"row_id long, time_period int, vector {kind}, group int, far double")


class Bounds:
    """What is known of the groups: rows and radius, and for each period its radius and its row nearest to the pivot."""

    def __init__(self, rows: DataFrame, pivots: np.ndarray, periods: tuple[int, ...]):
        self.pivots = pivots
        self.chain = _chain(pivots)
        self.count = np.zeros(len(pivots), np.int64)
        self.radius = np.zeros(len(pivots))
        self.widest = np.full((len(periods), len(pivots)), -np.inf)
        self.closest = np.full((len(periods), len(pivots)), np.inf)
        place = {p: i for i, p in enumerate(periods)}
        period = F.when(F.col("time_period").isin(*periods), F.col("time_period")) if periods else F.lit(None).cast("int")
        stats = rows.groupBy("group", period.alias("period")).agg(F.count("*").alias("n"), F.max("far").alias("most"), F.min("far").alias("least"))
        for r in stats.collect():    # a row per pivot and period at most
            g = r["group"]
            self.count[g] += r["n"]
            self.radius[g] = max(self.radius[g], r["most"])
            if r["period"] is not None:
                self.widest[place[r["period"]], g], self.closest[place[r["period"]], g] = r["most"], r["least"]

    def needed(self, units: np.ndarray, k: int) -> np.ndarray:
        """(query, group): whether the group can hold one of the k nearest or the nearest of a period."""
        far = _distances(units, self.pivots)
        offered = np.where(self.count > 0, far + self.radius, np.inf)
        order = np.argsort(offered, axis=1)
        enough = (np.cumsum(self.count[order], axis=1) >= k).argmax(axis=1)
        whole = self.count.sum() >= k
        reach = np.take_along_axis(offered, order, axis=1)[np.arange(len(far)), enough] if whole else np.full(len(far), np.inf)

        def within(radius: np.ndarray, limit: np.ndarray) -> np.ndarray:
            least = np.maximum(far - radius, 0.0)
            return least * least / 2 <= (limit * limit / 2 + SLACK)[:, None]

        out = within(self.radius, reach) & (self.count > 0)
        for widest, closest in zip(self.widest, self.closest):
            there = np.isfinite(closest)
            if there.any():
                nearest = np.where(there, far + np.where(there, closest, 0.0), np.inf).min(axis=1)
                out |= within(np.where(there, widest, 0.0), nearest) & there
        return out


@dataclass
class Packed:
    """Groups packed into parts of bounded size: the first part of each group and over how many its members are spread."""

    first: np.ndarray
    spread: np.ndarray
    total: int

    def column(self, group: str, key: str) -> Column:
        """The part of a member."""
        def of(numbers: np.ndarray) -> Column:
            return F.element_at(F.array(*[F.lit(int(n)) for n in numbers] or [F.lit(0)]), F.col(group) + 1)

        return (of(self.first) + F.pmod(F.xxhash64(key), of(self.spread))).cast("int")

    def holding(self) -> np.ndarray:
        """(group, part): whether members of the group are in the part."""
        parts = np.arange(self.total)
        return (parts >= self.first[:, None]) & (parts < (self.first + self.spread)[:, None])

    def meeting(self, other: Packed, met: np.ndarray) -> list[tuple[int, list[int]]]:
        """Each part of this side with the parts of the other side whose members need a group in it."""
        need = other.holding().T.astype(np.int64) @ (met > 0) @ self.holding().astype(np.int64)
        return [(part, np.flatnonzero(need[:, part]).tolist()) for part in range(self.total)]


def packed(counts: np.ndarray, size: int, chain: np.ndarray) -> Packed:
    """Groups along the chain share a part up to ``size`` members; larger ones are spread over parts of their own."""
    first, spread = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    part, held = 0, 0
    for g in chain:
        n = int(counts[g])
        if held and held + n > size:
            part, held = part + 1, 0
        first[g], spread[g] = part, max(1, -(-n // size))
        part, held = part + int(spread[g]) - 1, held + n if spread[g] == 1 else size
    return Packed(first, spread, part + 1)


def unpacked(needs: pa.ChunkedArray) -> np.ndarray:
    """(query, group) of packed bits."""
    rows = [np.frombuffer(v.as_buffer(), np.uint8) for chunk in needs.chunks for v in chunk]
    return np.unpackbits(np.stack(rows), axis=1).astype(bool) if rows else np.zeros((0, 0), bool)


def meetings(queries: DataFrame, bounds: Bounds, k: int, dim: int, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """The queries of each group, and (group of a query, group it needs): how many."""
    n = len(bounds.count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, met = np.zeros(n, np.int64), np.zeros((n, n), np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                _, vectors = units(whole.slice(start, _ROWS).column(0), dim)
                if len(vectors) and n:
                    own = _distances(vectors, bounds.pivots).argmin(axis=1)
                    counts += np.bincount(own, minlength=n)
                    needed = bounds.needed(vectors, k)
                    for g in np.unique(own):
                        met[g] += needed[own == g].sum(axis=0)
        a, b = np.nonzero(met)
        asked = np.flatnonzero(counts)
        columns = (np.concatenate([a, asked]), np.concatenate([b, np.full(len(asked), -1)]), np.concatenate([met[a, b], counts[asked]]))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["own", "needed", "n"])

    counts, met = np.zeros(n, np.int64), np.zeros((n, n), np.int64)
    told = queries.select("vector").mapInArrow(run, "own long, needed long, n long").groupBy("own", "needed").agg(F.sum("n").alias("n"))
    for r in told.collect():    # a row per pair of pivots at most
        if r["needed"] < 0:
            counts[r["own"]] = r["n"]
        else:
            met[r["own"], r["needed"]] = r["n"]
    return counts, met


def dealt(queries: DataFrame, bounds: Bounds, blocks: Packed, slices: Packed, k: int, dim: int, units: Units) -> DataFrame:
    """``query_id, vector, needs, _q, _l``: every query with its block, once for each slice that has a group it needs."""
    kind, vector = (queries.schema[c].dataType.simpleString() for c in ("query_id", "vector"))
    holding = slices.holding().astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                at, vectors = units(batch.column(1), dim)
                if not len(at) or not len(bounds.count):
                    continue
                own = _distances(vectors, bounds.pivots).argmin(axis=1)
                needed = bounds.needed(vectors, k)
                q, part = np.nonzero(needed @ holding)
                bits = np.packbits(needed, axis=1)
                rows = pa.array(at[q])
                block = blocks.first[own] + batch.column(2).to_numpy()[at] % blocks.spread[own]
                needs = pa.array([b.tobytes() for b in bits], pa.binary()).take(pa.array(q))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), needs, pa.array(block[q].astype(np.int32)), pa.array(part.astype(np.int32))],
                    names=["query_id", "vector", "needs", "_q", "_l"])

    return queries.select("query_id", "vector", F.xxhash64("query_id").alias("hash")) \
        .mapInArrow(run, f"query_id {kind}, vector {vector}, needs binary, _q int, _l int")
