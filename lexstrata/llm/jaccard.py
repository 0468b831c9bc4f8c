"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct shingles of five words. In each size band
(sizes ``L`` to ``4 L``) a set is sketched in chunks: a chunk is the XOR of the digests
of its shingles, compared whole, so two sketches differ in no more chunks than the sets
differ in shingles. In bands below ``SMALL`` shingles a chunk is one shingle, which is a
prefix join without XOR: a chunk of several would differ for nearly every shingle that
does, and the few chunks left would tell little. Sets
that reach the similarity differ in at most ``d`` shingles, with ``d`` known from the
sizes; so of the chunks that hold a bit, in one fixed order, the first ``d + 1 + s``
of both share at least ``s + 1``. Those chunks are the join key; pairs that share
enough are then counted shingle by shingle. Small sets get a chunk per shingle, and
there ``d`` counts only the shingles that the partner lacks.
A set that has no place in a band but whose partner may is sketched in both.

What keeps groups from costing their square, without losing a link:

* equal sets become one class, named by its smallest document;
* a first, cheap round joins each document to the one that, of those that share some
  of its least shingles, shares them with most, and gives components; afterwards only
  pairs of two components are of interest, so a large group of copies is one thing;
* a chunk held by more than ``HOT`` documents of several components makes no pairs.
  It is counted against each of them, and a document with at most ``s`` such chunks
  still shares another chunk with each partner. Documents with more are joined
  among themselves over their shingles, the rarest first, as many as can decide.

Every set also has a parity sketch: each shingle flips one bit of a string as long as
the band's largest set, up to ``MOST_BITS``. Bits that two sketches differ in are at most
the shingles that their sets differ in (a longer sketch is first folded onto the
shorter by XOR), so a pair whose sketches differ in more than its sizes allow goes
without its texts being read. Texts are compared only for pairs that got so far. Ids are
integers.

Defined results: a null or empty text, or one without words, has no shingle and is
linked with nothing; fewer than five words are one shingle; repeated rows are one
document in the links and answered each; an id given to different texts is one
document, linked by one of them; a null id is linked with nothing; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..session import shuffle_partitions
from .components import components, saved
from .words import LOWER, SPACE, Block, WordReader, mapped, mix, runs

SHINGLE = 5
LEAST = 16            # least shingles for the first round
FEW = 3               # of these shared before a pair of the first round is compared
HOT = 16
SMALL = 256           # in bands of sets below this size every shingle is a chunk
EDGE = SMALL * 3 // 4    # the smallest set sketched in a band of larger ones
SPREAD = 0.75         # chunks of a band per shingle of its largest set
BROADCAST_IDS = 1_000_000
COMPARED_ROWS = 256
LEAST_PARTS = 64      # a task holds the chunks of one part at a time, so parts stay small on few shuffle partitions too
PART_SHINGLES = 1 << 20    # shingles a part, on average; chunks are no more
LEAST_BITS, MOST_BITS = 64, 1 << 16
LEAST_BUCKETS, MOST_BUCKETS = 1 << 10, 1 << 22    # of shingle counts that every task holds: 16 MB at most
_ID = pa.int64()
_OWNER = np.dtype([("id", "<i8"), ("comp", "<i8"), ("n", "<i4"), ("band", "<i2"), ("chunks", "<i4")])


def slack(n: int) -> int:
    return n // 8 if n >= EDGE else -(-3 * n // 4) - 1


def band_of(n: int) -> int:
    return (n.bit_length() - 1) // 2


def sketch(shingles: np.ndarray, band: int, spread: float = SPREAD) -> np.ndarray:
    """Names of the chunks that hold a bit, in the fixed order."""
    top = 4 ** (band + 1)
    if top <= SMALL:
        return np.sort(mix(shingles, 1000 + band))
    chunk = mix(shingles, 7) % np.uint64(int(spread * top))
    order = np.argsort(chunk, kind="stable")
    chunk = chunk[order]
    first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
    content = np.bitwise_xor.reduceat(mix(shingles[order], 8), first)
    held = content != 0
    return np.sort(mix(content[held] ^ mix(chunk[first][held], 9), 1000 + band))


def kept_chunks(n: int, band: int) -> int:
    """How many chunks of a set go into the join."""
    top = 4 ** (band + 1)
    apart = n - -(-3 * n // 4) if top <= SMALL else (n + min(4 * n // 3, top - 1)) // 7
    return apart + 1 + slack(n)


def bands(n: int) -> list[int]:
    own = band_of(n)
    return [own, own + 1] if 4 * n >= 3 * 4 ** (own + 1) else [own]


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bytes of the parity sketch of a set."""
    size = min(max(4 ** (band_of(len(shingles)) + 1), LEAST_BITS), MOST_BITS)
    flips = np.bincount((mix(shingles, 11) % np.uint64(size)).astype(np.int64), minlength=size)
    return np.packbits(flips & 1)


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """In how many bits two parity sketches differ; never more than their sets differ in."""
    size = min(len(x), len(y))    # sizes are powers of two times the smallest
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def block_sets(block: Block):
    """Row and sorted distinct shingle digests of every text of a block that has words."""
    five = runs(block.digests, SHINGLE)
    for row, a, b in block.texts():
        if b - a >= SHINGLE:
            yield row, np.unique(five[a:b - SHINGLE + 1])
        elif b > a:
            yield row, runs(block.digests[a:b], b - a, 100 * (b - a))


def _reader() -> WordReader:
    return WordReader(SPACE, LOWER)


def shingle_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, n, set1, set2, least, bits``: size, digest, least shingles and parity sketch of each set."""
    names = ["id", "n", "set1", "set2", "least", "bits"]

    def run(reader: WordReader, rows: pa.RecordBatch) -> pa.RecordBatch:
        n = np.zeros(len(rows), np.int64)
        digest = np.zeros((2, len(rows)), np.uint64)
        least: list = [[] for _ in range(len(rows))]
        bits = [b""] * len(rows)
        for block in reader.blocks(rows.column(1)):
            for row, own in block_sets(block):
                n[row] = len(own)
                digest[0, row], digest[1, row] = mix(own, 21).sum(), mix(own, 22).sum()
                least[row] = own[:LEAST].view(np.int64)
                bits[row] = parity(own).tobytes()
        return pa.RecordBatch.from_arrays(
            [rows.column(0).cast(_ID), pa.array(n), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
             pa.array(least, pa.list_(_ID)), pa.array(bits, pa.binary())], names=names)

    return mapped(docs.select(key, text), run, "id long, n long, set1 long, set2 long, least array<long>, bits binary", _reader)


def _with_ids(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on ``id``; the ids are broadcast only if they are few."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", how)


def _near_sketches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose parity sketches differ in no more bits than sets of their sizes may."""
    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(len(rows), bool)
        sizes = rows.column(2).to_numpy() + rows.column(3).to_numpy()
        most = sizes - 2 * -(-3 * sizes // 7)    # similar sets share at least 3 / 7 of both sizes together
        for i, (x, y) in enumerate(zip(rows.column(4), rows.column(5))):
            keep[i] = bits_apart(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= most[i]
        at = pa.array(np.flatnonzero(keep))
        return pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at)], names=["a", "b"])

    both = pairs.select("a", "b").distinct()
    for side in ("a", "b"):
        both = both.join(classes.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"bits{side}")), side)
    return mapped(both.select("a", "b", "na", "nb", "bitsa", "bitsb"), run, "a long, b long")


def _compared(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose sets reach the similarity, by counting shared shingles of the whole texts."""
    pairs = saved(_near_sketches(pairs, classes))
    involved = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = _with_ids(texts, involved, "left_semi")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a") \
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def compare(reader: WordReader, rows: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(len(rows), bool)
        sides = []
        for column in (2, 3):
            one = rows.column(column).dictionary_encode()    # a text meets many partners
            sets = {row: own for block in reader.blocks(one.dictionary) for row, own in block_sets(block)}
            sides.append((one.indices.to_pylist(), sets))
        none = np.empty(0, np.uint64)
        for i, (x, y) in enumerate(zip(sides[0][0], sides[1][0])):
            left, right = sides[0][1].get(x, none), sides[1][1].get(y, none)
            shared = len(np.intersect1d(left, right, assume_unique=True))
            keep[i] = shared > 0 and 100 * shared >= 75 * (len(left) + len(right) - shared)
        at = pa.array(np.flatnonzero(keep))
        return pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at)], names=["a", "b"])

    def run(reader: WordReader, rows: pa.RecordBatch):
        for at in range(0, len(rows), COMPARED_ROWS):
            yield compare(reader, rows.slice(at, COMPARED_ROWS))

    return saved(mapped(both, run, "a long, b long", _reader))


def _first_links(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of each document to the one that shares some of its least shingles, and shares them with most."""
    rows = classes.select("id", "n", F.explode("least").alias("s"))
    rows = lookup(rows, rows.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"), "s", "id", "inner")    # a passage's shingle may be hot
    rows = saved(rows.join(rows.groupBy("id").agg(F.sum("c").alias("w")), "id"))
    lead = rows.groupBy("s").agg(F.max_by(F.struct("id", "n"), F.struct("w", -F.col("id"))).alias("lead")) \
        .select("s", F.col("lead.id").alias("b"), F.col("lead.n").alias("nb"))
    pairs = lookup(rows, lead, "s", "id", "inner").where("id <> b and 4 * least(n, nb) >= 3 * greatest(n, nb)") \
        .groupBy("id", "b").agg(F.count("*").alias("c"), F.first("n").alias("n")) \
        .where(F.col("c") >= F.least(F.lit(FEW), F.col("n")))
    return _compared(pairs.select(F.col("id").alias("a"), "b"), classes, texts)


def _sketch_rows(docs: DataFrame, parts: int, spread: float) -> DataFrame:
    """Chunks of ``id, comp, text`` rows, dealt into parts: one row per block of texts and part.

    ``owners`` tells, for each document that has chunks there, whose they are and how many.
    """
    def run(reader: WordReader, rows: pa.RecordBatch):
        ids, comps = rows.column(0).to_pylist(), rows.column(1).to_pylist()
        for block in reader.blocks(rows.column(2)):
            owners, chunks, whose = [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for row, own in block_sets(block):
                n = len(own)
                for band in bands(n):
                    size = kept_chunks(n, band)
                    held = sketch(own, band, spread)[:size]
                    if len(held) < min(size, n):
                        raise ValueError(f"a set of {n} shingles fills only {len(held)} chunks; raise spread")
                    chunks.append(held)
                    whose.append(np.full(len(held), len(owners)))
                    owners.append((ids[row], comps[row], n, band, 0))
            chunks, whose = np.concatenate(chunks), np.concatenate(whose)
            table = np.array(owners, _OWNER)
            part = (mix(chunks, 31) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((whose, part))
            part, chunks, whose = part[order], chunks[order], whose[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
            told = []
            for x, y in zip(first, np.append(first[1:], len(part))):
                at, count = np.unique(whose[x:y], return_counts=True)
                some = table[at]
                some["chunks"] = count
                told.append((int(part[x]), some.tobytes(), chunks[x:y].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in told], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))],
                                             names=["part", "owners", "chunks"])

    return mapped(docs.select("id", "comp", "text"), run, "part int, owners binary, chunks binary", _reader)


def _met(chunks: np.ndarray, who: np.ndarray, info: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Pairs of different components that share a chunk, and hot chunks per document, of one part.

    Columns ``a, b, band, na, nb, c``; ``b`` is -1 for the hot count of ``a``.
    """
    order = np.argsort(chunks, kind="stable")
    chunks, who = chunks[order], who[order]
    first = np.flatnonzero(np.concatenate([[True], chunks[1:] != chunks[:-1]]))
    size = np.diff(np.append(first, len(chunks)))
    comp = info["comp"][who]
    mixed = np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first)
    hot = np.repeat(mixed & (size > HOT), size)
    place = np.arange(len(chunks)) - np.repeat(first, size)
    cold = np.repeat(mixed & (size <= HOT), size)
    left, right = [], []
    for step in range(1, HOT):
        at = np.flatnonzero(cold[step:] & (place[step:] >= step))
        if not len(at):
            break
        x, y = who[at], who[at + step]
        nx, ny = info["n"][x], info["n"][y]
        fits = (info["comp"][x] != info["comp"][y]) & (4 * np.minimum(nx, ny) >= 3 * np.maximum(nx, ny))
        left.append(x[fits])
        right.append(y[fits])
    out = []
    if left:
        x, y = np.concatenate(left), np.concatenate(right)
        swap = info["id"][x] > info["id"][y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        pairs, c = np.unique(x.astype(np.int64) * len(info["id"]) + y, return_counts=True)
        x, y = pairs // len(info["id"]), pairs % len(info["id"])
        out.append(np.stack([info["id"][x], info["id"][y], info["band"][x], info["n"][x], info["n"][y], c]))
    docs, c = np.unique(who[hot], return_counts=True)
    out.append(np.stack([info["id"][docs], np.full(len(docs), -1), info["band"][docs], info["n"][docs], np.zeros(len(docs), np.int64), c]))
    return out


def _meetings(sketches: DataFrame, parts: int) -> DataFrame:
    """What the documents of each part share. A task works on one part at a time."""
    names = ["a", "b", "band", "na", "nb", "c"]

    def finish(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        owners = np.frombuffer(b"".join(x for r in rows for x in r.column(1).to_pylist()), _OWNER)
        chunks = np.frombuffer(b"".join(x for r in rows for x in r.column(2).to_pylist()), np.uint64)
        info = {c: owners[c].astype(np.int64) for c in ("band", "id", "comp", "n")}
        met = np.concatenate(_met(chunks, np.repeat(np.arange(len(owners)), owners["chunks"]), info), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in met], names=names)

    def run(batches):
        held, part = [], None
        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
                if a == b:
                    continue
                if held and own[a] != part:
                    yield finish(held)
                    held = []
                part = own[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield finish(held)

    dealt = sketches.repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    return dealt.mapInArrow(run, "a long, b long, band long, na long, nb long, c long")


def _bucket(shingles: np.ndarray, size: int) -> np.ndarray:
    return (mix(shingles, 41) % np.uint64(size)).astype(np.int64)


def _bucket_counts(own: DataFrame, size: int) -> np.ndarray:
    """How many shingles of all documents fall into each of ``size`` buckets; never less than the documents of any of them."""
    def run(reader: WordReader, rows: pa.RecordBatch):
        for block in reader.blocks(rows.column(0)):
            sets = [_bucket(s, size) for _, s in block_sets(block)]
            at, n = np.unique(np.concatenate(sets) if sets else np.empty(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    told = mapped(own.select("text"), run, "bucket long, n long", _reader).groupBy("bucket").agg(F.sum("n").alias("n"))
    told = told.select(F.col("bucket").cast("int"), F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()    # ``size`` rows at most
    counts = np.zeros(size, np.int32)
    counts[told.column("bucket").to_numpy()] = told.column("n").to_numpy()
    return counts


def rarest(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set that decide on its links, and their places in the order of bucket counts; those alone in their bucket are left out."""
    n = len(shingles)
    count = counts[_bucket(shingles, len(counts))]
    order = np.lexsort((shingles.view(np.int64), count))[:n + 3 * n // -4 + 1]
    shared = np.flatnonzero(count[order] > 1)
    return shingles[order[shared]], shared + 1


def _hot_pairs(hot: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates among documents with too many hot chunks: their shingles, the rarest first.

    Rare is what a fixed number of bucket counts tells, the same for all documents: any
    common order finds every link, and this one needs no count per shingle to travel.
    """
    ids = saved(hot.select(F.col("a").alias("id"), "n").dropDuplicates(["id"]))
    own = _with_ids(docs, ids.select("id"), "left_semi")
    total = ids.agg(F.sum("n").alias("n")).first()["n"] or 0
    counts = _bucket_counts(own, min(max(1 << (4 * total).bit_length(), LEAST_BUCKETS), MOST_BUCKETS))
    shared_counts = docs.sparkSession.sparkContext.broadcast(counts)

    def run(reader: WordReader, rows: pa.RecordBatch):
        ids, comps = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        for block in reader.blocks(rows.column(2)):
            told = [(row, len(own), *rarest(own, shared_counts.value)) for row, own in block_sets(block)]
            whose = np.repeat(np.array([t[0] for t in told], np.int64), [len(t[2]) for t in told])
            sizes = np.repeat(np.array([t[1] for t in told], np.int64), [len(t[2]) for t in told])
            s, r = (np.concatenate([t[i] for t in told]) if told else np.empty(0, np.int64) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (ids[whose], comps[whose], sizes, s, r)],
                                             names=["id", "comp", "n", "s", "r"])

    first = saved(mapped(own.select("id", "comp", "text"), run, "id long, comp long, n long, s long, r long", _reader))
    a, b = (first.select("s", *[F.col(c).alias(c + x) for c in ("id", "comp", "n", "r")]) for x in ("a", "b"))
    shared = "ceil(3 * (na + nb) / 7)"    # shingles that two similar sets share at least
    met = a.join(b, "s").where(f"""ida < idb and compa <> compb and 4 * least(na, nb) >= 3 * greatest(na, nb)
                                   and ra <= na - {shared} + 1 and rb <= nb - {shared} + 1""")
    return met.select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct()


def jaccard_links(docs: DataFrame, key: str = "doc_id", text: str = "text", spread: float = SPREAD) -> tuple[DataFrame, DataFrame]:
    """``id, n, rep`` of every row, and links ``a, b`` between class representatives that connect all similar ones."""
    spark = docs.sparkSession
    sets = saved(shingle_sets(docs, key, text))
    named = sets.where("n > 0 and id is not null")
    rep = named.groupBy("set1", "set2", "n").agg(F.min("id").alias("rep"))
    members = saved(named.join(rep, ["set1", "set2", "n"]).select("id", "n", "rep", "least", "bits"))
    classes = members.where("id = rep").dropDuplicates(["id"])
    shingles = members.where("id = rep").agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = max(shuffle_partitions(spark), LEAST_PARTS, -(-shingles // PART_SHINGLES))
    copies = members.where("id <> rep").select("id").distinct()
    texts = _with_ids(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null"), copies, "left_anti")

    first = _first_links(classes, texts)
    near = components(first).select(F.col("node").alias("id"), F.col("component").alias("comp"))
    grouped = F.broadcast(near) if near.count() <= BROADCAST_IDS else near
    docs_in = texts.join(grouped, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), "text")
    met = saved(_meetings(_sketch_rows(docs_in, parts, spread), parts))
    hot = saved(met.where("b = -1").groupBy("a", "band").agg(F.sum("c").alias("h"), F.first("na").alias("n")))
    pairs = met.where("b <> -1").groupBy("a", "b", "band").agg(F.sum("c").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    for side in ("a", "b"):
        own = hot.select(F.col("a").alias(side), "band", F.col("h").alias(f"h{side}"))
        pairs = pairs.join(own, [side, "band"], "left")
    hot_both = F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    need = F.greatest(F.lit(1), F.least(_slack_column("na"), _slack_column("nb")) + 1 - hot_both)
    likely = pairs.where(F.col("c") >= need).select("a", "b")
    many = hot.where(F.col("h") > _least_slack_column("n"))
    if not many.isEmpty():
        likely = likely.unionByName(_hot_pairs(many, docs_in))
    return sets.join(members.select("id", "rep").distinct(), "id", "left").select("id", "n", "rep"), first.unionByName(_compared(likely, classes, texts))


def _slack_column(n):
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n >= EDGE, F.floor(n / 8)).otherwise(F.ceil(n * 3 / 4) - 1)


def _least_slack_column(n: str):
    """Smallest slack of a set that could be a partner of one of ``n``."""
    n = F.col(n)
    low, high = F.ceil(n * 3 / 4), F.floor(n * 4 / 3)
    edge = F.when((low <= EDGE) & (high >= EDGE), F.lit(EDGE // 8)).otherwise(F.lit(2**40))
    return F.least(_slack_column(low), _slack_column(n), _slack_column(high), edge)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key, n_shingles, component_id``, the smallest id reachable by links."""
    rows, links = jaccard_links(docs, key, text)
    found = components(links).select(F.col("node").alias("rep"), "component")
    return rows.join(found, "rep", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))
