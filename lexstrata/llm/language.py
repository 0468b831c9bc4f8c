"""Language ID by a linear-chain conditional random field over words.

Every word is scored by its affixes, its letter triples and by whether it stands in
a language's lexicon (that language's frequent words in the training sample), and
neighbouring words by learned transitions. Forward-backward gives each word its
probability of each language, so text that switches language is labelled word by
word; a text's language is the one with the largest mean.

The field is trained from a bounded sample: of each language, ``SAMPLE_LINES`` lines
of ``SAMPLE_DOCS`` labelled documents, both chosen by hash; longer lines count as
several, cut after ``CHAIN`` words (words after 256 characters), so the sample is
bounded in bytes too. Chains of two languages
are made from them, so that switches are learned. Features are hashed into
``BUCKETS``. Reading is one pass over whole texts without a shuffle, in chains of
``CHAIN`` words at once (more with many languages, so that their matrices stay small);
messages are carried over the cuts, so a text is one linear chain.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and
so is every text when no row has a label; equal means go to the label that sorts
first; repeated rows are answered each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import LETTER, LOWER, Block, WordReader, mapped, mix

UNKNOWN = "und"
SAMPLE_DOCS, SAMPLE_LINES = 400, 1500
CHAIN = 64
BUCKETS = 1 << 16
LEXICON_WORDS = 300
EPOCHS, BATCH_CHAINS, RATE, DECAY = 4, 256, 0.3, 1e-4
_AFFIXES = (1, 2, 3, 4)
_PIECE = r"(?:\\S{1,256}+\\s{0,16}+){1,%d}+" % CHAIN    # for SQL; every character but blanks falls in one piece


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray        # feature bucket x label
    lexicon: np.ndarray        # digests of lexicon words, sorted
    lexicon_label: np.ndarray  # lexicon word x label, 1 where the word is frequent
    lexicon_weights: np.ndarray   # label whose lexicon has the word x label
    transitions: np.ndarray
    start: np.ndarray


def _buckets(values: np.ndarray, salt: int) -> np.ndarray:
    return (mix(values, salt) % np.uint64(BUCKETS)).astype(np.int64)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bucket of every affix and triple of words given by their bytes."""
    sizes = ends - starts
    words, buckets = [], []
    for k in _AFFIXES:
        own = np.flatnonzero(sizes >= k)
        head = tail = np.zeros(len(own), np.uint64)
        for i in range(k):
            head = (head << np.uint64(8)) | data[starts[own] + i]
            tail = (tail << np.uint64(8)) | data[ends[own] - k + i]
        words += [own, own]
        buckets += [_buckets(head, 2 * k), _buckets(tail, 2 * k + 1)]
    n = np.maximum(sizes - 2, 0)
    own = np.repeat(np.arange(len(sizes)), n)
    at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    d = data.astype(np.uint64)
    words.append(own)
    buckets.append(_buckets((d[at] << np.uint64(16)) | (d[at + 1] << np.uint64(8)) | d[at + 2], 99) if len(at) else own)
    return np.concatenate(words), np.concatenate(buckets)


def _sums(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(groups, values[:, k], n) for k in range(values.shape[1])], axis=1)


def _lexicon_hits(model: Model, digests: np.ndarray) -> np.ndarray:
    """Word x label: in which lexicons each word stands."""
    if not len(model.lexicon):
        return np.zeros((len(digests), len(model.labels)))
    at = np.minimum(np.searchsorted(model.lexicon, digests), len(model.lexicon) - 1)
    return model.lexicon_label[at] * (model.lexicon[at] == digests)[:, None]


def word_scores(model: Model, block: Block) -> np.ndarray:
    """Score of every word of a block for each label; equal words are scored once."""
    digests, first, where = np.unique(block.digests, return_index=True, return_inverse=True)
    words, buckets = features(block.data, block.starts[first], block.ends[first])
    scores = _sums(words, model.weights[buckets], len(first)) + _lexicon_hits(model, digests) @ model.lexicon_weights
    return scores[where]


def chains(bounds: np.ndarray, size: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of the chains of texts, longest first."""
    sizes = np.diff(bounds)
    n = -(-sizes // size)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(bounds[:-1], n) + step * size
    length = np.minimum(size, np.repeat(bounds[1:], n) - first)
    order = np.argsort(-length, kind="stable")
    return first[order], length[order]


def marginals(scores: np.ndarray, first: np.ndarray, length: np.ndarray, transitions: np.ndarray, start: np.ndarray,
              pairs: np.ndarray | None = None, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> np.ndarray:
    """Probability of each label at every word by forward-backward, all chains at once.

    ``pairs``, if given, gains the expected count of each transition. ``enter`` and ``leave``
    hold the messages that reach each chain from before and after it, else it stands alone.
    """
    k = scores.shape[1]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    move = np.exp(transitions - transitions.max())
    forward = np.zeros((len(scores), k))
    steps = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(steps), "left") if steps else []    # chains longer than each step
    for t in range(steps):
        at = first[:live[t]] + t
        now = emit[at] * ((np.exp(start - start.max()) if enter is None else enter) if t == 0 else forward[at - 1] @ move)
        forward[at] = now / now.sum(axis=1, keepdims=True)
    out = np.zeros_like(forward)
    back = np.ones((len(first), k)) if leave is None else leave.copy()
    for t in range(steps - 1, -1, -1):
        at = first[:live[t]] + t
        here = forward[at] * back[:live[t]]
        out[at] = here / here.sum(axis=1, keepdims=True)
        if t:
            ahead = emit[at] * back[:live[t]]
            if pairs is not None:
                joint = forward[at - 1][:, :, None] * move[None] * ahead[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            ahead = ahead @ move.T
            back[:live[t]] = ahead / ahead.sum(axis=1, keepdims=True)
    return out


def text_marginals(scores: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, start: np.ndarray, chain: int = CHAIN) -> np.ndarray:
    """``marginals`` of whole texts as one chain each, worked out in parts of a text at once.

    Each part is a matrix of messages from its left edge to its right; their products in
    turn give what reaches every part from both sides.
    """
    k = scores.shape[1]
    size = chain * max(1, k * k // 64)
    first, length = chains(bounds, size)
    sizes = np.diff(bounds)
    n_parts = -(-sizes // size)
    if not (n_parts > 1).any():
        return marginals(scores, first, length, transitions, start)
    text = np.searchsorted(bounds, first, "right") - 1
    lead = first == bounds[text]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    move, begin = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    enter, leave = np.tile(begin, (len(first), 1)), np.ones((len(first), k))

    cut = np.flatnonzero(n_parts[text] > 1)    # longest first, as in first
    across = np.where(lead[cut][:, None, None], np.eye(k), move) * emit[first[cut]][:, None, :]
    for t in range(1, int(length[cut[0]])):
        live = int(np.searchsorted(-length[cut], -t, "left"))
        across[:live] = across[:live] @ move * emit[first[cut[:live]] + t][:, None, :]
        across[:live] /= across[:live].sum(axis=(1, 2), keepdims=True)
    order = np.argsort(first[cut])    # parts as they stand in the texts
    across, place = across[order], cut[order]
    many = np.sort(n_parts[n_parts > 1])[::-1]
    at = np.flatnonzero(lead[place])[np.argsort(-n_parts[text[place[lead[place]]]], kind="stable")]
    one = lambda v: v / v.sum(axis=1, keepdims=True)
    message = np.tile(begin, (len(at), 1))
    for s in range(1, int(many[0])):
        live = int(np.searchsorted(-many, -s, "left"))
        message = one(np.einsum("ni,nij->nj", message[:live], across[at[:live] + s - 1]))
        enter[place[at[:live] + s]] = message @ move
    message = np.ones((len(at), k))
    for s in range(int(many[0]) - 1, 0, -1):
        live = int(np.searchsorted(-many, -s, "left"))
        message[:live] = one(np.einsum("nij,nj->ni", across[at[:live] + s], message[:live]))
        leave[place[at[:live] + s - 1]] = message[:live]
    return marginals(scores, first, length, transitions, start, enter=enter, leave=leave)


def sample_lines(docs: DataFrame, eligible: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
                 n_docs: int = SAMPLE_DOCS, n_lines: int = SAMPLE_LINES) -> DataFrame:
    """``lang, line``: a bounded number of lines of bounded size per language, chosen by hash."""
    labelled = docs.where(eligible & F.col(lang).isNotNull() & F.col(text).isNotNull())
    picked = _least(labelled.select(F.col(lang).alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(key).alias("id"))
                    .distinct(), n_docs, "id").select("id", "lang")
    own = labelled.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    own = own.join(F.broadcast(picked), ["id", "lang"], "left_semi")    # at most n_docs ids a language
    lines = own.select("lang", "id", F.explode(F.split("text", "\n")).alias("line")) \
        .select("lang", "id", F.explode(F.expr(f"regexp_extract_all(line, '{_PIECE}', 0)")).alias("line")).where("trim(line) <> ''")
    return _least(lines.withColumn("h", F.xxhash64("id", "line")), n_lines, "id", "line").select("lang", "line")


def _least(rows: DataFrame, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of each language with the least hash ``h``.

    Each language is cut into slices first, so that one with most of the rows is no single task's work.
    """
    order = [F.col("h"), *map(F.col, ties)]
    sliced = rows.withColumn("slice", F.pmod("h", F.lit(64)))
    for by in (["lang", "slice"], ["lang"]):
        sliced = sliced.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= n)
    return sliced.drop("r", "slice")


def train(lines: list[tuple[str, str]], epochs: int = EPOCHS) -> Model:
    """The field of a sample of (language, line); lines are used in chains of up to ``CHAIN`` words."""
    lines = sorted(lines)
    labels = sorted({lang for lang, _ in lines})
    k = len(labels)
    blank = Model(labels, np.zeros((BUCKETS, k)), np.empty(0, np.uint64), np.zeros((0, k)), np.eye(k), np.eye(k), np.zeros(k))
    if not lines:
        return blank
    rng = np.random.default_rng(11)
    blocks = list(WordReader(LETTER, LOWER).blocks(pa.array([line for _, line in lines])))
    label_of_line = np.array([labels.index(lang) for lang, _ in lines])
    digests = np.concatenate([b.digests for b in blocks])
    word_label = np.concatenate([label_of_line[b.first:b.last][b.docs] for b in blocks])
    feats = []
    base = 0
    for b in blocks:
        words, buckets = features(b.data, b.starts, b.ends)
        feats.append((words + base, buckets))
        base += len(b.starts)
    words, buckets = (np.concatenate(x) for x in zip(*feats))
    order = np.argsort(words, kind="stable")
    words, buckets = words[order], buckets[order]
    feature_at = np.searchsorted(words, np.arange(base + 1))

    frequent = []
    for j in range(k):
        found, n = np.unique(digests[word_label == j], return_counts=True)
        frequent.append(found[np.lexsort((found, -n))[:LEXICON_WORDS]])
    lexicon = np.unique(np.concatenate(frequent))
    model = Model(labels, blank.weights, lexicon, np.stack([np.isin(lexicon, f) for f in frequent], axis=1).astype(float),
                  blank.lexicon_weights, blank.transitions, blank.start)
    hits = _lexicon_hits(model, digests)

    parts = []    # chains: lines as they are, then halves of two lines of any two languages
    offset = 0
    for b in blocks:
        first, length = chains(b.bounds)
        parts += list(zip((first + offset).tolist(), length.tolist()))
        offset += len(b.starts)
    parts = [np.arange(f, f + n) for f, n in parts]
    shuffled = rng.permutation(len(parts))
    parts += [np.concatenate([parts[a][:CHAIN // 2], parts[b][:CHAIN // 2]]) for a, b in zip(shuffled[::2], shuffled[1::2])]
    weight2 = np.full(model.weights.shape, 1e-8)
    lexicon2, moves2, start2 = np.full((k, k), 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)

    def step(value: np.ndarray, squares: np.ndarray, gradient: np.ndarray) -> None:
        squares += gradient * gradient
        value += RATE * gradient / np.sqrt(squares)

    for _ in range(epochs):
        at = rng.permutation(len(parts))
        for lo in range(0, len(at), BATCH_CHAINS):
            own = sorted((parts[i] for i in at[lo:lo + BATCH_CHAINS]), key=len, reverse=True)
            tokens = np.concatenate(own)
            length = np.array([len(x) for x in own])
            first = np.cumsum(length) - length
            sizes = feature_at[tokens + 1] - feature_at[tokens]
            where = np.repeat(np.arange(len(tokens)), sizes)
            rows = buckets[np.arange(len(where)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(feature_at[tokens], sizes)]
            scores = _sums(where, model.weights[rows], len(tokens)) + hits[tokens] @ model.lexicon_weights
            expected = np.zeros((k, k))
            found = marginals(scores, first, length, model.transitions, model.start, expected)
            gold = word_label[tokens]
            slope = -found
            slope[np.arange(len(tokens)), gold] += 1
            inner = np.setdiff1d(np.arange(len(tokens)), first)
            moves = np.zeros((k, k))
            np.add.at(moves, (gold[inner - 1], gold[inner]), 1)
            n = len(own)
            step(model.weights, weight2, _sums(rows, slope[where], BUCKETS) / n - DECAY * model.weights)
            step(model.lexicon_weights, lexicon2, hits[tokens].T @ slope / n)
            step(model.transitions, moves2, (moves - expected) / n)
            step(model.start, start2, slope[first].sum(axis=0) / n)
    return model


def _segments(best: np.ndarray, bounds: np.ndarray, labels: list[str]) -> pa.Array:
    """Stretches of one label within each text, as lists of (label, first word, last word)."""
    change = np.ones(len(best), bool)
    change[1:] = best[1:] != best[:-1]
    change[bounds[:-1][np.diff(bounds) > 0]] = True
    at = np.flatnonzero(change)
    ends = np.append(at[1:], len(best))
    shift = bounds[np.searchsorted(bounds, at, "right") - 1]
    names = pa.array(labels, pa.string()).take(pa.array(best[at]))
    parts = pa.StructArray.from_arrays([names, pa.array(at - shift, pa.int64()), pa.array(ends - 1 - shift, pa.int64())],
                                       names=["lang", "first_word", "last_word"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds), pa.int32()), parts)


_SEGMENTS = "array<struct<lang: string, first_word: bigint, last_word: bigint>>"
_SEGMENT_TYPE = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


def _has_letter(block: Block, row: int) -> bool:
    text = bytes(block.data[block.offsets[row]:block.offsets[row + 1]])
    return any(97 <= b <= 122 for b in text) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _predicted(model: Model, block: Block) -> tuple[list[str], list[float], pa.Array]:
    """Language, score and segments of each text of a block."""
    n = block.last - block.first
    if not model.labels or not len(block.starts):
        return [UNKNOWN] * n, [0.0] * n, pa.array([[]] * n, _SEGMENT_TYPE)
    found = text_marginals(word_scores(model, block), block.bounds, model.transitions, model.start)
    means = _sums(block.docs, found, n) / np.maximum(np.diff(block.bounds), 1)[:, None]
    plain = np.array([_has_letter(block, i) for i in range(n)])
    names = [model.labels[b] if ok else UNKNOWN for b, ok in zip(means.argmax(axis=1), plain)]
    scores = np.where(plain, np.minimum(means.max(axis=1), 1.0), 0.0).tolist()
    return names, scores, _segments(found.argmax(axis=1), block.bounds, model.labels)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key, lang_pred, score`` and ``segments``, the stretches of words of one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(state, rows: pa.RecordBatch) -> pa.RecordBatch:
        reader, model = state
        parts = [_predicted(model, block) for block in reader.blocks(rows.column(1))]
        segments = pa.concat_arrays([s for _, _, s in parts]) if parts else pa.array([], _SEGMENT_TYPE)
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array([x for names, _, _ in parts for x in names], pa.string()),
             pa.array([x for _, scores, _ in parts for x in scores], pa.float64()), segments],
            names=[key, "lang_pred", "score", "segments"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), run, f"`{key}` {kind}, lang_pred string, score double, segments {_SEGMENTS}",
                  lambda: (WordReader(LETTER, LOWER), shared.value))


def keep_known(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows whose text has a language with at least this score, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(state, rows: pa.RecordBatch) -> pa.RecordBatch:
        reader, model = state
        keep = [name != UNKNOWN and score >= least
                for block in reader.blocks(rows.column(at)) for name, score in zip(*_predicted(model, block)[:2])]
        return rows.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, run, docs.schema, lambda: (WordReader(LETTER, LOWER), shared.value))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, eligible: Column | None = None) -> Model:
    """The field learned from the rows that are not held out."""
    lines = sample_lines(docs, ~held_out() if eligible is None else eligible)
    return train([tuple(r) for r in lines.collect()])    # at most SAMPLE_LINES a language


def language_report(docs: DataFrame) -> DataFrame:
    flagged = docs.select("doc_id", "text", "lang")
    found = identify(flagged, learn(flagged)).select("doc_id", "lang_pred", "score")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
