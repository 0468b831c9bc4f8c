"""SentencePiece encoding by a table of prefixes, and decoding.

For every prefix of a stretch of text the table holds the one last token of its
encoding: among the vocabulary tokens that end there (found by an automaton), the
one that may follow the last token of the prefix before it. Two tokens may stand
side by side when merging their joined text by itself gives those two back; the
answers are kept. The ids are then read from the end of the table backwards.

Texts are cut first where no token can reach across: before a space mark that
follows another character, and around characters that stand in no longer token.
A stretch of up to ``LONGEST`` characters is remembered by the task once it is encoded, in two
generations of bounded size: what is met again moves to the younger one, the older one
goes when that is full. Stretches with two space marks in a row are merged pair by pair instead, since the tokens made
of space marks alone share one score and the table needs an order.

Only models of merge type with byte fallback, the identity normalizer and a leading
space mark are read; others raise an error.

Defined results: a null or empty text encodes to the begin and end ids alone and
decodes to an empty text; repeated rows are answered each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .words import mapped

REMEMBERED = 150_000       # stretches of a generation
LONGEST = 64               # characters of a stretch that is remembered
REMEMBERED_PAIRS = 400_000    # answers of the pair test
SPACE_MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def read_model(path: str) -> list[tuple[str, float, int]]:
    """Piece, score and type of each id."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
    trained, normal = model.trainer_spec, model.normalizer_spec
    kinds = {p.type for p in model.pieces}
    if (trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix
            or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix
            or not normal.escape_whitespaces or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}):
        raise ValueError(f"not a merge model with byte fallback and identity normalizer: {path}")
    return [(p.piece, p.score, p.type) for p in model.pieces]


class Encoder:
    """Ids of texts; make one per task."""

    def __init__(self, model: list[tuple[str, float, int]], remembered: int = REMEMBERED):
        self.ids = {piece: i for i, (piece, _, kind) in enumerate(model) if kind == _NORMAL}
        self.score = {piece: score for piece, score, kind in model if kind == _NORMAL}
        self.bytes = {int(piece[3:5], 16): i for i, (piece, _, kind) in enumerate(model) if kind == _BYTE}
        self.begin, self.end = (next(i for i, (piece, _, _) in enumerate(model) if piece == p) for p in ("<s>", "</s>"))
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        longer = [p for p in self.ids if len(p) > 1]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in longer):
            raise ValueError("a token has a space mark behind another character")
        self.cut = re.compile(self._cuts(longer)).findall
        self.beside: dict[str, dict[str, bool]] = {}    # left token ("" at the start): right token: may they stand so
        self.pairs = 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.remembered = remembered
        self.packed = {piece: self._packed([i]) for piece, i in self.ids.items()}

    @staticmethod
    def _cuts(longer: list[str]) -> str:
        """Stretches that no token reaches across: characters found in no longer token, and letters before a mark no token joins to a letter."""
        joined = set("".join(longer))
        after_letter = {b for p in longer for a, b in zip(p, p[1:]) if a.isalpha()}
        plain = [chr(c) for c in range(128) if not chr(c).isalnum()]
        alone = "".join(re.escape(c) for c in plain if c not in joined)
        marks = "".join(re.escape(c) for c in plain if c not in after_letter)
        letters = f"{SPACE_MARK}*[^\\W\\d_]+(?=[{SPACE_MARK}{marks}]|$)"
        return f"{letters}|{SPACE_MARK}*[^{SPACE_MARK}{alone}]+|{SPACE_MARK}+|[{alone}]"

    def encode(self, text: str | None) -> np.ndarray:
        """Ids with the begin and end ids around them."""
        return np.frombuffer(self._packed([self.begin]) + self._body(text or "") + self._packed([self.end]), "<u4")

    def _body(self, text: str) -> bytes:
        if not text:
            return b""
        stretches = self.cut(SPACE_MARK + text.replace(" ", SPACE_MARK))
        found = list(map(self.known.get, stretches))
        if None in found:
            found = [self._ids_of(s) if ids is None else ids for s, ids in zip(stretches, found)]
        return b"".join(found)

    def _ids_of(self, stretch: str) -> bytes:
        if (ids := self.known.get(stretch)) is not None:
            return ids
        if (ids := self.older.get(stretch)) is None:
            packed = self.packed
            ids = b"".join([packed[t] if t in packed else self._bytes_of(t) for t in self.tokens(stretch)])
        if len(stretch) <= LONGEST:
            if len(self.known) >= self.remembered:
                self.known, self.older = {}, self.known
            self.known[stretch] = ids
        return ids

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _bytes_of(self, token: str) -> bytes:
        return self._packed([self.bytes[b] for b in token.encode("utf-8", "surrogatepass")])

    def _after(self, token: str) -> dict[str, bool]:
        """What is known of the tokens behind this one."""
        fits = self.beside.get(token)
        return self.beside.setdefault(token, {}) if fits is None else fits

    def _fits(self, before: str, token: str) -> bool:
        """Whether merging the joined text by itself gives the two tokens back."""
        self.pairs += 1
        if self.pairs > REMEMBERED_PAIRS:
            self.beside, self.pairs = {}, 0
        return self.merged(before + token) == ([before, token] if before else [token])

    def tokens(self, stretch: str) -> list[str]:
        if SPACE_MARK * 2 in stretch:
            return self.merged(stretch)
        last: list[str | None] = [None] * len(stretch) + [""]    # of the prefix up to each character; the empty prefix stands at -1
        after: list[dict[str, bool] | None] = [None] * len(stretch) + [self._after("")]
        for at, (token, size) in self.automaton.iter(stretch):
            if after[at] is None and (fits := after[at - size]) is not None:
                fit = fits.get(token)
                if fit is None:
                    fit = fits[token] = self._fits(last[at - size], token)
                if fit:
                    last[at], after[at] = token, self._after(token)
        if None in last:    # a character that no token has: merge as defined
            return self.merged(stretch)
        out, i = [], len(stretch) - 1
        while i >= 0:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def merged(self, text: str) -> list[str]:
        """The definition: merge the neighbours of best score, the leftmost of equals, until none is a token."""
        score, symbols, n = self.score, list(text), len(text)
        if n <= 24:
            while True:
                best, at = None, -1
                for i in range(len(symbols) - 1):
                    s = score.get(symbols[i] + symbols[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if best is None:
                    return symbols
                symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := score.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-s, i, j, len(symbols[i]) + len(symbols[j])))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or right[i] != j or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            push(left[i], i)
            push(i, right[i])
        return [s for s in symbols if s]


class Decoder:
    """Texts of ids, many at once."""

    def __init__(self, model: list[tuple[str, float, int]]):
        surface = [b"" if kind == _CONTROL else bytes([int(piece[3:5], 16)]) if kind == _BYTE
                   else " ⁇ ".encode() if kind == _UNKNOWN else piece.replace(SPACE_MARK, " ").encode()
                   for piece, _, kind in model]
        self.sizes = np.array([len(s) for s in surface])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(surface), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        text = self.data[np.repeat(self.starts[ids], sizes) + within].tobytes()
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` with begin and end ids."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(encoder: Encoder, rows: pa.RecordBatch) -> pa.RecordBatch:
        ids = [encoder.encode(t.as_py()).astype(np.int32) for t in rows.column(1)]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), run, f"`{key}` {kind}, ids array<int>", lambda: Encoder(model.value))


def decode_ids(encoded: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` of id lists; null ids give a null text."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(decoder: Decoder, rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if not v.is_valid else decoder.decode(v.values.to_numpy(zero_copy_only=False)) for v in rows.column(1)]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return mapped(encoded.select(key, ids), run, f"`{key}` {kind}, text string", lambda: Decoder(model.value))


def encoding_report(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digests of the ids and of the texts decoded from them, in one pass."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(state: tuple[Encoder, Decoder], rows: pa.RecordBatch) -> pa.RecordBatch:
        encoder, decoder = state
        counts, ids_hex, text_hex = [], [], []
        for t in rows.column(1):
            ids = encoder.encode(t.as_py())
            counts.append(len(ids))
            ids_hex.append(hashlib.sha256(ids.tobytes()).hexdigest())
            text_hex.append(hashlib.sha256(decoder.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(text_hex)],
                                          names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), run,
                  f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                  lambda: (Encoder(model.value), Decoder(model.value)))


def tokenized(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """The rows with ``n_tokens, ids`` in place of the text, and ``decodes``: whether the ids give the text back.

    Space marks in a text come back as spaces.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    others = [f for f in docs.schema if f.name != text]
    at = docs.columns.index(text)

    def run(state: tuple[Encoder, Decoder], rows: pa.RecordBatch) -> pa.RecordBatch:
        encoder, decoder = state
        texts = [t or "" for t in rows.column(at).to_pylist()]
        ids = [encoder.encode(t) for t in texts]
        same = [decoder.decode(i) == t.replace(SPACE_MARK, " ") for i, t in zip(ids, texts)]
        kept = [i for i in range(rows.num_columns) if i != at]
        columns = [rows.column(i) for i in kept] + [pa.array([len(i) for i in ids], pa.int64()),
                                                    pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(same)]
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in others] + ["n_tokens", "ids", "decodes"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["n_tokens long", "ids array<int>", "decodes boolean"])
    return mapped(docs, run, schema, lambda: (Encoder(model.value), Decoder(model.value)))
