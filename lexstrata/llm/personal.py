"""Personal data by a character-level bidirectional LSTM with CRF transitions, beside fixed base patterns.

The network is trained in numpy from labelled spans: lines of a bounded sample of
the documents, into which generated addresses, numbers and secrets are written, with
numbers that are none as counter-examples. It reads text in windows of ``WINDOW``
characters, one every ``STRIDE``; each is decoded by itself and the spans of all
windows of a text are then reconciled: the surest first, none overlapping another.
Pieces of one kind that window edges have cut are joined where they overlap or touch,
with whole pieces that they overlap; a joined span too long to be sure of lying whole
in some window goes first, a shorter one gives way to the window that holds it whole.

Windows are read where something may stand (``_clues``): digits and ``@``, a run of
``LONG_RUN`` characters without a space, a value of ``LONG_VALUE`` after ``=`` or
``:``, an address with its signs spelled out. Decoding admits any span in a window that
is read, but what stands in a window without a clue is not found, however sure the
network would be: a secret of letters of up to ``LONG_RUN`` characters that follows no
``=`` or ``:``, a name, an address spelled out in other ways. Learned spans below
``SHORTEST`` characters are dropped. Training lines are cut at 400 characters.

Base patterns always stay. A learned span is added where it meets no base span, is
sure enough, and keeps the kind's own rule (card check digit, address parts, number
of digits).

Defined results: a null or empty text has no spans; equal sure spans go to the
earlier one; repeated rows are answered each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import marginals
from .words import mapped

KINDS = ("email", "ip", "card", "phone", "secret")
WINDOW, STRIDE = 256, 128
SURE = 0.9
SHORTEST = 6
SAMPLE_DOCS, SAMPLE_LINES = 300, 1200
HIDDEN, CODES = 16, 132
TRAIN_LENGTH, TRAIN_BATCH, TRAIN_STEPS, RATE = 72, 48, 180, 0.02
_TAGS = 1 + 2 * len(KINDS)    # outside, then begin and inside of each kind
_NEVER = -1e4

LONG_RUN, LONG_VALUE = 16, 12
_CLUE = re.compile("[0-9@]")    # every base pattern has one
_VALUE = re.compile(rf"""[=:][ \t]{{0,2}}["']?[!-~]{{{LONG_VALUE},}}""")
_SPELLED = re.compile(r"[ (\[{<]at(?:[)\]}>]|[ ]+[\w-]+(?:\.[a-z]|[ ]+dot[ ]))", re.I)
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if c in "0123456789"]


def luhn(text: str) -> bool:
    digits = _digits(text)[::-1]
    return (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0


def _is_card(text: str) -> bool:
    return 13 <= len(_digits(text)) <= 19 and luhn(text)


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))


def _is_phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind, start and end of the base patterns, by kind and start. Long runs cost no more than their length."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _DOMAIN.match(text, at + 1)
        if start < at and host:
            out.append((0, start, host.end()))
            done = host.end()
        at = text.find("@", max(at + 1, done))
    for kind, pattern, rule in ((1, _IP, _is_ip), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if rule(m[0])]
    return out


def _clues(text: str) -> np.ndarray:
    """Start and end of the places that may belong to a span."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = np.flatnonzero(((points >= 48) & (points <= 57)) | (points == 64))
    breaks = np.concatenate([[-1], np.flatnonzero((points < 33) | (points > 126)), [len(points)]])
    long = np.flatnonzero(np.diff(breaks) > LONG_RUN)
    told = [m.span() for pattern in (_VALUE, _SPELLED) for m in pattern.finditer(text)]
    return np.concatenate([np.stack([marks, marks + 1], axis=1), np.stack([breaks[long] + 1, breaks[long + 1]], axis=1),
                           np.array(told, np.int64).reshape(-1, 2)])


def _codes(text: str) -> np.ndarray:
    """Characters as small numbers: ASCII from 1, then other letters, other characters; 0 pads."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points + 1, np.where(points < 0x2000, 129, 130)).astype(np.int16)


@dataclass
class Network:
    """Weights: input and recurrent per direction, output, transitions, start."""

    enter: np.ndarray    # direction x code x 4 hidden
    again: np.ndarray    # direction x hidden x 4 hidden
    out: np.ndarray      # 2 hidden x tag
    bias: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.enter, self.again, self.out, self.bias, self.moves, self.start]


def _blank(rng: np.random.Generator) -> Network:
    enter = rng.normal(0, 0.3, (2, CODES, 4 * HIDDEN))
    enter[:, :, HIDDEN:2 * HIDDEN] += 1    # remember at first
    return Network(enter, rng.normal(0, 0.25, (2, HIDDEN, 4 * HIDDEN)), rng.normal(0, 0.2, (2 * HIDDEN, _TAGS)),
                   np.zeros(_TAGS), np.zeros((_TAGS, _TAGS)), np.zeros(_TAGS))


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Penalties: inside follows only begin or inside of its kind, and never starts."""
    moves, start = np.zeros((_TAGS, _TAGS)), np.zeros(_TAGS)
    for kind in range(len(KINDS)):
        begin, inside = 1 + 2 * kind, 2 + 2 * kind
        moves[:, inside], start[inside] = _NEVER, _NEVER
        moves[[begin, inside], inside] = 0
    return moves, start


def _both_ways(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as they are and reversed within their lengths, and the places that undo it."""
    at = np.arange(codes.shape[1])
    back = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.stack([codes, np.take_along_axis(codes, back, 1)]), back


def _read(net: Network, ways: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states, direction x window x place x hidden."""
    _, n, steps = ways.shape
    h = c = np.zeros((2, n, HIDDEN), net.again.dtype)
    hidden = np.empty((2, n, steps, HIDDEN), net.again.dtype)
    way = np.arange(2)[:, None]
    for t in range(steps):
        z = net.enter[way, ways[:, :, t]] + h @ net.again
        gates = 1 / (1 + np.exp(-z[..., :3 * HIDDEN]))
        fresh = np.tanh(z[..., 3 * HIDDEN:])
        before = c
        c = gates[..., HIDDEN:2 * HIDDEN] * c + gates[..., :HIDDEN] * fresh
        bent = np.tanh(c)
        if keep is not None:
            keep.append((h, before, gates, fresh, bent))
        h = gates[..., 2 * HIDDEN:] * bent
        hidden[:, :, t] = h
    return hidden


def _joined(hidden: np.ndarray, back: np.ndarray) -> np.ndarray:
    return np.concatenate([hidden[0], np.take_along_axis(hidden[1], back[:, :, None], 1)], axis=2)


def _gradients(net: Network, codes: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
    """Slopes of the CRF likelihood of a batch of equally long windows, by backpropagation through time."""
    n, steps = codes.shape
    ways, back = _both_ways(codes, np.full(n, steps))
    kept: list = []
    states = _joined(_read(net, ways, kept), back)
    limit, first_limit = _allowed()
    pairs = np.zeros((_TAGS, _TAGS))
    first = np.arange(n) * steps
    scores = (states @ net.out + net.bias).reshape(-1, _TAGS)
    found = marginals(scores, first, np.full(n, steps), net.moves + limit, net.start + first_limit, pairs)
    slope = -found
    slope[np.arange(n * steps), tags.ravel()] += 1
    gold = np.zeros_like(pairs)
    np.add.at(gold, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    slope3 = slope.reshape(n, steps, _TAGS)
    d_out = states.reshape(-1, 2 * HIDDEN).T @ slope
    d_states = slope3 @ net.out.T
    d_hidden = np.stack([d_states[..., :HIDDEN], np.take_along_axis(d_states[..., HIDDEN:], back[:, :, None], 1)])
    d_enter, d_again = np.zeros_like(net.enter), np.zeros_like(net.again)
    dh, dc = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN))
    for t in range(steps - 1, -1, -1):
        h, before, gates, fresh, bent = kept[t]
        i, f, o = (gates[..., k * HIDDEN:(k + 1) * HIDDEN] for k in range(3))
        dh = dh + d_hidden[:, :, t]
        dc = dc + dh * o * (1 - bent * bent)
        dz = np.concatenate([dc * fresh * i * (1 - i), dc * before * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - fresh * fresh)], axis=2)
        for way in range(2):
            np.add.at(d_enter[way], ways[way, :, t], dz[way])
        d_again += h.transpose(0, 2, 1) @ dz
        dh, dc = dz @ net.again.transpose(0, 2, 1), dc * f
    moves = np.where(limit < 0, 0, gold - pairs)
    starts = slope[first].sum(axis=0) * (first_limit == 0)
    return [g / n for g in (d_enter, d_again, d_out, slope.sum(axis=0), moves, starts)]


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_ONSETS = [*"bcdfghjklmnprstvwy", "st", "tr", "ch", "sh", "th", "bl", "gr", "fl", "qu", ""]
_CODAS = ["", "", "", "n", "r", "t", "s", "l", "ck", "ng", "tt", "rs", "nd", "y", "e"]


def _word(rng: random.Random, lo: int, hi: int) -> str:
    """Letters that can be spoken."""
    part = lambda: rng.choice(_ONSETS) + rng.choice("aeiou") + rng.choice(_CODAS)
    out = "".join(part() for _ in range(hi))
    return out[:rng.randint(lo, hi)]


def _made(rng: random.Random, kind: int) -> tuple[str, str, str]:
    """A generated span with what stands around it."""
    pick = rng.choice
    some = lambda chars, lo, hi: "".join(rng.choices(chars, k=rng.randint(lo, hi)))
    digits = lambda n: some("0123456789", n, n)
    if kind == 0:
        name = some(_LETTERS, 3, 9) + pick(["", ".", "_", "-"]) + pick([digits(2), some(_LETTERS, 2, 6)])
        host = some(_LETTERS, 3, 8) + pick(["", digits(1)]) + pick([".example", ".mail", ""]) + pick([".com", ".org", ".net", ".de"])
        if rng.random() < 0.15:    # spelled out
            return "", name + pick([" at ", "(at)", "[at]", " (at) "]) + host.replace(".", pick([" dot ", "."])), ""
        return "", name + pick(["@", "@", "@", " @ ", "[@]"]) + host, ""
    if kind == 1:
        return "", ".".join(str(rng.randrange(256)) for _ in range(4)), pick(["", ":8080", "/24"])
    if kind == 2:
        between = pick(["", "", " ", "-", "."])
        while True:
            number = pick("3456") + digits(15)
            if luhn(number):
                return "", between.join(number[i:i + 4] for i in range(0, 16, 4)), ""
    if kind == 3:
        area, mid, end = digits(3), digits(3), digits(4)
        return "", pick([f"+{digits(1)} ({area}) {mid}-{end}", f"+{digits(2)} {area} {mid}{end}", f"({area}) {mid}-{end}",
                         f"{area}-{mid}-{end}", f"+{digits(1)}-{area}-{mid}-{end}"]), ""
    if kind == 4:
        mixed = _LETTERS + _LETTERS.upper()
        secret = pick([some("0123456789abcdef", 16, 40), some(mixed + "0123456789", 20, 40),
                       pick([some(_LETTERS, 12, 32), some(mixed, 12, 40)]), _word(rng, 12, 28), _word(rng, 12, 28)])
        form = rng.random()
        if form < 0.15:
            return "", "AKIA" + pick([some(_LETTERS.upper() + "0123456789", 16, 16), some(_LETTERS.upper(), 16, 16)]), ""
        if form < 0.23:
            return "", some(mixed, 20, 40), ""
        if form < 0.33:    # longer than a training window
            secret = some(mixed + "0123456789" + pick(["", "-_", "-_."]), 80, 200)
        word, sign = pick(["password", "token", "secret", "api_key", "passwd"]), pick(["=", " = ", ": ", ":"])
        quote = pick(["", '"', "'"])
        return word + sign + quote, secret, quote
    if rng.random() < 0.3:    # long words, paths and plain values
        word = lambda: _word(rng, 3, 9)
        return "", pick([_word(rng, 12, 20), f"{word()}-{word()}-{word()}", f"www.{word()}.com/{word()}/{word()}", f"{word()}_{word()}_{word()}",
                         f"{word()}: {word()}", f"{word()} at {word()}", f"{word()}: {word()} {word()}"]), ""
    return "", pick([digits(1), digits(2), f"{pick('12')}{digits(3)}", f"{digits(1)}.{digits(1)}", f"{digits(2)},{digits(3)}",
                     f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"{digits(2)}:{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}",
                     f"({digits(1)})", f"{digits(5)}", f"{some(_LETTERS, 2, 5)}{digits(1)}", digits(16), f"#{digits(6)}"]), ""


def _labelled(rng: random.Random, lines: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: clean text with two or three generated pieces."""
    codes, tags = np.zeros((n, TRAIN_LENGTH), np.int16), np.zeros((n, TRAIN_LENGTH), np.int64)
    for row in range(n):
        text, spans = "", []
        while len(text) < 2 * TRAIN_LENGTH:
            line = rng.choice(lines)
            at = rng.randrange(len(line))
            kind = rng.randrange(len(KINDS) + 2)
            before, piece, after = _made(rng, kind)
            text += line[at:at + rng.randrange(4, 40)] + " "[:rng.randrange(8)] + before
            if kind < len(KINDS):
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + after + rng.choice(["", " ", ".", ", ", "\n"])
        lo = rng.randrange(len(text) - TRAIN_LENGTH)
        codes[row] = _codes(text[lo:lo + TRAIN_LENGTH])
        for kind, a, b in spans:
            a, b = max(a - lo, 0), min(b - lo, TRAIN_LENGTH)
            if a < b:
                tags[row, a:b] = 2 + 2 * kind
                tags[row, a] = 1 + 2 * kind
    return codes, tags


def train(lines: list[str], steps: int = TRAIN_STEPS) -> Network:
    """The network of a sample of lines; only lines without digits, signs of addresses and long values are used as surroundings."""
    rng = random.Random(5)
    clean = [x for x in sorted(set(lines)) if len(x) > 3 and not any(p.search(x) for p in (_CLUE, _VALUE, _SPELLED))] or ["the quick brown fox jumps over the dog"]
    net = _blank(np.random.default_rng(5))
    parts = net.parts()
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for t in range(1, steps + 1):
        rate = RATE * min(1.0, 2.0 * (1 - t / (steps + 1)))
        slopes = _gradients(net, *_labelled(rng, clean, TRAIN_BATCH))
        size = np.sqrt(sum(float((g * g).sum()) for g in slopes))
        for p, g, m, s in zip(parts, slopes, mean, square):
            g = g * min(1.0, 5.0 / (size + 1e-12))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p += rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-8)
    return Network(*[p.astype(np.float32) for p in net.parts()])


def decode(net: Network, windows: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
    """Kind, start, end and sureness of the spans on the best path of each window."""
    order = sorted(range(len(windows)), key=lambda i: -len(windows[i]))
    lengths = np.array([len(windows[i]) for i in order])
    codes = np.zeros((len(order), int(lengths[0])), np.int16)
    for row, i in enumerate(order):
        codes[row, :lengths[row]] = windows[i]
    ways, back = _both_ways(codes, lengths)
    scores = (_joined(_read(net, ways), back) @ net.out + net.bias).astype(np.float64)
    limit, first_limit = _allowed()
    moves, start = net.moves + limit, net.start + first_limit
    n, steps, _ = scores.shape
    sure = marginals(scores.reshape(-1, _TAGS), np.arange(n) * steps, lengths, moves, start).reshape(scores.shape)
    from_tag = np.zeros((n, steps, _TAGS), np.int8)
    best = start + scores[:, 0]
    for t in range(1, steps):
        live = int(np.searchsorted(-lengths, -t, "left"))
        ahead = best[:live, :, None] + moves
        from_tag[:live, t] = ahead.argmax(axis=1)
        best[:live] = ahead.max(axis=1) + scores[:live, t]
    tag = best.argmax(axis=1)
    path = np.zeros((n, steps), np.int64)
    for t in range(steps - 1, -1, -1):
        inside = t < lengths
        path[inside, t] = tag[inside]
        if t:
            tag = np.where(inside, from_tag[np.arange(n), t, tag], tag)
    out: list[list] = [[] for _ in windows]
    for row, i in enumerate(order):
        own = path[row, :lengths[row]]
        for a in np.flatnonzero(own % 2 == 1):
            b = a + 1
            while b < len(own) and own[b] == own[a] + 1:
                b += 1
            out[i].append(((int(own[a]) - 1) // 2, int(a), int(b), float(sure[row, np.arange(a, b), own[a:b]].mean())))
    return out


def _windows(text: str) -> list[tuple[int, int]]:
    """The windows of a text that meet a clue."""
    clues = _clues(text)
    if not len(clues):
        return []
    first, last = clues[:, 0] // STRIDE - WINDOW // STRIDE + 1, (clues[:, 1] - 1) // STRIDE
    sizes = last - first + 1
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = np.unique(np.repeat(first, sizes) + step)
    return [(int(p) * STRIDE, min(int(p) * STRIDE + WINDOW, len(text))) for p in places if p >= 0]


_RULES = (lambda s: "@" in s or _SPELLED.search(s) is not None, _is_ip, _is_card, _is_phone, lambda s: len(s) >= 12)


def _whole(found: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int, float]]:
    """Joined spans of pieces that window edges have cut, each place as sure as the surest piece there."""
    out = []

    def close(kind: int, group: list) -> None:
        if len(group) > 1 and any(cut for *_, cut in group):
            a, b = group[0][0], max(y for _, y, _, _ in group)
            sure = np.zeros(b - a)
            for x, y, s, _ in group:
                sure[x - a:y - a] = np.maximum(sure[x - a:y - a], s)
            out.append((kind, a, b, float(sure.mean())))

    for kind in sorted({f[0] for f in found}):
        group, end, open_cut = [], -1, False
        for a, b, sure, cut in sorted(f[1:] for f in found if f[0] == kind):
            if group and not (a < end or a == end and cut and open_cut):
                close(kind, group)
                group = []
            open_cut = cut if not group or b > end else open_cut or (cut and b == end)
            end = b if not group else max(end, b)
            group.append((a, b, sure, cut))
        close(kind, group)
    return out


def reconcile(text: str, base: list[tuple[int, int, int]], found: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int]]:
    """Base spans and the learned ones that hold beside them; ``found`` ends with whether the window's edge cut the span.

    Joined spans longer than windows overlap go first, then whole pieces, shorter joined spans, cut pieces by themselves.
    """
    kept = [(k, a, b) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    ranked = [(3 if cut else 1, -sure, a, b, kind) for kind, a, b, sure, cut in found]
    ranked += [(0 if b - a > WINDOW - STRIDE else 2, -sure, a, b, kind) for kind, a, b, sure in _whole(found)]
    for _, less, a, b, kind in sorted(ranked):
        piece = text[a:b]
        try:
            fits = b - a >= SHORTEST and -less >= SURE and _RULES[kind](piece)
        except ValueError:
            fits = False
        if fits and not any(a < y and x < b for x, y in taken):
            kept.append((kind, a, b))
            taken.append((a, b))
    return sorted(kept)


def find_spans(net: Network, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: kind, start, end in code points."""
    out: list[list] = [[] for _ in texts]
    todo = []
    for i, text in enumerate(texts):
        todo += [(i, a, b) for a, b in _windows(text)]
    found: dict[int, list] = {}
    for lo in range(0, len(todo), 256):
        part = todo[lo:lo + 256]
        for (i, a, b), spans in zip(part, decode(net, [_codes(texts[i][a:b]) for i, a, b in part])):
            size = len(texts[i])
            found.setdefault(i, []).extend(
                (k, a + x, a + y, sure, (x == 0 and a > 0) or (y == b - a and b < size)) for k, x, y, sure in spans)
    for i, spans in found.items():
        out[i] = reconcile(texts[i], base_spans(texts[i]), spans)
    return out


def learn(docs: DataFrame, text: str = "text") -> Network:
    """Trained from lines of at most ``SAMPLE_DOCS`` documents, chosen by hash."""
    hashed = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    top = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS)
    lines = hashed.join(F.broadcast(top), "h", "left_semi").dropDuplicates(["h"]) \
        .select("h", F.explode(F.split("t", "\n")).alias("line")).where(F.length("line") > 3)
    rows = lines.select(F.substring("line", 1, 400).alias("line")).orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES).collect()
    return train([r["line"] for r in rows])


_SPAN_SQL = "array<struct<kind: string, start: bigint, end: bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_personal(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key, base, spans``; spans are in the order of ``KINDS``, then by start."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in rows.column(1).to_pylist()]
        named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
        base = [named(base_spans(t)) if _CLUE.search(t) else [] for t in texts]
        spans = [named(s) for s in find_spans(shared.value, texts)]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(base, _SPAN_TYPE), pa.array(spans, _SPAN_TYPE)],
                                          names=[key, "base", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), run, f"`{key}` {kind}, base {_SPAN_SQL}, spans {_SPAN_SQL}")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with ``<KIND>`` in place of every span; of overlapping ones the earliest and longest."""
    out, done = [], 0
    for a, negative, kind in sorted((a, -b, k) for k, a, b in spans):
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind].upper()}>"]
            done = -negative
        elif -negative > done:
            done = -negative
    return "".join([*out, text[done:]])


def mask_personal(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The rows with every span of their text masked; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text)

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column(at).to_pylist()
        found = find_spans(shared.value, [t or "" for t in texts])
        new = pa.array([t if t is None else masked(t, s) for t, s in zip(texts, found)], pa.string())
        return rows.set_column(at, text, new)

    return mapped(docs, run, docs.schema)


def personal_report(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", "text")
    found = find_personal(own, learn(own))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
