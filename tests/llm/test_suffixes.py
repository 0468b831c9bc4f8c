"""Byte dedup against all strings counted."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexstrata.llm import suffixes

DOCS = "doc_id long, text string"
N = suffixes.LENGTH


def plain(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + N] for t in texts for i in range(len(t) - N + 1))
    out = []
    for (key, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - N + 1):
            if seen[t[i:i + N]] > 1:
                gone[i:i + N] = [True] * N
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def _text(rng, n, letters="abcdefgh é"):
    return "".join(rng.choice(letters) for _ in range(n))


def _rows(seed, n=60):
    rng = random.Random(seed)
    passage = _text(rng, 700)
    rows = []
    for i in range(n):
        kind = rng.randrange(8)
        if kind == 0:
            text = _text(rng, rng.randint(0, 500), "ab")
        elif kind == 1:
            a = rng.randrange(400)
            text = _text(rng, rng.randint(0, 60)) + passage[a:a + rng.randint(190, 300)] + _text(rng, rng.randint(0, 60))
        elif kind == 2:
            text = "ha" * rng.randint(50, 300) + _text(rng, 20)
        elif kind == 3:
            text = passage[:300] + _text(rng, 5) + passage[:250]
        elif kind == 4:
            at = rng.randrange(700)
            text = passage[:at] + "#" + passage[at + 1:]
        elif kind == 5:
            text = "".join(chr(97 + bin(k).count("1") % 2) for k in range(rng.randint(100, 900)))
        else:
            text = _text(rng, rng.randint(0, 900))
        rows.append((i, text))
    return rows


def _got(df):
    return sorted((tuple(r)[:4] + (bytes(r[4]),) for r in suffixes.remove_repeated_bytes(df).collect()), key=repr)


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 5), (3, 8)])
def test_dedup_against_all_strings(spark, seed, parts):
    rows = _rows(seed)
    assert _got(spark.createDataFrame(rows, DOCS).repartition(parts)) == plain(rows)


@pytest.mark.parametrize("setting", [{"HOT_LEAST": 3}, {"PIECE": 256, "SLICE": 500}, {"BROADCAST_ROWS": 0, "PART_BYTES": 1000}])
def test_hot_prefixes_pieces_and_parts(spark, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(suffixes, name, value)
    line = _text(random.Random(5), 230)
    rows = _rows(6, 30) + [(100 + i, _text(random.Random(i), 30) + line[:200 + i % 31] + _text(random.Random(-i), 40)) for i in range(40)]
    assert _got(spark.createDataFrame(rows, DOCS).repartition(4)) == plain(rows)


def test_equal_strings_pick_alike():
    """Whatever stands around a string, it picks the same position of itself."""
    rng = random.Random(7)
    names = suffixes.Names()
    for trial in range(100):
        letters = rng.choice(["a", "ab", "abcdefghij é"])
        string = _text(rng, N, letters).encode()[:N]
        found = set()
        for _ in range(4):
            before, after = _text(rng, rng.randint(0, 200), letters).encode(), _text(rng, rng.randint(0, 200), letters).encode()
            data = before + string + after
            piece = suffixes.Piece(np.frombuffer(data, np.uint8), np.array([0]), np.array([0, len(data)]), np.array([0]))
            at, first, last = suffixes.picked(piece, names.read(piece.data))
            which = int(np.searchsorted(last, len(before)))
            assert first[which] <= len(before) <= last[which] and at[which] + suffixes.PREFIX <= len(before) + N
            found.add(int(at[which]) - len(before))
        assert len(found) == 1, trial


def test_ranks_by_growing_offsets():
    rng = random.Random(9)
    data = b"".join(rng.choice([b"x" * 64, b"y" * 64, b"z" * 50, b"xy" * 30]) for _ in range(60))
    starts = np.arange(len(data) - N + 1)
    names = suffixes.Names().read(np.frombuffer(data, np.uint8))
    seen = Counter(data[i:i + N] for i in starts)
    marked = np.zeros(len(starts), bool)
    assert sorted(suffixes.ranked(names, starts, marked).tolist()) == [i for i in starts if seen[data[i:i + N]] > 1]
    marked[:] = True
    assert len(suffixes.ranked(names, starts, marked)) == len(starts)


def test_long_texts_are_taken_in_pieces():
    long = "".join(f"{i} " for i in range(400_000))
    found = list(suffixes.pieces(pa.array(["short", long, None, "x" * 300])))
    strings = sum(len(suffixes._starts(p.bounds)) for p in found)
    assert strings == len(long) - N + 1 + 101 and max(len(p.data) for p in found) < suffixes._PLACES


def test_odd_documents(spark, odd, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert _got(odd) == plain(rows)
    assert suffixes.remove_repeated_bytes(no_docs).count() == 0
    rng = random.Random(11)
    a, b = _text(rng, 260), _text(rng, 300)
    rows = [(1, a), (1, b), (1, "short"), (None, a), (None, a), (2, "lead " + b[:220]), (3, _text(rng, 250)), (0, b), (None, b)]
    assert _got(spark.createDataFrame(rows, DOCS)) == plain(rows)
