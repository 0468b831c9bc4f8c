"""Language ID, personal data, SentencePiece and nearest neighbours: held-out cases, plain versions, round trips, odd inputs."""

import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lexstrata.llm import language, neighbours, personal, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# language ID

SYLLABLES = {"aa": ["the", "ing", "or", "an", "th"], "bb": ["der", "ung", "sch", "ein", "ß"], "cc": ["ción", "el", "ñ", "os", "arr"]}


def _text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)) + ".\n"


@pytest.fixture(scope="module")
def field():
    rng = random.Random(1)
    return language.train([(lang, _text(rng, lang, 12)) for lang in SYLLABLES for _ in range(150)])


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(1)
    scores, moves, start = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    weight, pairs = np.zeros((5, 3)), np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=5):
        w = np.exp(start[path[0]] + sum(scores[i, k] for i, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        for i, k in enumerate(path):
            weight[i, k] += w
        for a, b in zip(path, path[1:]):
            pairs[a, b] += w
    total = weight[0].sum()
    got_pairs = np.zeros((3, 3))
    got = language.marginals(scores, np.array([0]), np.array([5]), moves, start, got_pairs)
    assert np.allclose(got, weight / total) and np.allclose(got_pairs, pairs / total)


@pytest.mark.parametrize("k", [1, 3, 12])
def test_messages_cross_the_cuts(k):
    rng = np.random.default_rng(k)
    bounds = np.array([0, 0, 300, 307, 500, 500, 564, 629])    # in parts of 4 and of 64 words
    scores, moves, start = rng.normal(size=(629, k)), rng.normal(0, 2, (k, k)) + 3 * np.eye(k), rng.normal(size=k)
    order = np.argsort(-np.diff(bounds), kind="stable")
    uncut = language.marginals(scores, bounds[:-1][order], np.diff(bounds)[order], moves, start)
    for chain in (4, language.CHAIN):
        assert np.allclose(language.text_marginals(scores, bounds, moves, start, chain), uncut)


def test_labels_at_a_cut_are_those_of_the_uncut_text(field):
    rng = random.Random(8)
    words = [_text(rng, lang, 7).strip(" .\n") for lang in itertools.islice(itertools.cycle(["aa", "bb", "cc"]), 80)]
    block = next(language.WordReader(language.LETTER, language.LOWER).blocks(language.pa.array([" ".join(words)])))
    scores = language.word_scores(field, block)
    uncut = language.marginals(scores, block.bounds[:1], np.diff(block.bounds), field.transitions, field.start)
    segments = language._predicted(field, block)[2].to_pylist()[0]
    got = [s["lang"] for s in segments for _ in range(s["first_word"], s["last_word"] + 1)]
    assert len(got) > 8 * language.CHAIN and got == [field.labels[i] for i in uncut.argmax(axis=1)]
    assert np.allclose(language.text_marginals(scores, block.bounds, field.transitions, field.start), uncut)


def test_held_out_texts_and_switches(spark, field):
    rng = random.Random(2)
    rows = [(i, lang, _text(rng, lang, 40)) for i, lang in enumerate(list(SYLLABLES) * 40)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, lang string, text string"), field)
    want = {i: lang for i, lang, _ in rows}
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in got.collect()]) > 0.98
    mixed = spark.createDataFrame([(1, _text(rng, "aa", 50) + _text(rng, "bb", 50))], "doc_id long, text string")
    segments = language.identify(mixed, field).first()["segments"]
    assert [s["lang"] for s in segments] == ["aa", "bb"] and abs(segments[0]["last_word"] - 49) <= 2


def test_language_of_odd_input(spark, field, odd, no_docs):
    rows = [tuple(r)[:3] for r in language.identify(odd, field).collect()]
    got = {r[0]: r for r in rows}
    assert [got[i][1:] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[6][1] != "und" and len(rows) == odd.count()
    marks = spark.createDataFrame([(1, "123 !?"), (2, "😀😀"), (3, "日本")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in language.identify(marks, field).orderBy("doc_id").collect()] == [True, True, False]
    assert language.identify(no_docs, field).count() == 0
    blank = language.learn(no_docs)
    assert {r["lang_pred"] for r in language.identify(odd, blank).collect()} == {"und"}
    assert language.keep_known(odd, field, 0.0).columns == odd.columns


def test_nothing_is_learned_from_held_out_rows(spark):
    rows = [(i, "x" if i % 2 else "y", f"text {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    kept = {r["line"] for r in language.sample_lines(df, ~language.held_out()).collect()}
    out = {f"text {r[0]}" for r in df.where(language.held_out()).collect()}
    assert out and kept and not kept & out and kept | out == {r[2] for r in rows}


def test_sampled_lines_are_bounded(spark):
    words = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, "x", words), (2, "x", "a" * 100_000), (3, "x", "short line\nand  a second"), (4, "x", "b" + " " * 50_000 + "c")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    lines = [r["line"] for r in language.sample_lines(df, F.lit(True)).collect()]
    assert max(len(x.split()) for x in lines) == language.CHAIN and max(map(len, lines)) <= 272 * language.CHAIN
    assert sorted(w for x in lines for w in x.split() if w[0] == "w") == sorted(words.split())
    assert "".join(x.strip() for x in lines if "aaa" in x) == "a" * 100_000 and {"short line", "and  a second"} <= set(lines)
    few = language.sample_lines(df, F.lit(True), n_lines=5).collect()
    assert len(few) == 5 and sum(len(r["line"]) for r in few) <= 5 * 272 * language.CHAIN


# personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
RULES = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")),
         lambda s: 13 <= sum(c in "0123456789" for c in s) <= 19 and personal.luhn(s),
         lambda s: 9 <= sum(c in "0123456789" for c in s) <= 15]


def _plain(text):
    return [(k, m.start(), m.end()) for k in range(4) for m in re.finditer(PATTERNS[k], text) if RULES[k](m[0])]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choices("aZ9.1@+-( )_%٣é\n0", k=rng.randint(0, 25)))
        assert personal.base_spans(text) == _plain(text), text
    assert personal.base_spans("a" * 300_000 + " x@y.z " + "1" * 300_000)[0][0] == 0


def test_gradients_follow_the_likelihood():
    rng = np.random.default_rng(4)
    net = personal._blank(rng)
    codes, tags = personal._labelled(random.Random(1), ["some plain words stand here"], 3)
    limit, first = personal._allowed()

    def likelihood():
        n, steps = codes.shape
        ways, back = personal._both_ways(codes, np.full(n, steps))
        scores = personal._joined(personal._read(net, ways), back) @ net.out + net.bias
        total = 0.0
        for s, y in zip(scores, tags):
            gold = net.start[y[0]] + s[np.arange(steps), y].sum() + net.moves[y[:-1], y[1:]].sum()
            a = net.start + first + s[0]
            for t in range(1, steps):
                a = np.logaddexp.reduce(a[:, None] + net.moves + limit, axis=0) + s[t]
            total += gold + limit[y[:-1], y[1:]].sum() + first[y[0]] - np.logaddexp.reduce(a)
        return total / n

    slopes = personal._gradients(net, codes, tags)
    code = int(codes[0, 0])
    for part, slope, at in zip(net.parts(), slopes, [(0, code, 3), (1, 2, 40), (5, 1), (0,), (0, 0), (0,)]):
        kept = part[at]
        part[at] = kept + 1e-5
        up = likelihood()
        part[at] = kept - 1e-5
        down = likelihood()
        part[at] = kept
        assert abs((up - down) / 2e-5 - slope[at]) < 1e-4 * max(1, abs(slope[at]))


@pytest.fixture(scope="module")
def network():
    return personal.train([f"the {w} of words is here and there, said the {w}" for w in "man woman child house river".split()])


def test_network_finds_what_it_was_not_shown(network):
    rng = random.Random(99)
    found = want = wrong = 0
    for _ in range(150):
        kind = rng.choice([1, 2, 3, 4])
        before, piece, after = personal._made(rng, kind)
        text = "these are the first words and then " + before + piece + after + " comes before the last words"
        span = (kind, 35 + len(before), 35 + len(before) + len(piece))
        spans = personal.find_spans(network, [text])[0]
        want += 1
        found += any(a < span[2] and span[1] < b for _, a, b in spans)
        wrong += any(not (a < span[2] and span[1] < b) for _, a, b in spans)
    assert found / want > 0.85 and wrong / want < 0.05
    clean = "the year 2019 had 12 months and 365 days, see page 42 of volume 3 (section 4.2) at 10:30."
    assert personal.find_spans(network, [clean]) == [[]]


def test_windows_are_reconciled(network):
    text = "words " * 20 + "mail a.b@c.org or call +1 (556) 555-9070 now " + "x" * 300 + " password=0123456789abcdef0123 " + "words " * 40
    spans = personal.find_spans(network, [text])[0]
    assert set(_plain(text)) <= set(spans)
    assert all(b <= c for (_, _, b), (_, c, _) in itertools.pairwise(sorted(spans, key=lambda s: s[1])))
    assert personal.masked(text, spans).count("<EMAIL>") == 1 and "555-9070" not in personal.masked(text, spans)


def test_cut_pieces_are_joined():
    text = "x" * 100 + "S5" * 100 + "x" * 100
    cut = [(4, 100, 256, 0.95, True), (4, 128, 300, 0.99, True), (4, 256, 300, 0.96, True)]
    assert personal.reconcile(text, [], cut) == [(4, 100, 300)]
    assert personal.reconcile(text, [], [cut[0], (4, 131, 300, 0.99, False)]) == [(4, 100, 300)]
    assert personal.reconcile(text, [], [cut[0], cut[2]]) == [(4, 100, 300)]    # touching at the edge
    apart = [(4, 100, 120, 0.95, False), (4, 120, 150, 0.95, False)]
    assert personal.reconcile(text, [], apart) == [x[:3] for x in apart]
    assert personal.reconcile(text, [], [(4, 240, 256, 0.99, True), (4, 240, 300, 0.95, False)]) == [(4, 240, 300)]


def test_long_secrets_are_masked_whole(network):
    rng = random.Random(12)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts, spans = [], []
    for size in (129, 160, 200, 256, 257, 300, 400, 600):
        for offset in (0, 37, 100, 128, 200, 255):
            before = ("the words of a house are here " * 20)[:offset] + " token="
            texts.append(before + "".join(rng.choices(chars, k=size)) + " and the words of a river " * 4)
            spans.append((len(before), len(before) + size))
    found = personal.find_spans(network, texts)
    shares = [max((min(b, y) - max(a, x) for _, x, y in own), default=0) / (b - a) for own, (a, b) in zip(found, spans)]    # one span, not pieces
    assert np.mean(shares) > 0.97 and np.mean([s == 1 for s in shares]) > 0.8


def test_letter_only_secrets_and_spelled_addresses(network):
    rng = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = [("password=", "".join(rng.choices(letters, k=rng.randint(14, 30)))) for _ in range(40)]
    made += [("", "AKIA" + "".join(rng.choices(letters.upper(), k=16))) for _ in range(20)]
    made += [("", "".join(rng.choices(letters, k=7)) + rng.choice([" at ", "(at)", "[at]"]) + "".join(rng.choices(letters, k=6)) + ".com") for _ in range(20)]
    texts = ["the words of the house and then " + before + piece + " comes before the last words" for before, piece in made]
    found = personal.find_spans(network, texts)
    assert np.mean([any(x < 32 + len(before) + len(piece) and 32 + len(before) < y for _, x, y in own) for own, (before, piece) in zip(found, made)]) > 0.75
    piece = "S" * 20
    assert personal.reconcile(piece, [], [(4, 0, 20, 0.99, False)]) == [(4, 0, 20)]    # no digit, no sign
    assert personal._windows("x " * 300 + "password=correcthorsebattery") and personal._windows("x " * 300 + "jo.b(at)c.org")
    assert personal._windows("plain words here. " * 40) == []


def test_personal_data_of_odd_input(spark, network, odd, no_docs):
    got = {r["doc_id"]: r for r in personal.find_personal(odd, network).collect()}
    assert got[1]["spans"] == [] and got[2]["base"] == [] and len(got[4]["spans"]) == 0
    assert personal.find_personal(no_docs, network).count() == 0
    masked = personal.mask_personal(odd, network)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    assert masked.where("doc_id = 1").first()["text"] is None


# SentencePiece

MARKS = [" ", "  ", "   ", "a", "e", "the", "ing", "\n", "\t", "\r", ";", "▁", "é", "日本", "😀", "\x00", "1", "2", "}", "{", ")", "(",
         "<0x0A>", "<s>", "A", "er", "x", "_", "==", " ,", ".", "'", "!", "-"]


def test_ids_and_texts_are_the_library_s():
    model = pieces.read_model(MODEL)
    encoder, decoder = pieces.Encoder(model, remembered=500), pieces.Decoder(model)
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(7)
    texts = ["".join(rng.choices(MARKS, k=rng.randint(0, 16))) for _ in range(8000)] + ["", " " * 5000, "a" * 3000, "日" * 500]
    for text in texts:
        ids = encoder.encode(text)
        want = theirs.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want and decoder.decode(ids) == theirs.decode(want), text


def test_pieces_of_odd_input(spark, odd, no_docs):
    got = {r["doc_id"]: r for r in pieces.encode_texts(odd, MODEL).collect()}
    assert got[1]["ids"] == [1, 2] and got[2]["ids"] == [1, 2]
    back = {r["doc_id"]: r["text"] for r in pieces.decode_ids(pieces.encode_texts(odd, MODEL), MODEL).collect()}
    want = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert back == want
    assert pieces.encoding_report(odd, MODEL).count() == odd.count() and pieces.encoding_report(no_docs, MODEL).count() == 0
    assert pieces.tokenized(odd.select("doc_id", "text", "lang"), MODEL).where("not decodes").count() == 0


# nearest neighbours

def _answers(df, k=10, **more):
    rows = neighbours.nearest(df, F.col("vec_id") % 10 == 0, k=k, **more).collect()
    out = {}
    for r in sorted(rows):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_over_shards(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(1200, 16)) + rng.integers(0, 5, (1200, 1))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    hit = 0
    for query, found in _answers(df, shard_rows=300).items():
        gap = np.sqrt(((points - points[query]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(1200), gap)) if i != query][:10]
        hit += len({i for i, _ in found} & set(want))
        assert all(abs(gap[i] - s) < 1e-12 for i, s in found) and found == sorted(found, key=lambda x: (x[1], x[0]))
    assert hit / 1200 >= 0.9


def test_odd_vectors_and_equal_ones(spark):
    rows = [(0, [1.0, 0.0]), (10, None), (20, []), (30, [0.0, 0.0]), (40, [float("nan"), 1.0]), (50, [float("inf"), 1.0]), (60, [None, 1.0]),
            (70, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), *[(i, [2.0, 0.0]) for i in range(101, 200)], (5, [1.0, 1.0]), (5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("v", "ids", "shard", "block", "dim"):
        df = df.withColumn(name, F.lit("clash"))
    got = _answers(df)
    assert set(got) - {70, *range(110, 200, 10)} == {0}
    assert got[0] == [(5, 1.0), *[(i, 1.0) for i in range(101, 110)]]
    assert [i for i, _ in got[110]] == [*range(101, 110), 111] and [s for _, s in got[110]] == [0.0] * 10
    assert _answers(df.limit(0)) == {}


def test_recall_over_full_shards(spark):
    """Five shards of the production size, in clusters and without, the query itself left out."""
    rng = np.random.default_rng(21)
    grouped = rng.normal(size=(200, 64))[rng.integers(0, 200, 10_000)] + 0.2 * rng.normal(size=(10_000, 64))
    vectors = np.concatenate([grouped, rng.normal(size=(10_000, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(8)
    by = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(by) == 200
    hits = 0
    for q, found in by.items():
        far = ((vectors - vectors[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(found & set(np.argsort(far)[:10].tolist()))
    print("recall", hits / 2000)
    assert hits / 2000 >= 0.95
