"""Features, sound change, forms through time."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexstrata import fixed
from lexstrata.functions import phonetics as ph
from lexstrata.operators import prediction
from lexstrata.plans import prediction
from lexstrata.plans.prediction import predict_requests, timeline, validate

FORMS = [(1, -5000, "/a/"), (2, -1100, "/b/"), (3, -300, "/d/"), (4, 0, "/p/"), (5, 0, "/i/")]
FORM_TYPE = "array<struct<rank int, time_period int, phonetic_representation string>>"


def forms_at(spark, times, fn=prediction.with_form_at, forms=FORMS):
    df = spark.createDataFrame([(t, forms) for t in times], f"target_time int, forms {FORM_TYPE}")
    return {r["target_time"]: r["ipa"] for r in fn(df).collect()}


def test_form_at(spark):
    expected = {-5000: "/a/", -4600: "/a/", -1600: "/b/", -700: "/b/", -3000: "/b/", 0: None, 100: "/i/", 1000: "/e/"}
    assert forms_at(spark, expected) == expected
    assert forms_at(spark, [-5000, 0, 10], forms=[]) == {-5000: None, 0: None, 10: None}


def test_future_form(spark):
    assert forms_at(spark, [-5000, 0, 1000], prediction.with_future_form) == {-5000: None, 0: None, 1000: "/e/"}


def test_requested_form(spark):
    # past in window: as it is; present out of window: unknown; future: shifted twice
    got = forms_at(spark, [-5000, 0, 1000], prediction.with_requested_form)
    assert got == {-5000: "/a/", 0: "/p/", 1000: "/e/"}
    lone = forms_at(spark, [0, -1100], prediction.with_requested_form, [(1, -5000, "/kʰiθ/")])
    assert lone[0] == "/???/"
    assert lone[-1100] == "/ˈˈeθ/"    # first shifted from -5000, then again by the gap to the first form


@pytest.mark.parametrize("ipa, delta, out", [
    ("/riːtʃ/", 100, "/liˈtʃ/"), ("/riːtʃ/", 500, "/leˈtʃ/"), ("/ˈwɔːtər/", -900, "/ˈwɔˈtəl/"),
    ("/ˈwɔːtər/", 6000, "/ˈwɔˈtəl/"), ("/kʰiθ/", -900, "/ˈˈiθ/"), ("/kʰiθ/", 6000, "/ˈˈeθ/"), ("/hundə/", 40, "/hundə/"),
    ("//", 5, "//"), ("[a]", 0, "/a/"),
])
def test_sound_shift(spark, ipa, delta, out):
    df = spark.createDataFrame([(ipa, delta)], "i string, d int")
    direct = ph.spell(F.transform(ph.phones("i"), lambda p: ph.drift_features(ph.phone_features(p), "d")))
    assert tuple(df.select(ph.sound_shift("i", "d"), direct).first()) == (out, out)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text(alphabet="".join(p for p, _ in fixed.PHONES) + "kg/[x", max_size=8),
                          st.integers(-9000, 9000)), min_size=40, max_size=80))
def test_shift_table_matches_features(spark, rows):
    df = spark.createDataFrame(rows, "i string, d int")
    direct = ph.spell(F.transform(ph.phones("i"), lambda p: ph.drift_features(ph.phone_features(p), "d")))
    got = df.select(ph.sound_shift("i", "d").alias("a"), direct.alias("b")).collect()
    assert all(r["a"] == r["b"] and r["a"][0] == r["a"][-1] == "/" for r in got)


def test_drift_rate(spark):
    df = spark.createDataFrame([(0,), (-500,), (9000,)], "d int").select(ph.drift_rate("d"))
    assert [r[0] for r in df.collect()] == pytest.approx([0.0, math.pow(0.25, 0.3), 1.0])


@pytest.mark.parametrize("ipa, year, out", [
    ("hwæt", -700, "hwɛt"), ("hwæt", -300, "wɛt"), ("hwæt", -100, "wæt"), ("tiːd", -300, "taɪd"), ("tiːd", 1, "tiːd"),
    ("kin", -500, "kin"), ("k_in", -500, "tʃ]n"),
])
def test_timed_rules(spark, ipa, year, out):
    assert spark.createDataFrame([(ipa, year)], "i string, y int").select(ph.timed_rules("i", "y")).first()[0] == out


def test_timeline(spark):
    df = spark.createDataFrame([(1, [(1, -5000, "/a/"), (2, 0, "/i/"), (3, 0, "/p/")])], f"query_id int, forms {FORM_TYPE}")
    rows = timeline(df).orderBy("step").collect()
    assert [r["target_time"] for r in rows] == [-5000, 0, 0, 1000, 2000, 3000, 4000, 5000]
    assert [r["era"] for r in rows] == ["PAST"] * 3 + ["FUTURE"] * 5
    assert [r["ipa"] for r in rows][:4] == ["/a/", None, None, "/p/"]


def test_nearest_in_time_with_a_hot_key(spark):
    events = spark.range(3000).select(
        F.col("id").alias("n"), F.when(F.col("id") < 1500, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("w"),
        F.lit(-900).alias("target_time"))
    attested = spark.createDataFrame([("hot", -1100, "/a/", 2), ("hot", -1100, "/z/", 1), ("hot", -700, "/b/", 3),
                                      ("1600", -5000, "/c/", 4)],
                                     "w string, time_period int, phonetic_representation string, n long")
    out = prediction.nearest_in_time(events, attested, "w", "n", "n")
    assert out.count() == 3000
    assert {(r[0], r[1], r[2]) for r in out.groupBy("matched_period", "matched_ipa").count().collect()} == \
        {(-1100, "/z/", 1500), (None, None, 1500)}


def test_nearest_in_time_of_a_key_with_a_million_periods(spark):
    """One key of a million periods beside small ones; slices of it are stitched by their edges."""
    long = spark.range(1_000_000).select(F.lit("long").alias("w"), (F.col("id") * 7 - 3_000_000).cast("int").alias("time_period"),
                                         F.concat(F.lit("/"), F.col("id").cast("string"), F.lit("/")).alias("phonetic_representation"), F.col("id").alias("n"))
    few = spark.createDataFrame([("few", -10, "/a/", 1), ("few", 10, "/b/", 2), ("few", None, "/c/", 3), (None, 1, "/d/", 4)],
                                "w string, time_period int, phonetic_representation string, n long")
    times = spark.range(2000).select(F.lit("long").alias("w"), (F.col("id") * 5003 - 4_000_000).cast("int").alias("target_time"), "id")
    odd = spark.createDataFrame([("few", 0, -1), ("few", 9, -2), ("few", None, -3), (None, 0, -4), ("none", 0, -5), ("few", -700, -6)],
                                "w string, target_time int, id long")
    out = prediction.nearest_in_time(times.unionByName(odd), long.unionByName(few), "w", "n", "id", None, parts=16)
    got = {r["id"]: (r["matched_period"], r["matched_ipa"]) for r in out.collect()}
    for i in range(2000):
        at = i * 5003 - 4_000_000
        n = min(max(round((at + 3_000_000) / 7), 0), 999_999)
        assert got[i] == (n * 7 - 3_000_000, f"/{n}/"), at
    assert [got[-i] for i in range(1, 7)] == [(-10, "/a/"), (10, "/b/"), (None, None), (None, None), (None, None), (-10, "/a/")]
    near = prediction.nearest_in_time(odd, few, "w", "n", "id", 5)
    assert {r["id"]: r["matched_period"] for r in near.collect()} == {-1: None, -2: 10, -3: None, -4: None, -5: None, -6: None}


@pytest.mark.parametrize("parts", [1, 3, 12])
def test_slices_without_forms_are_stitched(spark, parts):
    """Long stretches of targets without a form between them, forms only far apart."""
    events = spark.range(600).select(F.lit("k").alias("w"), (F.col("id") * 2).cast("int").alias("target_time"), "id")
    attested = spark.createDataFrame([("k", 3, "/a/", 1), ("k", 1000, "/b/", 2)], "w string, time_period int, phonetic_representation string, n long")
    out = prediction.nearest_in_time(events, attested, "w", "n", "id", None, parts=parts)
    assert all(r["matched_period"] == (3 if r["target_time"] < 502 else 1000) for r in out.collect())


def _lexicon(spark):
    return spark.createDataFrame([
        (0, "ped", -5000, "/p/", [1.0, 0.0]), (1, "fot", -1100, "/t/", [0.8, 0.6]), (2, "foot", 0, "/i/", [0.6, 0.8]),
        (3, "pied", 300, "/r/", [0.0, 1.0]),
    ], "row_id long, word string, time_period int, phonetic_representation string, vector array<double>")


def test_predict_requests(spark):
    requests = spark.createDataFrame([
        (1, "PIE", " A b A ", None), (2, "future_english_1000", "b", None), (3, "us_english", "Hi  You", None),
        (4, "klingon", "a", None), (5, "PIE", " \t", None), (6, None, "a", None), (7, "toronto_english", "Hi", "Yo\nFam"),
        (8, "toronto_english", "Hi", None), (9, "PIE", "", None), (10, "PIE", "a unheard", None),
    ], "request_id long, language string, user_input string, dialect_text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vector array<double>")
    out = {r["request_id"]: r for r in predict_requests(
        requests, _lexicon(spark), lambda words: words.join(vectors, "word")).collect()}
    assert out[1]["predicted_text"] == "/p/ /p/ /p/" and out[1]["original_text"] == "a b a"
    assert [w["original"] for w in out[1]["word_predictions"]] == ["a", "b", "a"]
    assert out[1]["confidence_score"] == pytest.approx(1.0)
    # three first-ranked rows per word, pooled, five least distances, ties by word then rank
    assert [(m["original_word"], m["word"]) for m in out[1]["nearest_matches"]] == \
        [("a", "ped"), ("a", "ped"), ("a", "fot"), ("b", "foot"), ("a", "fot")]
    assert out[2]["predicted_text"] == "/l/"
    assert (out[3]["predicted_text"], out[3]["confidence_score"], out[3]["is_modern"]) == ("hi  you", 1.0, True)
    assert [w["ipa"] for w in out[3]["word_predictions"]] == ["hi", "you"]
    assert out[4]["error"] == "Unsupported language selection: klingon"
    assert out[5]["error"] == "Empty input text"
    assert out[6]["error"] == out[9]["error"] == "Missing required fields"
    assert (out[7]["predicted_text"], out[7]["explanation"], out[7]["is_toronto"]) == ("Yo\nFam", "Yo", True)
    assert [w["original"] for w in out[7]["word_predictions"]] == ["Yo", "Fam"]
    assert out[8]["error"] == "Toronto translation failed"
    assert (out[10]["predicted_text"], out[10]["confidence_score"]) == ("/p/ /???/", pytest.approx(0.5))


def test_words_move_once_a_part(spark, monkeypatch):
    """What is landed and handed on for the texts grows with distinct words, not with words; rows of one id share their words."""
    landed, first = [], prediction.land
    monkeypatch.setattr(prediction, "land", lambda df, name: landed.append((name, first(df, name))) or landed[-1][1])
    monkeypatch.setattr(prediction, "PART_WORDS", 1000)
    rows = [(i, "PIE", "a b " * 200) for i in range(20)] + [(50, "PIE", "a b"), (50, "PIE", "b a a"), (None, "PIE", "a")]
    requests = spark.createDataFrame(rows, "request_id long, language string, user_input string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vector array<double>")
    out = predict_requests(requests, _lexicon(spark), lambda words: words.join(vectors, "word")).collect()
    assert max(f.count() for name, f in landed if name != "requests") <= 2 * max(9, spark.sparkContext.defaultParallelism)
    assert sorted(r["request_id"] for r in out) == [*range(20), 50, 50]
    said = {r["request_id"]: [w["original"] for w in r["word_predictions"]] for r in out}
    assert said[3] == ["a", "b"] * 200 and said[50] == ["a", "b", "a", "b", "a"]
    assert {r["original_text"] for r in out if r["request_id"] == 50} == {"a b", "b a a"}


@pytest.mark.parametrize("budget", [0, 400, 1 << 20])
def test_answers_do_not_depend_on_how_words_are_searched(spark, budget):
    """Pivot groups, broadcast words and a broadcast lexicon: ranks that are never null are handed on like others."""
    rows = [(1, "PIE", "a b a"), (2, "future_english_1000", "b"), (3, "PIE", "a unheard")]
    requests = spark.createDataFrame(rows, "request_id long, language string, user_input string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vector array<double>")
    out = {r["request_id"]: r for r in predict_requests(
        requests, _lexicon(spark), lambda words: words.join(vectors, "word"), budget=budget).collect()}
    assert {i: r["predicted_text"] for i, r in out.items()} == {1: "/p/ /p/ /p/", 2: "/l/", 3: "/p/ /???/"}
    assert [(m["original_word"], m["word"]) for m in out[1]["nearest_matches"]] == \
        [("a", "ped"), ("a", "ped"), ("a", "fot"), ("b", "foot"), ("a", "fot")]


def test_validate_is_row_wise(spark):
    df = spark.createDataFrame([(1, "PIE", " Ab ")], "request_id long, language string, user_input string")
    row = validate(df).first()
    assert (row["time_period"], row["original_text"], row["error"]) == (-5000, "ab", None)
