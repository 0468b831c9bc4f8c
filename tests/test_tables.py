"""Cleaning, ranking, joins, quality, sources and increments."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lexstrata import fixed
from lexstrata.operators import cleaning as cl
from lexstrata.operators import enrichment, joins, pooling, quality, ranking
from lexstrata.plans import consolidation, harvest
from lexstrata.sources import files, tables
from lexstrata.streaming import incremental as inc

ENTRY = "original_characters string, ipa_phoneme string, english_translation string, part_of_speech string"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_field_checks(spark):
    raw = spark.createDataFrame([("w", "q", "text")], "original_characters string, ipa_phoneme string, raw_content string")
    checked, valid = cl.check_fields(raw)
    assert valid and checked.first()["ipa_phoneme"] is None
    assert not cl.has_fields(raw) and raw.first()["ipa_phoneme"] == "q"


def test_canonical_columns(spark):
    df = spark.createDataFrame([("x", "y")], "original_characters string, other string")
    assert cl.canonical_columns(df).columns == df.columns
    full = spark.createDataFrame([("a",) * 5], ENTRY + ", extra string")
    assert cl.canonical_columns(full).columns == list(fixed.LATIN_COLUMNS)


def test_metadata_needs_word(spark):
    df = spark.createDataFrame([("w", "m", None, 5)], "word string, english_translation string, language string, time_period int")
    assert tuple(cl.with_metadata(df).first()["metadata"]) == ("w", "Unknown", "m", "", "5")
    with pytest.raises(Exception):
        cl.with_metadata(df.drop("word"))


def test_clean_latin(spark):
    df = spark.createDataFrame([
        ("x", None, "a", None), ("x", "z", None, None), ("x", "k", "b", "noun"), (None, None, None, None),
        ("y", None, None, "verb"), ("w", "[/a/]", None, None), (None, "a", "b", None), ("a", "q; p; q", "None", None),
    ], ENTRY)
    assert rows(consolidation.clean_latin(df)) == [
        ("a", "p; q", None, None), ("w", "a", None, None), ("x", "k", "b", "noun")]
    audit = {r["stage"]: (r["rows_out"], r["removed"]) for r in quality.cleaning_audit(df).collect()}
    assert audit == {"loaded": (8, 0), "not_empty": (7, 1), "required": (5, 2), "unique": (3, 2)}


def test_consolidate_keeps_first_however_partitioned(spark):
    data = [(i, i % 4, f"w{i % 7}", "m" if i % 5 else " ", "PIE" if i % 2 else "Old English", f"/{i}/") for i in range(200)]
    random.Random(1).shuffle(data)
    schema = "row_no int, source_rank int, word string, english_translation string, language string, phonetic_representation string"
    base = spark.createDataFrame(data, schema)
    expected = {}
    for r in sorted(data, key=lambda r: (r[1], r[0])):
        if r[3].strip():
            expected.setdefault((r[2], r[4]), r[5])
    for n in (1, 3, 16):
        got = consolidation.consolidate(base.repartition(n)).collect()
        assert {(r["word"], r["language"]): r["phonetic_representation"] for r in got} == expected
    again = consolidation.consolidate(consolidation.consolidate(base).withColumns(
        {"row_no": F.lit(0), "source_rank": F.lit(0)}))
    assert again.count() == len(expected)


def test_positions_with_gaps_and_clusters(spark):
    ids = [i * i for i in range(500)] + [10**15 + i for i in range(300)]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    got = ranking.with_position(df, "id", slices=7).collect()
    assert sorted((r["id"], r["position"]) for r in got) == [(v, n) for n, v in enumerate(sorted(ids))]
    assert ranking.with_position(df, "id", slices=1).where("position = 0").first()["id"] == 0


def test_sampling_is_exact_and_repeatable(spark):
    df = spark.range(1000)
    a, b = (rows(ranking.sample_n(d, 50, "id"), "id") for d in (df, df.repartition(9)))
    assert a == b and len(a) == 50
    assert ranking.sample_n(df, 5000, "id").count() == ranking.sample_n(df, None, "id").count() == 1000


def test_smallest_takes_missing_last(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5), (3, None), (4, 0.5), (5, 0.1)], "id int, d double")
    assert [r[0] for r in rows(ranking.smallest(df, "d", 3, "id"))] == [5, 2, 4]
    assert len(rows(ranking.smallest(df, "d", 4, "id"))) == 4


def test_lookup_slices_hot_keys(spark):
    left = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(
        F.col("id") % 500 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))
    right = left.select("k").distinct().where("k is not null and k <> 'k2'").withColumn("v", F.length("k"))
    hot = joins.hot_keys(left, "k", 32).collect()
    assert [r["k"] for r in hot] == ["hot"] and 9 <= hot[0]["_slices"] <= 12
    expected = rows(left.join(right, "k", "left").select("id", "k", "v"), "id")
    assert rows(joins.lookup(left, right, "k", "id").select("id", "k", "v"), "id") == expected
    assert joins.lookup(left, right, "k", "id", "inner").count() == sum(r[2] is not None for r in expected)


def test_anti_and_semi_with_a_hot_key(spark):
    df = spark.range(2000).withColumn("k", F.when(F.col("id") < 900, F.lit(-1)).when(F.col("id") < 910, F.lit(None))
                                      .otherwise(F.col("id")))
    done = spark.range(1000, 1500).select(F.col("id").alias("k")).union(spark.range(2).select(F.lit(-1).alias("k")))
    for spread in (None, "id"):
        assert joins.not_done(df, done, "k", spread).count() == 2000 - 900 - 500
        assert joins.chosen(df, done, "k", spread).count() == 900 + 500


def test_coverage_of_nothing(spark):
    empty = spark.createDataFrame([], "a string")
    assert rows(quality.column_coverage(empty)) == [("a", 0, None)]
    assert quality.success_rates(empty, ["a"]).first()["a_rate"] is None


def test_pooling(spark):
    tokens = spark.createDataFrame([(1, 0, 1, [1.0, 2.0]), (1, 1, 1, [3.0, 4.0]), (1, 2, 0, [9.0, 9.0]), (2, 0, 0, [5.0, 5.0])],
                                   "item_id int, pos int, mask int, vec array<double>")
    got = {r["item_id"]: list(r["vector"]) for r in pooling.mean_pooling(tokens).collect()}
    assert got == {1: pytest.approx([2.0, 3.0]), 2: pytest.approx([0.0, 0.0])}
    assert rows(pooling.first_token(tokens), "item_id") == [(1, [1.0, 2.0]), (2, [5.0, 5.0])]


def test_embed_once_per_text_and_null_on_failure(spark):
    def model(batches):
        for texts in batches:
            assert texts.is_unique
            yield texts.map(lambda t: None if t == "bad" else [float(len(t))])

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, None)], "id int, english_translation string")
    got = {r["id"]: r["vector"] for r in enrichment.embed(df, "english_translation", model, "id").collect()}
    assert got == {1: [1.0], 2: [1.0], 3: None, 4: None}
    assert consolidation.enrich(df, enrichment.ngram_vectors(8), "id").count() == 3


def test_embed_goes_on_when_the_model_raises(spark):
    def model(batches):
        for texts in batches:
            if (texts == "bad").any():
                raise ValueError("no")
            yield texts.map(lambda t: [float(len(t))])

    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bad"), (4, None), (5, "a")], "id int, t string")
    got = {r["id"]: (r["vector"], r["vector_error"]) for r in enrichment.embed(df, "t", model, "id").collect()}
    assert got == {1: ([1.0], None), 2: ([2.0], None), 3: (None, "ValueError: no"), 4: (None, None), 5: ([1.0], None)}


def test_lookup_joins_rows_once(spark):
    """Slices of hot keys come from the key itself: no join with the hot keys before the one asked for."""
    left = spark.createDataFrame([(i, 7 if i % 2 else i) for i in range(400)] + [(400, None)], "id long, k long")
    right = spark.createDataFrame([(i, f"v{i}") for i in range(100)], "k long, v string")
    found = joins.lookup(left, right, "k", "id", "inner", parts=8)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "_slice" in text and "LeftOuter" not in text
    assert sorted(r["v"] for r in found.collect()) == sorted(["v7"] * 200 + [f"v{i}" for i in range(0, 100, 2)])


def test_lookup_spreads_rows_without_a_key(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"))
    right = spark.range(0, 3000, 4).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    found = joins.lookup(left, right, "k", "id")
    assert rows(found.select("id", "k", "v"), "id") == rows(left.join(right, "k", "left").select("id", "k", "v"), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")    # else small parts are joined again
    try:
        parts = joins.lookup(left, right, "k", "id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in parts) < 1500


def test_positions_of_nothing_and_of_texts(spark):
    assert ranking.with_position(spark.range(0), "id").count() == 0
    words = spark.createDataFrame([(w,) for w in "delta alpha charlie bravo".split()], "w string")
    assert rows(ranking.with_position(words, "w"), "position") == [("alpha", 0), ("bravo", 1), ("charlie", 2), ("delta", 3)]


def test_a_shared_folder_is_asked_for_off_one_machine():
    from lexstrata.session import shared_dir

    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "s3a://b/c"
    assert shared_dir(Session()) == "s3a://b/c"


# ---- sources

def test_csv_columns_by_name(spark, tmp_path):
    for name, text in (("a", "word,english_translation\nw1,m1\n"), ("b", "english_translation,x,word\nm2,,w2\n"), ("c", "word\nw3\n")):
        (tmp_path / f"{name} 1.csv").write_text(text, encoding="utf8")
    for multi_line in (True, False):
        got = files.read_csv(spark, str(tmp_path), files.LEXICON_SCHEMA, multi_line).select("word", "english_translation")
        assert rows(got, "word") == [("w1", "m1"), ("w2", "m2"), ("w3", None)]


def test_a_batch_file_without_part_of_speech(spark, tmp_path):
    (tmp_path / "latin_batch_1.csv").write_text("title,original_characters,ipa_phoneme,english_translation,raw_content\n"
                                                "canis,canis,,dog,\n", encoding="utf8")
    (tmp_path / "latin_batch_2.csv").write_text("raw_content,part_of_speech,original_characters\n,noun,felis\n", encoding="utf8")
    got = files.read_latin_files(spark, str(tmp_path), "batch")
    assert rows(got.select("original_characters", "english_translation", "part_of_speech"), "original_characters") == [
        ("canis", "dog", None), ("felis", None, "noun")]


def test_csv_missing_values(spark, tmp_path):
    lines = ["word,english_translation,language,phonetic_representation,time_period"]
    lines += [f'w{i},"{t}",PIE,"a ""b""\nc",-5000' for i, t in enumerate(fixed.NA_TOKENS)] + ["x, NA ,PIE,p,n/a"]
    (tmp_path / "l.csv").write_text("\n".join(lines), encoding="utf8")
    got = files.read_csv(spark, str(tmp_path / "l.csv"), files.LEXICON_SCHEMA).collect()
    assert len(got) == 20 and all(r["english_translation"] is None for r in got[:19])
    assert got[0]["phonetic_representation"] == 'a "b"\nc' and got[0]["time_period"] == -5000
    assert got[19]["english_translation"] == " NA " and got[19]["time_period"] is None


def test_pronunciations(spark, tmp_path):
    (tmp_path / "p.txt").write_text("cat\t/kæt/\nno tab\nword\t\na\tb\tc\n  dog \t /d/ \n", encoding="utf8")
    good, bad = files.read_pronunciations(spark, str(tmp_path / "p.txt"), "US English")
    assert rows(good.select("word", "phonetic_representation", "english_translation"), "word") == [
        ("a", "b\tc", "a"), ("cat", "/kæt/", "cat"), ("dog", "/d/", "dog")]
    assert rows(bad.select("line")) == [("word\t",)]


def test_latin_files(spark, tmp_path):
    assert consolidation.load_latin(spark, str(tmp_path)).count() == 0
    (tmp_path / "latin_terms_full_1.csv").write_text(
        "ipa_phoneme,english_translation,part_of_speech,original_characters\nk,dog,noun,canis\n,,,\n", encoding="utf8")
    (tmp_path / "latin_batch_1.csv").write_text(
        "title,original_characters,ipa_phoneme,english_translation,part_of_speech,raw_content\n"
        'canis,canis,,,,"# other."\nfelis,felis,x,cat,,"===Noun===\n# a cat."\n', encoding="utf8")
    (tmp_path / "other.csv").write_text("a\n1\n", encoding="utf8")
    merged = {r["original_characters"]: tuple(r[c] for c in fixed.LATIN_COLUMNS[1:])
              for r in consolidation.load_latin(spark, str(tmp_path)).collect()}
    assert merged == {"canis": ("k", "dog", "noun"), "felis": ("x", "a cat; cat", "noun"), None: (None, None, None)}


def test_api_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"query":{"pages":{"1":{"pageid":1,"title":"a","revisions":[{"slots":{"main":{"*":"x"}}},'
        '{"slots":{"main":{"*":"old"}}}]},"2":{"pageid":2,"title":"b"},"3":{"pageid":3,"title":"c","revisions":[]}}}}\n'
        '{"batchcomplete":""}\n{"query":{"pages":{"9"\n\n', encoding="utf8")
    pages, rejected = files.read_pages(spark, str(tmp_path / "a.json"))
    assert rows(pages) == [(1, "a", "x")]
    assert rows(rejected) == [('{"query":{"pages":{"9"', "not a JSON document")]


def test_vectors_from_text(spark):
    df = spark.createDataFrame([("[0.1, 2e-3,3]",), ("[0.1 0.2]",), (None,)], "vector string")
    got = files.parse_vectors(df).collect()
    assert got[0]["vector"] == [0.1, 0.002, 3.0] and [r["vector_ok"] for r in got] == [True, False, True]


def test_read_or_build(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build():
        built.append(1)
        return spark.range(10).withColumnRenamed("id", "page_id")

    assert tables.read_or_build(spark, path, build).count() == 10
    assert rows(tables.read_or_build(spark, path, build, limit=3)) == [(0,), (1,), (2,)]
    assert len(built) == 1
    assert tables.read_or_build(spark, path, build, refresh=True).count() == 10 and len(built) == 2


def test_save_and_chunks(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    assert tables.save_table(spark.range(0), p("e")) == "no data" and not os.path.exists(p("e"))
    assert tables.save_table(spark.range(3), p("o"), p("r"), "csv") == "saved"
    assert spark.read.csv(p("r"), header=True).count() == 3
    tables.save_chunks(spark.range(25).withColumn("v", F.col("id") * 2), p("c"), "id", 10)
    sizes = spark.read.parquet(p("c")).groupBy("chunk_number", "total_chunks", "words_in_chunk").count()
    assert rows(sizes, "chunk_number") == [(1, 3, 10, 10), (2, 3, 10, 10), (3, 3, 5, 5)]
    assert tables.compact_chunks(spark, p("c"), p("all"), 1) == 25
    assert tables.drop_chunks(spark, p("c"), p("all")) and not os.path.exists(p("c"))
    assert spark.read.parquet(p("all")).columns == ["id", "v"]


# ---- harvest and increments

def test_harvest(spark):
    page = "==Latin==\n* IPA: /ka/\n==French==\n"
    pages = spark.createDataFrame([(i * 3, f" t{i}", page if i % 2 else "none") for i in range(11)],
                                  "page_id long, title string, content string")

    def reply(body):
        titles = [line[7:].strip() for line in body.split("\n") if line.startswith("Title: ")]
        if "t9" in titles:
            raise RuntimeError("service down")
        return "---".join(f"ipa_phoneme: /{t}/\nenglish_translation: m" for t in titles[:1])

    parsed = harvest.harvest(pages, "Latin", reply, batch_size=2)
    # five terms, batches of two, one record per reply, the last batch fails
    assert rows(parsed.select("batch", "place", "original_characters", "ipa_phoneme", "error"), "batch") == [
        (0, 0, "t1", "t1", None), (1, 0, "t5", "t5", None), (2, 0, None, None, "RuntimeError: service down")]
    assert rows(harvest.batch_rates(parsed), "batch") == [(0, 1, 100.0, 100.0), (1, 1, 100.0, 100.0), (2, 1, 0.0, 0.0)]
    assert harvest.harvest(pages.limit(0), "Latin", reply).count() == 0
    assert harvest.harvest_roots(pages, reply).count() == 0    # no root pages


def test_replies_are_asked_for_once(spark, tmp_path):
    page = "==Latin==\n* IPA: /ka/\n==French==\n"
    pages = spark.createDataFrame([(i, f"t{i}", page) for i in range(6)], "page_id long, title string, content string")
    asked, down = str(tmp_path / "asked"), str(tmp_path / "down")
    os.mkdir(asked)
    open(down, "w").close()

    def reply(body):
        first = body.split("\n")[1][7:]
        with open(f"{asked}/{first}", "a") as f:
            f.write("x")
        if first == "t2" and os.path.exists(down):
            raise RuntimeError("service down")
        return "ipa_phoneme: a---ipa_phoneme: b"

    def run():
        parsed = harvest.harvest(pages, "Latin", reply, batch_size=2, replies=str(tmp_path / "replies"))
        parsed.count()
        return parsed.where("error is not null").count()

    assert run() == 2
    os.remove(down)
    assert run() == 0 and run() == 0
    assert {n: os.path.getsize(f"{asked}/{n}") for n in os.listdir(asked)} == {"t0": 1, "t2": 2, "t4": 1}


def test_increments_equal_batch_and_resume(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    schema = spark.createDataFrame([], "id long, text string").schema

    def land(first, last, mode="append"):
        spark.range(first, last).select("id", F.concat(F.lit(" x"), F.col("id").cast("string")).alias("text")) \
            .repartition(2).write.mode(mode).parquet(p("in"))

    def step(df):
        clean = cl.strip_strings(df)
        return inc.with_status(clean, F.col("id") % 10 != 0, F.lit("bad id"))

    def run():
        inc.run_increments(spark, p("in"), schema, step, p("out"), p("cp"), p("bad"), files_per_batch=1)

    land(0, 50)
    run()
    land(50, 80)
    run()
    run()
    whole = step(spark.read.parquet(p("in")))
    done, bad = (spark.read.parquet(p(n)).drop("batch_id") for n in ("out", "bad"))
    assert rows(done.unionByName(bad), "id") == rows(whole, "id")
    assert rows(quality.outcome_counts(whole), "status") == [("failed", 8), ("processed", 72)]
    assert [r["id"] for r in quality.first_failures(whole, "id", 3).collect()] == [0, 10, 20]
    left = joins.not_done(spark.read.parquet(p("in")), done, "id")
    assert left.count() == 8


def test_repeated_batch_replaces_itself(spark, tmp_path):
    for _ in range(2):
        inc.append_batch(spark.range(5), str(tmp_path / "t"), 3)
        tables.land_batch(spark.range(5), str(tmp_path / "l"), 1, "latin")
    tables.land_batch(spark.range(5), str(tmp_path / "l"), 2, "latin")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
    assert spark.read.parquet(str(tmp_path / "l")).count() == 10


def test_headers_are_read_without_a_job(spark, tmp_path):
    """Only first lines are read: a body that is no text at all does not matter, and no task runs."""
    for i, head in enumerate(["word,language", "\ufeffword,language\r", '"lang, uage",word', "word,language"]):
        (tmp_path / f"{i} a+b.csv").write_bytes((head + "\n").encode() + b"\xff\xfe\n" * 1000)
    (tmp_path / "empty.csv").write_bytes(b"")
    spark.sparkContext.setJobGroup("headers", "headers")
    found = files._headers(spark, str(tmp_path))
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("headers") in ([], ())
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {k: sorted(n.rsplit("/", 1)[1] for n in v) for k, v in found.items()} == {
        ("word", "language"): ["0 a+b.csv", "1 a+b.csv", "3 a+b.csv"], ("lang, uage", "word"): ["2 a+b.csv"]}


def test_arriving_files_follow_the_size(spark, tmp_path, monkeypatch):
    """A batch is more files where the rows are many, so no file grows with the table; the batches stay as many."""
    from lexstrata.registry import extraction

    monkeypatch.setattr(extraction, "FILE_BYTES", 10_000)
    df = spark.range(2000).select(F.col("id").alias("n"), F.repeat(F.lit("x"), 100).alias("text"))
    per_batch = extraction.arriving(df, str(tmp_path / "many"), "n", 4)
    assert per_batch >= 5 and extraction.arriving(df.limit(3), str(tmp_path / "few"), "n", 4) == 1
    written = [f for f in os.listdir(tmp_path / "many") if f.endswith(".parquet")]
    assert len(written) == 4 * per_batch
    counts = spark.read.parquet(str(tmp_path / "many")).groupBy(F.input_file_name()).count().select("count").collect()
    assert sum(c[0] for c in counts) == 2000 and max(c[0] for c in counts) < 2 * 2000 / len(written)
    assert extraction.arriving(df.limit(0), str(tmp_path / "none"), "n", 4) == 1
