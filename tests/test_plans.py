"""Plan shapes that must hold at scale."""

import os
import re

import pytest
from pyspark.sql import functions as F

from lexstrata.operators import quality, ranking
from lexstrata.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def plan(spark, key):
    return QUERIES[key].run(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["win1_nearest_coverage", "win2_similar_words", "jon6_nearest_in_window",
                                 "job6_predict_requests", "job7_timeline", "jon2_query_distances", "win5_batches",
                                 "jon7_nearest_in_time", "vec10_lsh", "vec10_recall", "vec9_graph_layout", "win1_pivot_groups"])
def test_no_pair_joins(spark, key):
    text = plan(spark, key)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize("key", ["jon6_nearest_in_window", "jon7_nearest_in_time"])
def test_no_list_per_key(spark, key):
    assert not re.search(r"collect_list|collect_set", plan(spark, key))


@pytest.mark.parametrize("n", [100, 5000])
def test_samples_take_no_single_task(spark, n):
    rows = spark.range(10_000).repartition(4)
    sampled = ranking.sample_n(rows, n, "id")
    text = sampled._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Limit|TakeOrdered|Sort|SinglePartition", text)
    key = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("42")))
    assert sorted(r[0] for r in sampled.collect()) == sorted(r[0] for r in rows.orderBy(key, "id").limit(n).select("id").collect())


def test_samples_cut_crowded_ranges_further(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_SORTED", 2)
    rows = spark.range(6000)
    key = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("42")))
    for n in (1, 777, 5999, 6000, 7000):
        got = sorted(r[0] for r in ranking.sample_n(rows, n, "id").collect())
        assert got == sorted(r[0] for r in rows.orderBy(key, "id").limit(n).collect())


def test_an_audited_write_reads_its_source_once(spark, tmp_path):
    """One scan, and the counts of the audit that reads the source by itself."""
    rows = spark.createDataFrame([("a", "x", None), ("a", None, "y"), ("b", None, None), (None, "x", "x"), (None, None, None), ("c", "z", None)],
                                 "original_characters string, ipa_phoneme string, english_translation string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    seen = source.mapInArrow(counted, source.schema)
    got = quality.write_audited(seen, str(tmp_path / "out"))
    assert reads.value == 6
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, quality.cleaning_audit(source).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=repr) == [("a", "x", None), ("c", "z", None)]


@pytest.mark.parametrize("key", ["win3_keep_first", "win4_keep_smallest", "job1_consolidate", "job3_latin_clean",
                                 "jon9_own_vector"])
def test_keep_first_prunes_before_the_shuffle(spark, key):
    text = plan(spark, key)
    before = text[text.index("Exchange hashpartitioning"):]
    assert re.search(r"WindowGroupLimit .*Partial", before)


@pytest.mark.parametrize("key, columns", [
    ("str20_html_pronunciation", {"page_id", "html"}),
    ("set4_sorted_distinct", {"doc_id", "text"}),
    ("win5_batches", {"o_orderkey"}),
    ("agg11_group_sizes", {"p_partkey"}),
    ("jon8_resume", {"doc_id", "lang"}),
])
def test_scans_read_only_what_is_used(spark, key, columns):
    read = re.findall(r"FileScan parquet \[([^\]]*)\]", plan(spark, key))
    assert read and {re.sub(r"#\d+L?", "", c) for part in read for c in part.split(",") if c} <= columns
    assert any({re.sub(r"#\d+L?", "", c) for c in part.split(",")} == columns for part in read)


@pytest.mark.parametrize("key", ["str22_mine_raw_content", "str1_clean_markup", "job3_latin_clean", "vec5_sound_shift",
                                 "str9_reply_fields", "agg5_mean_pooling"])
def test_no_python_in_native_work(spark, key):
    assert not re.search(r"EvalPython|MapInArrow|MapInPandas", plan(spark, key))


@pytest.mark.parametrize("key", ["udf1_embed", "job4_enrich"])
def test_texts_are_joined_by_digest(spark, key):
    text = plan(spark, key)
    assert "hashpartitioning(_digest" in text
    assert not re.search(r"hashpartitioning\((?:text|english_translation|_text)", text)
