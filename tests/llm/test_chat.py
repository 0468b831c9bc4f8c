"""Chat formatting: round trips through texts that hold the template's own marks."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexstrata.llm.chat import chat_digests, format_chats, read_chats

SCHEMA = "conv_id long, turn long, role string, text string"


def _read(spark, rows, schema=SCHEMA):
    formatted = format_chats(spark.createDataFrame(rows, schema))
    return {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read_chats(formatted).collect()}


def test_merges_adjacent_turns_and_keeps_each(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    out = format_chats(spark.createDataFrame(rows, SCHEMA)).first()["formatted"]
    assert out == "<|im_start|>user\na<|turn|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert _read(spark, rows) == {1: [("user", "a"), ("user", "b"), ("assistant", "c")]}


def test_nulls_ties_and_repeats(spark):
    rows = [(1, None, None, None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"),
            (None, 0, "user", "x")]
    assert _read(spark, rows) == {1: [("", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")],
                                  None: [("user", "x")]}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat_digests(empty).count() == 0
    more = spark.createDataFrame([(1, 0, "assistant", "x")], SCHEMA).withColumn("turns", F.lit(1)).withColumn("formatted", F.lit(2))
    row = chat_digests(more).first()
    assert (row["n_turns"], row["loss_chars"]) == (1, 1)


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i} " * 50) for i in range(3000)]
    assert _read(spark, rows)[1] == [(r[2], r[3]) for r in rows]


MARKS = st.lists(st.sampled_from(["<|", "<", "|", "%", "<%|", "<|im_end|>", "<|im_start|>", "<|turn|>", "\n", "a", "\\", "$1"]),
                 max_size=8).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(MARKS, MARKS), min_size=1, max_size=30))
def test_round_trip(spark, turns):
    rows = [(7, i, r, t) for i, (r, t) in enumerate(turns)]
    assert _read(spark, rows)[7] == turns
