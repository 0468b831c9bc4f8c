import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} of the {i}" for i in range(8000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with null, empty, blank, very long and repeated texts, null ids and columns of clashing names."""
    rows = [(1, None, None, None), (2, "", "en", None), (3, " \t\n ", None, "s"), (4, LONG, "en", "s"), (5, "one two", "en", "s"),
            (5, "one two", "en", "s"), (6, "Ünïcode 日本 😀 words", "de", "s"), (None, "no id here", "en", "s"), (7, "\x00 %s {} \\", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("id", "n", "rep", "part", "key", "keys", "comp", "hits", "n_words", "score", "spans", "ids", "v", "tokens"):
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
