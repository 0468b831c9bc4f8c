"""Readers: dictionary CSV, pronunciation text, landed API pages, vectors as text."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..functions.vectors import parse_vector
from ..operators.cleaning import na_to_null

PAGE_SCHEMA = (
    "query struct<pages: map<string, struct<pageid: bigint, title: string, "
    "revisions: array<struct<slots: struct<main: struct<`*`: string>>>>>>>"
)

_OPEN = 16    # files whose headers are read at a time


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


LEXICON_SCHEMA = _texts("word", "english_translation", "language", "phonetic_representation") \
    .add("time_period", T.IntegerType())
LATIN_BATCH_SCHEMA = _texts("title", "original_characters", "ipa_phoneme", "english_translation", "part_of_speech",
                            "raw_content")
LATIN_FULL_SCHEMA = _texts("ipa_phoneme", "english_translation", "part_of_speech", "original_characters")


def _csv(spark: SparkSession, multi_line: bool):
    return spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"')


def _headers(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of each header line; of every file only the first line is read, some files at a time."""
    files = sorted(spark.read.text(path).inputFiles())    # a listing, as every read makes
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def first_line(file: str) -> str | None:
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(at.getFileSystem(conf).open(at), "UTF-8"))
        try:
            return lines.readLine()
        finally:
            lines.close()

    with ThreadPoolExecutor(_OPEN) as pool:
        found: dict[tuple[str, ...], list[str]] = {}
        for file, line in zip(files, pool.map(first_line, files)):
            if line is not None:
                found.setdefault(tuple(next(csv.reader([line.lstrip("\ufeff")]))), []).append(unquote(file))
    return found


def _by_name(spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool,
             extra: tuple = ()) -> DataFrame:
    """CSV files whose columns are taken by each file's own header; absent ones are null.

    Files of one header are read together, so there are as many reads as headers.
    """
    parts = []
    for names, files in _headers(spark, path).items():
        raw = _csv(spark, multi_line).schema(_texts(*[f"c{i}" for i in range(len(names))])).csv(files)
        place = {n: i for i, n in reversed(list(enumerate(names)))}    # of equal names the first counts
        parts.append(raw.select(*[
            (F.col(f"c{place[f.name]}") if f.name in place else F.lit(None).cast("string")).alias(f.name)
            for f in schema.fields], *extra))
    if not parts:
        return spark.createDataFrame([], _texts(*schema.names))
    return reduce(DataFrame.unionByName, parts)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """A headed CSV, of one or more files, whose missing-value spellings become null.

    Columns are read as text, taken by each file's own names (absent ones are null)
    and cast once the missing values are out of the way. Without line breaks inside
    cells, ``multi_line=False`` lets one large file be read by many tasks.
    """
    raw = na_to_null(_by_name(spark, path, schema, multi_line))
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_pronunciations(spark: SparkSession, path: str, language: str) -> tuple[DataFrame, DataFrame]:
    """Tab-separated ``word<TAB>pronunciation`` lines: (rows, rejected lines).

    Lines without a tab are skipped. Lines that have none left once stripped are
    rejected rather than ending the run.
    """
    lines = spark.read.text(path).where(F.instr("value", "\t") > 0).withColumn("line", strip("value"))
    parts = F.split("line", "\t", 2)
    whole = F.size(parts) == 2
    word = strip(F.get(parts, F.lit(0)))
    rows = lines.where(whole).select(
        word.alias("word"),
        F.lit(language).alias("language"),
        strip(F.get(parts, F.lit(1))).alias("phonetic_representation"),
        word.alias("english_translation"),
    )
    return rows, lines.where(~whole).select(F.col("value").alias("line"), F.lit("no tab after strip").alias("error"))


def read_latin_files(spark: SparkSession, folder: str, kind: str, multi_line: bool = True) -> DataFrame:
    """All ``full`` or ``batch`` files (or file folders) of a folder, with ``file_path`` and ``file_row``.

    Columns are taken by each file's own header; absent ones are null. Rows of one
    file are in its order; files are ordered by path. A folder without such files
    gives an empty table. ``multi_line`` as for ``read_csv``.
    """
    glob, schema = {
        "full": ("[Ll]atin_terms_full_*.csv", LATIN_FULL_SCHEMA),
        "batch": ("latin_batch_*.csv", LATIN_BATCH_SCHEMA),
    }[kind]
    place = (F.col("_metadata.file_path").alias("file_path"), F.monotonically_increasing_id().alias("file_row"))
    try:
        return na_to_null(_by_name(spark, f"{folder}/{glob}", schema, multi_line, place))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).withColumns({
            "file_path": F.lit(None).cast("string"), "file_row": F.lit(None).cast("long")})


def pages_from_json(raw: DataFrame) -> DataFrame:
    """One row per page of API replies; pages without revisions are dropped."""
    page = F.explode(F.map_values("query.pages")).alias("p")
    return raw.select(page).where(F.size("p.revisions") > 0).select(
        F.col("p.pageid").alias("page_id"),
        F.col("p.title").alias("title"),
        F.col("p.revisions")[0]["slots"]["main"]["*"].alias("content"),
    )


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed API replies, one JSON document per line or per file: (pages, rejected documents).

    A document that cannot be read is rejected with its text instead of vanishing.
    """
    lines = spark.read.text(path)
    reply = F.from_json("value", PAGE_SCHEMA + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    read = lines.where(F.trim("value") != "").select("value", reply.alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    rejected = read.where(bad).select(F.col("value").alias("document"), F.lit("not a JSON document").alias("error"))
    return pages_from_json(read.where(~bad).select("r.query")), rejected


def parse_vectors(df: DataFrame, column: str = "vector") -> DataFrame:
    """Text vectors as arrays; ``vector_ok`` is false where text could not be read."""
    parsed = parse_vector(column)
    return df.withColumn("vector_ok", F.col(column).isNull() | parsed.isNotNull()).withColumn(column, parsed)
