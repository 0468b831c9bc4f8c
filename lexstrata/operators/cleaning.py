"""Projections, filters and set operations on lexicon tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import text, wikitext

RENAMES = {"original_characters": "word", "ipa_phoneme": "phonetic_representation"}


def strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


# Projections

def to_lexicon_names(df: DataFrame, drop: tuple[str, ...] = ("raw_content", "title", "description")) -> DataFrame:
    """Drop working columns where present and use the lexicon's names."""
    return df.drop(*drop).withColumnsRenamed(RENAMES)


def with_language(df: DataFrame, language: str) -> DataFrame:
    return df.withColumn("language", F.lit(language))


def with_period(df: DataFrame, labels: dict[str, int] | None = None, label: str = "language") -> DataFrame:
    """Period of each label; an unknown label gives null."""
    pairs = fixed.LANGUAGE_PERIODS if labels is None else labels
    return df.withColumn("time_period", F.element_at(literal_map(pairs), F.col(label)).cast("int"))


def with_canonical_language(df: DataFrame, label: str = "language") -> DataFrame:
    """One spelling per language; a label in no vocabulary is kept."""
    known = F.element_at(literal_map(fixed.CANONICAL_LANGUAGES), F.col(label))
    return df.withColumn(label, F.coalesce(known, F.col(label)))


def lexicon_columns(df: DataFrame) -> DataFrame:
    return df.select(*fixed.LEXICON_COLUMNS)


def canonical_columns(df: DataFrame, wanted: tuple[str, ...] = fixed.LATIN_COLUMNS) -> DataFrame:
    """The wanted columns if all of them exist, else the table unchanged."""
    return df.select(*wanted) if set(wanted) <= set(df.columns) else df


def with_metadata(df: DataFrame) -> DataFrame:
    """Metadata record with defaults; word and translation columns must exist."""
    def optional(name: str, default: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in df.columns else F.lit(default)

    return df.withColumn("metadata", F.struct(
        F.col("word").alias("word"),
        optional("language", "Unknown").alias("language"),
        F.col("english_translation").alias("translation"),
        optional("phonetic_representation", "").alias("phonetic"),
        optional("time_period", "Unknown").alias("time_period"),
    ))


def percent(value: Column | str) -> Column:
    """A share shown in percent with one decimal."""
    return F.round(text.col(value) * 100, 1)


def plot_feed(df: DataFrame, coordinates: list[str], color_by: str = "language") -> DataFrame:
    """Coordinates, colour key and hover columns."""
    hover = ["word", "english_translation", "language", "time_period", "phonetic_representation"]
    return df.select(*coordinates, F.col(color_by).alias("color"), *hover)


def timeline_feed(df: DataFrame, coordinates: list[str]) -> DataFrame:
    """Animation frames: one per period, ordered by it."""
    return df.select(F.col("time_period").alias("frame"), *coordinates, F.col("language").alias("color"),
                     "word", "english_translation").orderBy("frame")


# Filters and validation

def blanks_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: text.blank_to_null(c) for c in strings(df)})


def strip_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({c: text.strip(c) for c in strings(df)})


def complete_rows(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def rows_with(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna("any", subset=list(columns))


def not_all_null(df: DataFrame) -> DataFrame:
    return df.dropna("all")


def some_of(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with at least one of the columns."""
    return df.where(F.coalesce(*[F.col(c) for c in columns]).isNotNull())


def root_pages(df: DataFrame, title: str = "title") -> DataFrame:
    return df.where(wikitext.is_root_title(title))


def has_fields(df: DataFrame, required: tuple[str, ...] = fixed.REQUIRED_FIELDS) -> bool:
    return set(required) <= set(df.columns)


def check_fields(df: DataFrame, required: tuple[str, ...] = fixed.REQUIRED_FIELDS) -> tuple[DataFrame, bool]:
    """Raw tables first get empty result columns, replacing any they had."""
    if "raw_content" in df.columns:
        empty = F.lit(None).cast("string")
        df = df.withColumns({c: empty for c in ("ipa_phoneme", "english_translation", "description")})
    return df, has_fields(df, required)


def na_to_null(df: DataFrame) -> DataFrame:
    """Null for every spelling of a missing value."""
    return df.withColumns({c: F.when(~F.col(c).isin(*fixed.NA_TOKENS), F.col(c)) for c in strings(df)})


# Set operations

def stack(*frames: DataFrame) -> DataFrame:
    """Concatenation by column name; ``source_rank`` keeps the list order."""
    ranked = [f.withColumn("source_rank", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def clean_basic(df: DataFrame) -> DataFrame:
    """Strip every text column, then drop repeated rows."""
    return strip_strings(df).distinct()
