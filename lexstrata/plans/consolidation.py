"""Lexicon consolidation and the Latin merge and cleaning jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text
from ..operators import cleaning, enrichment, ranking
from ..operators.extraction import mine_raw_content
from ..sources.files import read_latin_files


def consolidate(lexicon: DataFrame, row_order: str = "row_no", rank: str = "source_rank") -> DataFrame:
    """One clean lexicon from stacked language tables.

    Stamps periods, drops rows with any blank or missing value and keeps the
    first row per (word, language): lowest source rank, then row order.
    """
    dated = cleaning.with_period(lexicon).select(*fixed.LEXICON_COLUMNS, rank, row_order)
    clean = cleaning.rows_with(cleaning.blanks_to_null(dated), *fixed.LEXICON_COLUMNS)
    kept = ranking.keep_first(clean, ["word", "language"], [F.col(rank), F.col(row_order)])
    return cleaning.lexicon_columns(kept)


def consolidate_files(roots: DataFrame, old_english: DataFrame, us: DataFrame, uk: DataFrame) -> DataFrame:
    """Consolidation of the four sources; each needs a ``row_no``."""
    tables = [
        cleaning.with_language(cleaning.to_lexicon_names(roots), "PIE"),
        cleaning.with_language(cleaning.to_lexicon_names(old_english), "Old English"),
        us, uk,
    ]
    return consolidate(cleaning.stack(*tables))


def merge_latin(full: DataFrame, mined: DataFrame) -> DataFrame:
    """Full entries first, then mined ones; first row per word in file order.

    Both tables carry ``file_path`` and ``file_row``.
    """
    stacked = cleaning.stack(full, mined)
    order = [F.col("source_rank"), F.col("file_path"), F.col("file_row")]
    return ranking.keep_first(stacked, ["original_characters"], order).drop("source_rank", "file_path", "file_row")


def load_latin(spark: SparkSession, folder: str) -> DataFrame:
    """Read, mine and merge the Latin files of a folder."""
    full = read_latin_files(spark, folder, "full")
    mined = mine_raw_content(read_latin_files(spark, folder, "batch"), keep=("file_path", "file_row"))
    return merge_latin(full, mined)


def clean_latin(df: DataFrame, sort: bool = True) -> DataFrame:
    """Clean merged Latin entries.

    Needs a word and a pronunciation or meaning; strips slashes and brackets from
    pronunciations; keeps the smallest row per word; dedupes multi-value cells.
    """
    kept = cleaning.not_all_null(cleaning.canonical_columns(df))
    kept = cleaning.some_of(cleaning.rows_with(kept, "original_characters"), "ipa_phoneme", "english_translation")
    kept = kept.withColumn("ipa_phoneme", text.remove_chars("ipa_phoneme", "/[]"))
    kept = ranking.keep_smallest(kept, ["original_characters"])
    cells = [c for c in ("ipa_phoneme", "english_translation", "part_of_speech") if c in kept.columns]
    kept = kept.withColumns({c: text.dedupe_cell(c) for c in cells})
    return ranking.sort_nulls_last(kept, "original_characters") if sort else kept


def enrich(lexicon: DataFrame, fn: enrichment.EmbedFn, row_id: str) -> DataFrame:
    """Drop rows without a meaning, then add the vector of the meaning.

    The filter runs before the model, which the optimizer could not arrange.
    """
    return enrichment.embed(cleaning.rows_with(lexicon, "english_translation"), "english_translation", fn, row_id)
