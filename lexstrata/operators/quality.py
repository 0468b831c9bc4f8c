"""Profiling and audit aggregates, each one pass over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .ranking import keep_smallest


def column_coverage(df: DataFrame) -> DataFrame:
    """Non-null count and percent of every column, one row per column."""
    counts = [F.count(F.col(c)).alias(c) for c in df.columns]
    row = df.agg(F.count("*").alias("_rows"), *counts)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("non_null")) for c in df.columns])
    return row.select("_rows", F.explode(pairs).alias("p")).select(
        "p.column_name", "p.non_null",
        F.try_divide(F.col("p.non_null") * 100.0, F.col("_rows")).alias("percent"),
    )


def rate(column: str) -> Column:
    """Percent of rows with a value; null for no rows."""
    return (F.avg(F.col(column).isNotNull().cast("double")) * 100).alias(f"{column}_rate")


def success_rates(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count("*").alias("entries"), *[rate(c) for c in columns])


def distinct_terms(df: DataFrame, term: str, approximate: bool = False) -> DataFrame:
    """The number of distinct terms, exact or from a sketch."""
    return sketched_terms(term_sketches(df, term)) if approximate else df.agg(F.count_distinct(F.col(term)).alias("unique_terms"))


def term_sketches(df: DataFrame, term: str, *by: str, precision: int = 14) -> DataFrame:
    """A sketch of the distinct terms of each group, a few KB however many they are.

    Stored beside each batch, sketches are merged later without reading the terms again.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(term, precision).alias("sketch"))


def merge_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """The sketch of all rows behind several sketches: the same one as a sketch of the rows themselves."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_terms(sketches: DataFrame) -> DataFrame:
    """The estimated number of distinct terms of each sketch."""
    return sketches.withColumn("unique_terms", F.hll_sketch_estimate("sketch")).drop("sketch")


_STEPS = ("loaded", "not_empty", "required", "unique")


def _steps(counts: dict[str, int]) -> list[tuple[int, str, int, int]]:
    left = [counts[s] for s in _STEPS]
    return [(i, s, n, left[max(i - 1, 0)] - n) for i, (s, n) in enumerate(zip(_STEPS, left))]


def write_audited(df: DataFrame, path: str, key: str = "original_characters",
                  some_of: tuple[str, ...] = ("ipa_phoneme", "english_translation"), order: tuple[str, ...] = ()) -> DataFrame:
    """Clean the rows into a table and report what each step removed, counted by the run that writes.

    The steps are those of ``cleaning_audit``; of rows with one key the smallest by
    ``order`` stays. Counts are observed on the plan, so the source is read once. A task
    that is run again after its result was lost may be counted twice; ``cleaning_audit``
    of the source is the check.
    """
    seen = {s: Observation(s) for s in _STEPS}

    def observed(rows: DataFrame, step: str) -> DataFrame:
        return rows.observe(seen[step], F.count(F.lit(1)).alias("n"))

    rows = observed(df, "loaded")
    rows = observed(rows.where(F.coalesce(*[F.col(c).cast("string") for c in df.columns]).isNotNull()), "not_empty")
    rows = observed(rows.where(F.col(key).isNotNull() & F.coalesce(*[F.col(c) for c in some_of]).isNotNull()), "required")
    rows = observed(keep_smallest(rows, [key], list(order or df.columns)), "unique")
    rows.write.mode("overwrite").parquet(path)
    counts = {s: o.get["n"] for s, o in seen.items()}
    return df.sparkSession.createDataFrame(_steps(counts), "step int, stage string, rows_out long, removed long")


def cleaning_audit(df: DataFrame, key: str = "original_characters",
                   some_of: tuple[str, ...] = ("ipa_phoneme", "english_translation")) -> DataFrame:
    """Rows left after each cleaning step and rows each step removes."""
    present = F.coalesce(*[F.col(c).cast("string") for c in df.columns]).isNotNull()
    required = F.col(key).isNotNull() & F.coalesce(*[F.col(c) for c in some_of]).isNotNull()
    row = df.agg(
        F.count("*").alias("s0"),
        F.count_if(present).alias("s1"),
        F.count_if(required).alias("s2"),
        F.count_distinct(F.when(required, F.col(key))).alias("s3"),
    )
    steps = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(f"s{i}").alias("rows_out"),
                 (F.col(f"s{max(i - 1, 0)}") - F.col(f"s{i}")).alias("removed"))
        for i, n in enumerate(_STEPS)
    ])
    return row.select(F.explode(steps).alias("x")).select("x.*")


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("entries"))


def outcome_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("words"))


def first_failures(df: DataFrame, order: str, n: int = 10, status: str = "status") -> DataFrame:
    """The report of the first n failed rows."""
    return df.where(F.col(status) == "failed").orderBy(order).limit(n)
