"""Prompt batches and their replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.replies import reply_record, reply_segments
from ..functions.text import strip
from .ranking import with_batches


def batch_entries(entries: DataFrame, size: int = 20, content: Column | str = "raw_content") -> DataFrame:
    """Entries with their batch and their place in it (from dense positions)."""
    placed = with_batches(entries, size)
    body = F.col(content) if isinstance(content, str) else content
    return placed.withColumns({
        "place": (F.col("position") % size).cast("int"),
        "_content": F.coalesce(body, F.lit("")),
    })


def batch_bodies(placed: DataFrame, kind: str = "term") -> DataFrame:
    """One body per batch: its entries in order, each closed by a separator line.

    Terms have their content under a line of its own; a root's blocks follow the title.
    """
    heading, gap = {"term": ("\nContent:\n", "\n\n"), "root": ("\n", "\n")}[kind]
    text = F.concat(
        F.lit("Entry "), (F.col("place") + 1).cast("string"), F.lit(":\nTitle: "),
        F.coalesce(F.col("title"), F.lit("")), F.lit(heading), F.col("_content"),
        F.lit(f"{gap}{fixed.REPLY_SEPARATOR}\n"),
    )
    packed = placed.groupBy("batch").agg(
        F.sort_array(F.collect_list(F.struct("place", text.alias("text")))).alias("parts"))
    return packed.select("batch", F.size("parts").alias("entries"),
                         F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("body"))


def reply_rows(replies: DataFrame) -> DataFrame:
    """(batch, place, segment) rows of the replies."""
    return replies.where(F.col("reply").isNotNull()).select(
        "batch", F.posexplode(reply_segments("reply")).alias("place", "segment"))


def parse_replies(placed: DataFrame, replies: DataFrame,
                  fields: tuple[str, ...] = fixed.REPLY_FIELDS_TERM, original: Column | None = None) -> DataFrame:
    """Entries joined to their reply segments by place; whichever side is shorter ends a batch.

    ``original`` gives ``original_characters`` from the title (default: the title, stripped).
    Where replies carry an ``error``, the entries of failed batches come too, with
    that error and no values.
    """
    original = strip(F.coalesce(F.col("title"), F.lit(""))) if original is None else original
    joined = placed.select("batch", "place", "title").join(reply_rows(replies), ["batch", "place"])
    found = joined.select("batch", "place", *reply_record("segment", original, fields))
    if "error" not in replies.columns:
        return found
    failed = placed.select("batch", "place").join(replies.where(F.col("reply").isNull()).select("batch", "error"), "batch")
    return found.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)
