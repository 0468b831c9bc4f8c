"""Harvest: landed pages to parsed dictionary entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import wikitext as wt
from ..functions.replies import prompt_sections
from ..operators.cleaning import root_pages
from ..operators.enrichment import ask
from ..operators.extraction import extract_terms
from ..operators.joins import not_done
from ..operators.quality import success_rates
from ..operators.ranking import with_position
from ..operators.replies import batch_bodies, batch_entries, parse_replies
from ..session import land, scratch_path
from ..sources.tables import table_exists


def answered(bodies: DataFrame, reply_fn: Callable[[str], str | None], path: str) -> DataFrame:
    """Replies landed under ``path`` by batch; only batches without a reply there are asked.

    Whatever reads the result later asks nothing again. A batch that failed before
    is asked again by the next run; the latest row of a batch counts.
    """
    spark = bodies.sparkSession
    waiting = bodies
    if table_exists(spark, path):
        waiting = not_done(bodies, spark.read.parquet(path).where(F.col("reply").isNotNull()), "batch")
    ask(waiting, reply_fn).withColumn("asked_at", F.current_timestamp()).write.mode("append").parquet(path)
    latest = F.max_by(F.struct("reply", "error"), F.struct(F.col("reply").isNotNull(), F.col("asked_at")))
    found = spark.read.parquet(path).groupBy("batch").agg(latest.alias("_l"))
    return found.select("batch", "_l.reply", "_l.error")


def _parsed(entries: DataFrame, reply_fn, batch_size: int, order: str, replies: str | None, kind: str,
            content: Column | str, fields: tuple[str, ...], original: Column | None) -> DataFrame:
    """Number, batch, ask and parse landed entries."""
    placed = batch_entries(with_position(entries, order), batch_size, content)
    path = replies or scratch_path(entries.sparkSession, "replies")
    return parse_replies(placed, answered(batch_bodies(placed, kind), reply_fn, path), fields, original)


def harvest(pages: DataFrame, language: str, reply_fn: Callable[[str], str | None], batch_size: int = 20,
            order: str = "page_id", replies: str | None = None) -> DataFrame:
    """Extract terms, batch them, ask for each batch and parse the replies.

    ``pages``: (page_id, title, content). Batches are numbered in page order. The
    extracted terms are landed, because numbering and joining read them again, and
    so are the replies (under ``replies`` if named, to go on after a stop). The
    entries of failed batches come with their ``error`` and no values.
    """
    terms = land(extract_terms(pages, language, keep=(order,)), "terms")
    return _parsed(terms, reply_fn, batch_size, order, replies, "term", "raw_content", fixed.REPLY_FIELDS_TERM, None)


def harvest_roots(pages: DataFrame, reply_fn: Callable[[str], str | None], batch_size: int = 20,
                  order: str = "page_id", replies: str | None = None) -> DataFrame:
    """The same for root pages: the sections found make the body, and the reply has a description."""
    roots = root_pages(pages)
    sections = {name: wt.raw_section("content", name) for name in fixed.PROMPT_SECTIONS}
    entries = land(roots.select(order, "title", prompt_sections(sections, "content").alias("_body")), "roots")
    return _parsed(entries, reply_fn, batch_size, order, replies, "root", "_body", fixed.REPLY_FIELDS_ROOT, wt.root_word("title"))


def batch_rates(parsed: DataFrame) -> DataFrame:
    """Success rates per batch."""
    return success_rates(parsed, ["ipa_phoneme", "english_translation"], ["batch"])
