"""Extraction from wikitext as plain Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import (
    col,
    collapse_blanks,
    empty_to_null,
    find_all,
    first_group,
    join_distinct,
    join_sorted_distinct,
    pattern,
    strip,
)


def clean_markup(c: Column | str) -> Column:
    """Plain text of a markup fragment; null gives ''."""
    out = F.coalesce(col(c), F.lit(""))
    for pat, flags, replacement in fixed.MARKUP_STEPS:
        out = F.regexp_replace(out, pattern(pat, flags), replacement)
    return strip(collapse_blanks(out))


def root_word(title: Column | str) -> Column:
    """The root itself from a page title."""
    return strip(F.replace(col(title), F.lit(fixed.ROOT_TITLE_PREFIX), F.lit("")))


def is_root_title(title: Column | str) -> Column:
    title = col(title)
    return ~title.startswith(fixed.CATEGORY_PREFIX) & title.contains(fixed.ROOT_TITLE_MARK)


def root_definitions(content: Column | str) -> Column:
    found = F.transform(find_all(content, fixed.ROOT_DEFINITIONS, "s"), clean_markup)
    return join_distinct(F.filter(found, lambda v: F.length(v) > 1))


def root_phonology(content: Column | str) -> Column:
    found = F.transform(find_all(content, fixed.ROOT_PHONOLOGY), clean_markup)
    kept = F.filter(found, lambda v: (v != "") & ~v.startswith("id=") & ~v.startswith("pos="))
    return join_distinct(kept)


def root_description(content: Column | str) -> Column:
    parts = [clean_markup(first_group(content, pattern(p, "s"))) for p in fixed.ROOT_DESCRIPTION]
    return empty_to_null(F.concat_ws(" | ", *[empty_to_null(p) for p in parts]))


def raw_section(content: Column | str, name: str) -> Column:
    """One named section, stripped; null when the page has none."""
    return strip(first_group(content, pattern(dict(fixed.RAW_SECTIONS)[name], "s")))


def section_pattern(language: str, mode: str = "first") -> str:
    """Pattern of a language section.

    ``first`` ends at the next heading of any level, so it keeps only what comes
    before the first sub-heading; ``full`` ends at the next same-level heading.
    """
    text = {"first": fixed.SECTION_FIRST, "full": fixed.SECTION_FULL}[mode]
    return pattern(text.replace("{language}", re.escape(language)), "s")


def term_ipa(section: Column | str) -> Column:
    return first_group(section, pattern(fixed.TERM_IPA))


def _definition_pattern(pos: tuple[str, ...]) -> str:
    return pattern(fixed.TERM_DEFINITION.replace("{pos}", "|".join(pos)), "s")


def term_pos(section: Column | str, pos: tuple[str, ...]) -> Column:
    return first_group(section, _definition_pattern(pos), 1)


def term_definition(section: Column | str, pos: tuple[str, ...]) -> Column:
    return strip(first_group(section, _definition_pattern(pos), 2))


def _content(c: Column | str) -> Column:
    # A missing text is read as the word "nan", which no pattern matches.
    return F.coalesce(col(c), F.lit("nan"))


def mined_ipa(c: Column | str, strict: bool = False) -> Column:
    """Pronunciations in raw content, sorted distinct, '; '-joined.

    The bracket form also takes the inside of a wiki link with one bracket left
    on; ``strict`` drops those. The annotation step runs after the cut at the
    first bar, so it never finds anything; it is kept for equal results.
    """
    def tidy(v: Column) -> Column:
        v = strip(F.element_at(F.split(v, r"\|"), 1))
        v = F.regexp_replace(v, pattern(fixed.MINE_IPA_ANNOTATION), "")
        return F.regexp_replace(v, pattern(fixed.MINE_IPA_LENGTH), "ː")

    found = F.transform(find_all(_content(c), fixed.MINE_IPA), tidy)
    keep = (lambda v: (v != "") & ~v.startswith("[")) if strict else (lambda v: v != "")
    return join_sorted_distinct(F.filter(found, keep))


def mined_translation(c: Column | str) -> Column:
    """Meanings in raw content, sorted distinct, '; '-joined."""
    def tidy(v: Column) -> Column:
        v = F.regexp_replace(strip(v), pattern(fixed.MINE_TEMPLATE), "")
        return F.regexp_replace(v, pattern(fixed.MINE_LINK), "")

    found = F.transform(find_all(_content(c), fixed.MINE_TRANSLATION, "m"), tidy)
    return join_sorted_distinct(F.filter(found, lambda v: v != ""))


def mined_pos(c: Column | str) -> Column:
    """Parts of speech in raw content through the name table.

    Two patterns have no group and yield a whole template, which the table never
    holds; they are kept for equal results.
    """
    names = F.create_map(*[F.lit(x) for pair in fixed.POS_NAMES.items() for x in pair])
    found = F.transform(
        find_all(_content(c), fixed.MINE_POS),
        lambda v: F.element_at(names, strip(F.lower(v))),
    )
    return join_sorted_distinct(F.filter(found, lambda v: v.isNotNull()))


def merge_found(found: Column | str, existing: Column | str) -> Column:
    """Found values, then the value the row already had; null when neither."""
    existing = col(existing)
    return empty_to_null(F.concat_ws("; ", col(found), empty_to_null(existing)))
