"""Text expressions shared by the extraction and cleaning operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import BLANKS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Every blank as one plain character class: much faster than a unicode class.
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def pattern(text: str, flags: str = "") -> str:
    r"""A fixed pattern in Spark's dialect.

    ``d`` lets only ``\n`` end a line, as in the common dialect; ``s``/``m`` are
    added where asked, and ``U`` only where ``\w`` or ``\d`` must be unicode.
    ``\Z`` is the very end of the text.
    """
    unicode = "U" if re.search(r"\\[wd]", text) else ""
    text = text.replace(r"\Z", r"\z").replace("(?P<", "(?<")
    return f"(?d{unicode}{flags})" + text.replace(r"\s", _BLANK)


def strip(c: Column | str) -> Column:
    """Remove blanks of every kind from both ends (``trim`` removes spaces only)."""
    return F.btrim(col(c), F.lit(BLANKS))


def blank_to_null(c: Column | str) -> Column:
    """Null when nothing but blanks is there; other text is kept untouched."""
    c = col(c)
    return F.when(strip(c) != "", c)


def empty_to_null(c: Column | str) -> Column:
    # Unlike when(c != "", c), this evaluates c once.
    return F.nullif(col(c), F.lit(""))


def first_group(c: Column | str, pat: str, group: int = 1) -> Column:
    """One group of the first match; null without a match."""
    c = col(c)
    return F.when(c.rlike(pat), F.regexp_extract(c, pat, group))


def opening(text: str) -> str:
    """The fixed characters that every match of a pattern begins with; '' where unsure."""
    plain = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "", text)
    while "(" in plain and (inner := re.sub(r"\([^()]*\)", "", plain)) != plain:
        plain = inner
    if "|" in plain or "(?i" in text:
        return ""
    out, at = "", 0
    while at < len(text):
        step = 2 if text[at] == "\\" else 1
        if step == 2 and text[at + 1].isalnum() or step == 1 and text[at] in ".^$*+?{}[]|()":
            break
        if text[at + step:at + step + 1] in ("?", "*", "{"):
            break
        out += text[at + step - 1]
        at += step
    return out


def find_all(c: Column | str, patterns: tuple[str, ...], flags: str = "") -> Column:
    """All matches of several fixed patterns, pattern by pattern.

    A match gives its first group, or itself where the pattern has none. A pattern
    is run only over texts that hold its opening, which is far quicker to look for.
    """
    def found(p: str) -> Column:
        matches = F.regexp_extract_all(col(c), F.lit(pattern(p, flags)), F.lit(min(re.compile(p).groups, 1)))
        start = "" if "i" in flags else opening(p)
        return matches if len(start) < 2 else F.when(F.contains(col(c), F.lit(start)), matches).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[found(p) for p in patterns]))


def collapse_blanks(c: Column | str) -> Column:
    """Every run of blanks as one space.

    Character replacement and a literal pattern are about twice as fast as a
    pattern over the class of all blanks.
    """
    others = BLANKS.replace(" ", "")
    return F.regexp_replace(F.translate(col(c), others, " " * len(others)), " {2,}", " ")


def words(c: Column | str) -> Column:
    """Lower-cased blank-separated words; an all-blank text has none."""
    text = empty_to_null(strip(F.lower(col(c))))
    return F.coalesce(F.split(collapse_blanks(text), " "), F.array().cast("array<string>"))


def join_sorted_distinct(values: Column, separator: str = "; ") -> Column:
    """Sorted distinct values joined; null when nothing is joined."""
    return empty_to_null(F.array_join(F.sort_array(F.array_distinct(values)), separator))


def join_distinct(values: Column, separator: str = "; ") -> Column:
    """Distinct values in first-seen order joined; null when nothing is joined."""
    return empty_to_null(F.array_join(F.array_distinct(values), separator))


def dedupe_cell(c: Column | str, separator: str = "; ") -> Column:
    """Sorted distinct parts of a multi-value cell; '' and 'None' become null."""
    return F.nullif(join_sorted_distinct(F.split(col(c), re.escape(separator))), F.lit("None"))


def remove_chars(c: Column | str, chars: str) -> Column:
    return F.translate(col(c), chars, "")


def clean_ipa(c: Column | str) -> Column:
    """Pronunciation without slashes and brackets; nothing left gives null."""
    return empty_to_null(strip(remove_chars(c, "/[]")))
