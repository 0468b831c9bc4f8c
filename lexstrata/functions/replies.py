"""Line-formatted replies as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import clean_ipa, col, strip


def reply_segments(body: Column | str) -> Column:
    """The entries of a reply, stripped."""
    return F.transform(F.split(col(body), fixed.REPLY_SEPARATOR), strip)


def reply_field(segment: Column | str, field: str) -> Column:
    """Last accepted ``field: value`` line; null when there is none."""
    prefix = f"{field}:"
    lines = F.transform(F.split(col(segment), "\n"), strip)
    values = F.transform(
        F.filter(lines, lambda line: F.lower(line).startswith(prefix)),
        lambda line: F.btrim(strip(F.substring(line, len(prefix) + 1, 2**31 - 1)), F.lit("[]")),
    )
    accepted = F.filter(values, lambda v: ~v.isin(*fixed.REJECTED_VALUES))
    return strip(F.try_element_at(accepted, F.lit(-1)))


def reply_record(segment: Column | str, original: Column | str,
                 fields: tuple[str, ...] = fixed.REPLY_FIELDS_TERM) -> list[Column]:
    """The parsed fields and ``original_characters``.

    A record with no value at all has every column null.
    """
    original = col(original)
    values = []
    for name in fields:
        value = reply_field(segment, name)
        values.append(clean_ipa(value) if name == "ipa_phoneme" else value)
    some = original != ""
    for v in values:
        some = some | (F.coalesce(v, F.lit("")) != "")
    return [v.alias(n) for v, n in zip(values, fields)] + [F.when(some, original).alias("original_characters")]


def prompt_sections(sections: dict[str, Column], raw_content: Column | str) -> Column:
    """Titled blocks of the sections present, else the raw content."""
    blocks = [
        F.when(F.coalesce(sections[name], F.lit("")) != "",
               F.concat(F.lit(f"\n{name.title()} Section:\n"), sections[name], F.lit("\n")))
        for name in fixed.PROMPT_SECTIONS
    ]
    text = F.concat_ws("", *blocks)
    return F.when(strip(text) != "", text).otherwise(F.coalesce(col(raw_content), F.lit("")))
