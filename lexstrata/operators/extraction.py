"""Wikitext and HTML extraction jobs over page tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import wikitext as wt
from .cleaning import root_pages


def extract_roots(pages: DataFrame) -> DataFrame:
    """Root entries of root pages: word, phonology, meanings, description."""
    return root_pages(pages.where(F.col("content").isNotNull())).select(
        wt.root_word("title").alias("original_characters"),
        wt.root_phonology("content").alias("ipa_phoneme"),
        wt.root_definitions("content").alias("english_translation"),
        wt.root_description("content").alias("description"),
    )


def extract_raw_sections(pages: DataFrame) -> DataFrame:
    """Root pages with their named sections, absent ones null."""
    return root_pages(pages.where(F.col("content").isNotNull())).select(
        "title",
        wt.root_word("title").alias("original_characters"),
        F.col("content").alias("raw_content"),
        *[wt.raw_section("content", name).alias(f"{name}_section") for name, _ in fixed.RAW_SECTIONS],
    )


def extract_terms(pages: DataFrame, language: str, section_mode: str = "first", with_pos: bool | None = None,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Terms of one language; pages without its section are dropped.

    In ``first`` mode the section ends at its first sub-heading and a definition
    must follow its heading directly, so a headword line in between hides it.
    """
    pos = fixed.TERM_POS.get(language, fixed.TERM_POS["Latin"])
    with_pos = language == "Latin" if with_pos is None else with_pos
    # Filtering on the page, not on the cut-out section, keeps the cut from being made twice.
    section = wt.section_pattern(language, section_mode)
    found = pages.where(F.col("content").rlike(section)).select(
        *keep, "title", F.regexp_extract("content", section, 1).alias("raw_content"))
    columns = [
        F.col("title"),
        F.col("title").alias("original_characters"),
        wt.term_ipa("raw_content").alias("ipa_phoneme"),
        wt.term_definition("raw_content", pos).alias("english_translation"),
    ]
    if with_pos:
        columns.append(wt.term_pos("raw_content", pos).alias("part_of_speech"))
    return found.select(*keep, *columns, "raw_content")


def mine_raw_content(batches: DataFrame, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pronunciations, meanings and parts of speech mined from raw content.

    Values the row already had are appended after the found ones.
    """
    found = {
        "ipa_phoneme": wt.mined_ipa("raw_content", strict),
        "english_translation": wt.mined_translation("raw_content"),
        "part_of_speech": wt.mined_pos("raw_content"),
    }
    empty = F.lit(None).cast("string")
    return batches.select(*keep, *[
        wt.merge_found(value, F.col(name) if name in batches.columns else empty).alias(name)
        for name, value in found.items()
    ], "original_characters")


class _Outline(HTMLParser):
    """Texts under one heading, and pronunciations, of one page.

    Elements nest as they are opened: an end tag closes up to its latest open
    element and is ignored without one, so unclosed elements hold what follows.
    The page's text is kept once; an element is the stretch since its start.
    """

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    HIDDEN = frozenset(("script", "style", "template"))

    def __init__(self, heading: str | None, levels: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.heading, self.levels = heading, levels
        self.open: list[dict] = []
        self.count: Counter = Counter()
        self.text: list[str] = []
        self.level: int | None = None           # open elements around the heading found
        self.section: list[str] | None = None
        self.done = False
        self.ipa: dict[str, str] = {}

    def parse_marked_section(self, i, report=1):
        """``<![...`` is a comment up to the next ``>``, as browsers read it."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        sibling = self.level == len(self.open) and not self.done
        if sibling and tag.startswith("h"):
            self.done = True
        kinds = []
        if tag == "span" and "IPA" in (attrs.get("class") or "").split():
            kinds.append("class")
        if tag == "span" and attrs.get("lang") == "en-IPA":
            kinds.append("lang")
        kinds = [k for k in kinds if k not in self.ipa]
        self.ipa.update(dict.fromkeys(kinds, ""))
        self._child()
        self.open.append({"tag": tag, "start": len(self.text), "hidden": [], "in": sibling and not self.done,
                          "kinds": kinds, "children": 0})
        self.count[tag] += 1
        if tag in self.VOID:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.count[tag]:
            while self.open[-1]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        self._child()
        if self.open and self.open[-1]["tag"] in self.HIDDEN:
            self.open[-1]["hidden"].append(data)
        else:
            self.text.append(data)

    def _child(self):
        if self.open:
            self.open[-1]["children"] += 1

    def _close(self):
        e = self.open.pop()
        self.count[e["tag"]] -= 1
        depth = len(self.open)
        if not e["in"] and self.level is not None and depth < self.level:
            self.done = True
        heading = self.section is None and e["tag"] in self.levels and e["children"] <= 1
        if not (e["in"] or e["kinds"] or heading):
            return
        text = "".join(e["hidden"] if e["tag"] in self.HIDDEN else self.text[e["start"]:])
        self.ipa.update(dict.fromkeys(e["kinds"], text.strip()))
        if e["in"]:
            self.section.append(text.strip())
        elif heading and (self.heading is None or text == self.heading):
            self.section, self.level = [], depth

    def finish(self) -> "_Outline":
        self.close()
        while self.open:
            self._close()
        return self


def _read_page(html: str | None, heading: str | None, levels: tuple[str, ...]) -> tuple[str | None, str | None, str | None]:
    """Pronunciation, section and what went wrong; one page never ends the run."""
    if html is None:
        return None, None, None
    try:
        page = _Outline(heading, levels)
        page.feed(html)
        page.finish()
    except Exception as e:
        return None, None, f"{type(e).__name__}: {e}"
    ipa = page.ipa.get("class", page.ipa.get("lang"))
    return ipa, None if page.section is None else " ".join(page.section), None


def may_hold(html: Column, levels: tuple[str, ...]) -> Column:
    """False only for pages that hold neither a pronunciation nor a heading of these levels."""
    tags = "|".join(levels)
    return html.contains("IPA") | html.rlike("(?i)<span[^>]*&") | html.rlike(f"(?i)<(?:{tags})")


def extract_html(pages: DataFrame, page_id: str = "page_id", html: str = "html",
                 heading: str | None = "Etymology", levels: tuple[str, ...] = ("h3", "h4")) -> DataFrame:
    """Pronunciation, the text after one heading and an error, per HTML page.

    The heading is the first of ``levels`` whose whole text is ``heading`` (None:
    the first with plain text). Its text is that of the elements after it, on its
    own level, up to the next whose name starts with ``h``. Only pages that may hold
    one of the two are handed to the parser; the others stay where they are.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_read_page(h, heading, levels) for h in batch["html"]]
            yield pd.DataFrame({
                page_id: batch["page_id"],
                "ipa": pd.Series([f[0] for f in found], dtype=object),
                "section_text": pd.Series([f[1] for f in found], dtype=object),
                "error": pd.Series([f[2] for f in found], dtype=object),
            })

    kept = F.when(may_hold(F.col(html), levels), F.col(html))    # a null page reads as nothing found
    source = pages.select(F.col(page_id).alias("page_id"), kept.alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()
    return source.mapInPandas(read, f"{page_id} {kind}, ipa string, section_text string, error string")
