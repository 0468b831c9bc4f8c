"""Hand fixtures for text extraction."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexstrata import fixed
from lexstrata.functions import replies, text, wikitext
from lexstrata.operators.extraction import _read_page, extract_html, extract_roots, extract_terms


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn("x").alias("y")).first()["y"]


@pytest.mark.parametrize("raw, plain", [
    ("'''to [[go|move]]''' {{l|en|x}} <ref name=a>q</ref>fast<ref name=b/>  \n now", "to move fast now"),
    ("it's", "its"),
    ("[[a|b|c]]", "b|c"),
    ("{{a{{b}}c}}", "c}}"),
    (" a\t\x1cb　", "a b"),
    (None, ""),
])
def test_clean_markup(spark, raw, plain):
    assert one(spark, raw, wikitext.clean_markup) == plain


@pytest.mark.parametrize("raw, ipa, meaning, pos", [
    ("===Noun===\n{{la-noun|canis|m}}\n# a dog.\n* IPA(key): /ˈka.nis/\n", "ˈka.nis",
     "/ˈka; IPA(key): /ˈka; a dog", "noun"),
    ("{{la-IPA|cā'nis|ann=1}} [[dog|hound]] ===Verb===\n# to run", "[dog; cāːnis", "to run", "verb"),
    (None, None, None, None),
    ("==x==\n: see here. meaning \"small\"", None, "see here; small", None),
])
def test_mining(spark, raw, ipa, meaning, pos):
    assert one(spark, raw, wikitext.mined_ipa) == ipa
    assert one(spark, raw, wikitext.mined_translation) == meaning
    assert one(spark, raw, wikitext.mined_pos) == pos


def test_mining_strict_skips_link_brackets(spark):
    assert one(spark, "[[dog]] [kanis]", lambda c: wikitext.mined_ipa(c, strict=True)) == "kanis"


def test_merge_and_dedupe(spark):
    rows = spark.createDataFrame([("a; b", "b"), (None, "b"), ("a", ""), (None, None)], "f string, e string")
    merged = [r[0] for r in rows.select(wikitext.merge_found("f", "e")).collect()]
    assert merged == ["a; b; b", "b", "a", None]
    assert one(spark, "a; b; b", text.dedupe_cell) == "a; b"
    assert one(spark, "None", text.dedupe_cell) is None
    assert one(spark, "", text.dedupe_cell) is None


def test_clean_ipa(spark):
    assert one(spark, " /[ka]/ ", text.clean_ipa) == "ka"
    assert one(spark, "[/]", text.clean_ipa) is None


def test_reply_fields(spark):
    body = "IPA_Phoneme: [ˈka.nis]\nenglish_translation: dog: a canine\npart_of_speech: null"
    get = lambda f: one(spark, body, lambda c: replies.reply_field(c, f))
    assert (get("ipa_phoneme"), get("english_translation"), get("part_of_speech")) == ("ˈka.nis", "dog: a canine", None)
    twice = "english_translation: a\nenglish_translation: b\nenglish_translation: ..."
    assert one(spark, twice, lambda c: replies.reply_field(c, "english_translation")) == "b"


def test_empty_reply_has_no_word(spark):
    df = spark.createDataFrame([("nothing here", "", "x"), ("ipa_phoneme: a", "", "x")], "s string, o string, t string")
    rows = df.select(*replies.reply_record("s", "o")).collect()
    assert rows[0]["original_characters"] is None and rows[1]["original_characters"] == ""


def test_prompt_sections(spark):
    df = spark.createDataFrame([("r", "", None, "n", "raw"), (None, None, None, None, "raw")],
                               "root string, etymology string, reconstruction string, notes string, raw string")
    sections = {n: F.col(n) for n in fixed.PROMPT_SECTIONS}
    out = [r[0] for r in df.select(replies.prompt_sections(sections, "raw")).collect()]
    assert out == ["\nRoot Section:\nr\n\nNotes Section:\nn\n", "raw"]


def test_roots(spark):
    page = ("===Root===\nline\n# to [[carry|bear]]\n# b\n# to bring\n\n===Reconstruction===\n*bʰer-\n"
            "{{PIE|bʰer|id=x}}{{ine-root|id=1}}\n====Reconstruction notes====\nnoted ''well''\n===X===\n")
    df = spark.createDataFrame([(1, "Reconstruction:Proto-Indo-European/bʰer- ", page),
                                (2, "Category:Proto-Indo-European", page), (3, "Latin", page)],
                               "page_id int, title string, content string")
    row, = extract_roots(df).collect()
    assert row["original_characters"] == "bʰer-"
    assert row["ipa_phoneme"] == "bʰer; *bʰer-"
    assert row["english_translation"] == "to bear; to bring"
    assert row["description"] == "noted well"


def test_section_modes(spark):
    page = "==Latin==\n* IPA: /ka/\n===Noun===\n# dog\nmore\n==French==\nx"
    df = spark.createDataFrame([("canis", page), ("x", "==French==\n")], "title string, content string")
    first, = extract_terms(df, "Latin").collect()
    assert (first["ipa_phoneme"], first["english_translation"], first["part_of_speech"]) == ("ka", None, None)
    assert first["raw_content"] == "* IPA: /ka/"
    full, = extract_terms(df, "Latin", "full").collect()
    assert (full["english_translation"], full["part_of_speech"]) == ("dog", "Noun")


@pytest.mark.parametrize("html, ipa, section", [
    ('<span class="IPA">/a/</span>', "/a/", None),
    ('<span lang="en-IPA">b</span>', "b", None),
    ('<span lang="en-IPA">b</span><span class="x IPA"> /c/ </span>', "/c/", None),
    ("<p>x</p>", None, None),
    ("<h3>Etymology</h3><p>From x.</p><p>y</p><h3>Noun</h3>", None, "From x. y"),
    ("<div><h4>Etymology</h4>loose<p>a<br>b<i>c</i></p></div><p>outside</p>", None, "abc"),
    ("<h3>Etymology</h3><p>a<p>b</p><h3>Noun</h3>", None, "abNoun"),
    ("<h3>Etymology</h3><script>s</script><p>a<style>t</style> &amp; b</p><hr><p>no</p>", None, "s a & b"),
    ("<h3>Etymology 1</h3><p>x</p>", None, None),
    ("<![foo[bar]]><h3>Etymology</h3><![if x]><p>y</p><![endif]>", None, "y"),
    ('<SPAN lang="en&#45;IPA">z</SPAN>', "z", None),
])
def test_html(html, ipa, section):
    assert _read_page(html, "Etymology", ("h3", "h4")) == (ipa, section, None)


def test_html_job(spark):
    df = spark.createDataFrame([(1, "<h3>Etymology</h3><p>x</p>"), (2, None)], "page_id bigint, html string")
    assert [tuple(r) for r in extract_html(df).orderBy("page_id").collect()] == [(1, None, "x", None), (2, None, None, None)]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["<h3>", "</h3>", "<H4 x>", "Etymology", "<span class='IPA'>", "<span lang='en-&#73;PA'>", "</span>", "a",
                                          "<p>", "<![x", ">", "&amp;", "<h2>", "IPA"]), max_size=7).map("".join), min_size=20, max_size=60))
def test_pages_left_out_hold_nothing(spark, pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id bigint, html string")
    got = [tuple(r)[1:] for r in extract_html(df).orderBy("page_id").collect()]
    assert got == [_read_page(p, "Etymology", ("h3", "h4")) for p in pages]


def _words(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [(r[0], r[1], r[2]) for r in
            df.select(text.words("x"), text.strip("x"), text.collapse_blanks("x")).collect()]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab \t\n\x1c\x85​ 　é", max_size=12), min_size=20, max_size=60))
def test_blanks_match_python(spark, values):
    expected = [(v.lower().split(), v.strip(), re.sub(r"\s+", " ", v)) for v in values]
    assert _words(spark, values) == expected


ALPHABET = ["==", "===", "Latin", "Noun", "\n", "# ", "* ", ": ", "/", "[", "]", "{{", "}}", "|", "la", "IPA", "<ref",
            "/>", ">", "</ref>", "'", '"', ".", "a", "é", " ", "meaning ", "1.", "pos", "=", "\x1c", "PIE", "From x, lit."]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), min_size=30, max_size=60))
def test_patterns_match_python(spark, values):
    """Every fixed pattern finds the same in both dialects."""
    sets = [(fixed.MINE_IPA, ""), (fixed.MINE_TRANSLATION, "m"), (fixed.MINE_POS, ""), (fixed.ROOT_DEFINITIONS, "s"),
            (fixed.ROOT_PHONOLOGY, ""), (fixed.ROOT_DESCRIPTION, "s"), (tuple(p for _, p in fixed.RAW_SECTIONS), "s"),
            (tuple(p for p, f, _ in fixed.MARKUP_STEPS if f == "s"), "s"),
            (tuple(p for p, f, _ in fixed.MARKUP_STEPS if not f), "")]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    rows = df.select(*[text.find_all("x", (p,), f).alias(f"c{i}_{j}") for i, (ps, f) in enumerate(sets)
                       for j, p in enumerate(ps)]).collect()
    flags = {"": 0, "m": re.M, "s": re.S}
    for v, r in zip(values, rows):
        for i, (ps, f) in enumerate(sets):
            for j, p in enumerate(ps):
                expected = [m.group(min(m.re.groups, 1)) or "" for m in re.finditer(p, v, flags[f])]
                assert list(r[f"c{i}_{j}"]) == expected, (p, v)
