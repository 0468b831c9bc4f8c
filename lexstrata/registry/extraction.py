"""Text extraction, replies and sources."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text, wikitext
from ..functions.replies import prompt_sections, reply_record, reply_segments
from ..operators import cleaning as cl
from ..operators import extraction as ex
from ..operators import quality
from ..operators.replies import reply_rows
from ..plans.harvest import harvest
from ..session import scratch_path
from ..sources import files, landing, tables
from ..sources.landing import Store, read_landed
from ..streaming import incremental as inc
from .relational import BLANK, REPLY_FIELDS, TRIM
from .views import query, table, view, with_views


def clean_sql(x: str) -> str:
    """The markup removal steps; patterns have no look-around, so both engines run them."""
    for pat, flags, new in (
        (r"(?s)<ref[^>]*>.*?</ref>", "g", ""),
        (r"<ref[^/]*?/>", "g", ""),
        (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "g", r"\1"),
        (r"\{\{[^}]*\}\}", "g", ""),
        ("''" * 3 + "?|" + "''" * 2 + "?", "g", ""),    # quotes are doubled in SQL
        (BLANK + "+", "g", " "),
    ):
        x = f"regexp_replace({x}, '{pat}', '{new}', '{flags}')"
    return f"trim({x}, {TRIM})"


@query("str1_clean_markup", with_views("marked", f"select doc_id, {clean_sql('text')} as plain from marked"))
def _(spark, sf):
    return view(spark, sf, "marked").select("doc_id", wikitext.clean_markup("text").alias("plain"))


# Root pages: the sections are cut with string functions, independent of the patterns.
_ROOT = """r as (select page_id, trim(replace(title, 'Reconstruction:Proto-Indo-European/', '')) as original_characters,
      content, split_part(split_part(content, '===Etymology===' || chr(10), 2), chr(10) || '===', 1) as etymology,
      split_part(split_part(content, '===Reconstruction===' || chr(10), 2), chr(10) || '===', 1) as reconstruction,
      split_part(split_part(content, '===Root===' || chr(10), 2), chr(10) || '===', 1) as root
    from roots where title not like 'Category:%'),
    d as (select *, split_part(root, chr(10) || '# ', 2) as d1, split_part(root, chr(10) || '# ', 3) as d2 from r)"""
_DEFS = (f"case when {clean_sql('d1')} = {clean_sql('d2')} then {clean_sql('d1')} else {clean_sql('d1')} || '; ' || {clean_sql('d2')} end")
_PHON = (f"split_part(split_part(content, '{{{{PIE|', 2), '|', 1) || '; ' || {clean_sql('reconstruction')}")


@query("str2_root_definitions", with_views("roots", f", {_ROOT} select page_id, {_DEFS} as english_translation from d"))
def _(spark, sf):
    pages = cl.root_pages(view(spark, sf, "roots"))
    return pages.select("page_id", wikitext.root_definitions("content").alias("english_translation"))


@query("str3_root_phonology", with_views("roots", f", {_ROOT} select page_id, {_PHON} as ipa_phoneme from d"))
def _(spark, sf):
    pages = cl.root_pages(view(spark, sf, "roots"))
    return pages.select("page_id", wikitext.root_phonology("content").alias("ipa_phoneme"))


@query("str4_root_description", with_views("roots", f""", {_ROOT} select page_id, {clean_sql('etymology')} as description
    from d"""))
def _(spark, sf):
    pages = cl.root_pages(view(spark, sf, "roots"))
    return pages.select("page_id", wikitext.root_description("content").alias("description"))


@query("str5_extract_roots", with_views("roots", f""", {_ROOT} select original_characters, {_PHON} as ipa_phoneme,
    {_DEFS} as english_translation, {clean_sql('etymology')} as description from d"""))
def _(spark, sf):
    return ex.extract_roots(view(spark, sf, "roots"))


@query("str6_raw_sections", with_views("roots", f""", {_ROOT} select original_characters, trim(root, {TRIM})
    as root_section, trim(etymology, {TRIM}) as etymology_section, trim(reconstruction, {TRIM})
    as reconstruction_section, cast(null as varchar) as notes_section from d"""))
def _(spark, sf):
    return ex.extract_raw_sections(view(spark, sf, "roots")).select(
        "original_characters", "root_section", "etymology_section", "reconstruction_section", "notes_section")


_TERMS_OE = """select page_id, title, replace(content, '==Latin==', '==Old English==') as content from {terms}"""


@query("str7_old_english_first", with_views("terms", """select page_id, title,
    split_part(split_part(split_part(content, '==Latin==' || chr(10), 2), chr(10) || '==', 1), '/', 2) as ipa_phoneme,
    cast(null as varchar) as english_translation,
    split_part(split_part(content, '==Latin==' || chr(10), 2), chr(10) || '==', 1) as raw_content from terms"""))
def _(spark, sf):
    pages = spark.sql(_TERMS_OE, terms=view(spark, sf, "terms"))
    return ex.extract_terms(pages, "Old English", keep=("page_id",)).drop("original_characters")


# In a whole section the definition follows its heading and runs to the section's end.
_FULL = """s as (select page_id, title, content, split_part(substr(content, 11), chr(10) || '==French', 1) as raw_content
    from terms)"""


@query("str7_old_english_full", with_views("terms", f""", {_FULL} select page_id, title,
    split_part(raw_content, '/', 2) as ipa_phoneme, trim(title) as english_translation, raw_content from s"""))
def _(spark, sf):
    pages = spark.sql(_TERMS_OE, terms=view(spark, sf, "terms"))
    return ex.extract_terms(pages, "Old English", "full", keep=("page_id",)).drop("original_characters")


@query("str8_latin_first", with_views("terms", """select page_id, title,
    split_part(split_part(split_part(content, '==Latin==' || chr(10), 2), chr(10) || '==', 1), '/', 2) as ipa_phoneme,
    cast(null as varchar) as english_translation, cast(null as varchar) as part_of_speech,
    split_part(split_part(content, '==Latin==' || chr(10), 2), chr(10) || '==', 1) as raw_content from terms"""))
def _(spark, sf):
    return ex.extract_terms(view(spark, sf, "terms"), "Latin", keep=("page_id",)).drop("original_characters")


@query("str8_latin_full", with_views("terms", f""", {_FULL} select page_id, title,
    split_part(raw_content, '/', 2) as ipa_phoneme, trim(title) as english_translation,
    case when contains(content, '===Noun===') then 'Noun' else 'Verb' end as part_of_speech, raw_content from s"""))
def _(spark, sf):
    return ex.extract_terms(view(spark, sf, "terms"), "Latin", "full", keep=("page_id",)).drop("original_characters")


@query("str9_reply_fields", with_views("replies", f""", {REPLY_FIELDS} select batch, place, ipa_phoneme,
    english_translation, part_of_speech, cast(batch as varchar) as original_characters from rec"""))
def _(spark, sf):
    rows = reply_rows(view(spark, sf, "replies"))
    return rows.select("batch", "place", *reply_record("segment", F.col("batch").cast("string")))


@query("str9_root_reply", with_views("replies", f""", {REPLY_FIELDS}, d as (select batch, place, arg_max(trim(value, {TRIM}), n)
    filter (field = 'part_of_speech') as description from seg left join good using (batch, place) group by all)
    select batch, place, ipa_phoneme, english_translation, d.description, cast(batch as varchar) as original_characters
    from rec join d using (batch, place)"""))
def _(spark, sf):
    replies = view(spark, sf, "replies").withColumn("reply", F.replace("reply", F.lit("part_of_speech"), F.lit("Description")))
    return reply_rows(replies).select("batch", "place", *reply_record(
        "segment", F.col("batch").cast("string"), fixed.REPLY_FIELDS_ROOT))


@query("str10_reply_segments", with_views("replies", f""", {REPLY_FIELDS} select batch, place, segment from seg"""))
def _(spark, sf):
    replies = view(spark, sf, "replies")
    return replies.select("batch", F.posexplode(reply_segments("reply")).alias("place", "segment"))


@query("str11_prompt_sections", with_views("roots", f""", {_ROOT} select original_characters,
    chr(10) || 'Root Section:' || chr(10) || trim(root, {TRIM}) || chr(10) ||
    chr(10) || 'Etymology Section:' || chr(10) || trim(etymology, {TRIM}) || chr(10) ||
    chr(10) || 'Reconstruction Section:' || chr(10) || trim(reconstruction, {TRIM}) || chr(10) as prompt from d"""))
def _(spark, sf):
    raw = ex.extract_raw_sections(view(spark, sf, "roots"))
    sections = {n: F.col(f"{n}_section") for n in ("root", "etymology", "reconstruction", "notes")}
    return raw.select("original_characters", prompt_sections(sections, "raw_content").alias("prompt"))


@query("str12_clean_ipa", with_views("entries", """select row_no,
    nullif(trim(translate(ipa_phoneme, '/[]', '')), '') as ipa_phoneme from entries"""))
def _(spark, sf):
    return view(spark, sf, "entries").select("row_no", text.clean_ipa("ipa_phoneme").alias("ipa_phoneme"))


# Mining: every look-around in the patterns is already met by the greedy match
# before it, so the same texts without it match alike.
_S = BLANK
_IPA_SQL = [r"\{\{la-IPA\|([^}]+)\}\}", r"\{\{IPA\|la\|([^}]+)\}\}", r"\{\{IPAchar\|([^}]+)\}\}", r"/([^/]+)/",
            r"\[([^\]]+)\]", r"\{\{pron\|la\|([^}]+)\}\}", r"pronunciation: ([^.]+)"]
_TRANS_SQL = [
    r"===Definitions?===\n([^=]+)", r"# ([^.]+)", r"\* ([^.]+)", r'===Etymology===\n[^"]*?"([^"]+)"',
    r"===Translation===\n([^=]+)", r'Literally "([^"]+)"', r'From [^,.]*, (?:meaning|lit\.) "([^"]+)"', r": ([^.]+)",
    r"\{\{(?:lb|label)\|la\|[^}]*\}\}" + _S + r"*([^.\n]+)", r"\{\{defn\|la\|([^}]+)\}\}",
    r"\{\{(?:m|mention)\|la\|[^}|]+\|t=([^}]+)\}\}", r"\n\d+\." + _S + r"*([^.\n]+)",
    r"""meaning (?:is |of )?["'']([^"'']+)["'']""", r"\{\{uxi\|la\|[^|]+\|([^}]+)\}\}",
    r"""From [^.]+, (?:meaning|signifying) ["'']([^"'']+)["'']""", r"\{\{(?:l|link)\|la\|[^}|]+\|([^}]+)\}\}",
]
_POS_SQL = [r"===(\w+)===[^=]", r"\|" + _S + "*PoS" + _S + r"*=" + _S + r"*([^|\n}]+)",
            r"\|" + _S + "*pos" + _S + r"*=" + _S + r"*([^|\n}]+)", r"\|" + _S + "*type" + _S + r"*=" + _S + r"*([^|\n}]+)",
            r"\{\{head\|la\|([^}|]+)", r"# \{\{(?:lb|label)\|la\|([^}|]+)", r"\{\{(?:la|latin)[- ]([^}|]+)"]
_POS_MAP = ("map {'noun':'noun','verb':'verb','adjective':'adjective','adverb':'adverb','n':'noun','v':'verb',"
            "'adj':'adjective','adv':'adverb','prop n':'proper noun','proper noun':'proper noun'}")


def _mined(patterns: list[str], tidy: str) -> str:
    found = "flatten([" + ", ".join(f"regexp_extract_all(raw_content, '{p}', 1)" for p in patterns) + "])"
    kept = f"list_filter(list_transform({found}, lambda v: {tidy}), lambda v: v <> '')"
    return f"nullif(array_to_string(list_sort(list_distinct({kept})), '; '), '')"


_MINE_IPA = _mined(_IPA_SQL, f"regexp_replace(trim(split_part(v, '|', 1), {TRIM}), '[''ː]', 'ː', 'g')")
_MINE_TRANS = _mined(_TRANS_SQL, rf"regexp_replace(regexp_replace(trim(v, {TRIM}), '\{{\{{[^}}]+\}}\}}', '', 'g'), "
                                 r"'\[\[[^\]]+\]\]', '', 'g')")
_MINE_POS = _mined(_POS_SQL, f"coalesce({_POS_MAP}[trim(lower(v), {TRIM})], '')")


@query("str13_mined_ipa", with_views("raw", f"select row_no, {_MINE_IPA} as ipa_phoneme from raw"))
def _(spark, sf):
    return view(spark, sf, "raw").select("row_no", wikitext.mined_ipa("raw_content").alias("ipa_phoneme"))


@query("str14_mined_translation", with_views("raw", f"select row_no, {_MINE_TRANS} as english_translation from raw"))
def _(spark, sf):
    return view(spark, sf, "raw").select("row_no", wikitext.mined_translation("raw_content").alias("english_translation"))


@query("str15_mined_pos", with_views("raw", f"select row_no, {_MINE_POS} as part_of_speech from raw"))
def _(spark, sf):
    return view(spark, sf, "raw").select("row_no", wikitext.mined_pos("raw_content").alias("part_of_speech"))


@query("str16_merge_found", with_views("entries", """select row_no, case when ipa_phoneme is null then
    english_translation when english_translation is null then ipa_phoneme else ipa_phoneme || '; ' ||
    english_translation end as merged from entries"""))
def _(spark, sf):
    return view(spark, sf, "entries").select(
        "row_no", wikitext.merge_found("ipa_phoneme", "english_translation").alias("merged"))


def dedupe_sql(x: str) -> str:
    cell = f"array_to_string(list_sort(list_distinct(string_split({x}, '; '))), '; ')"
    return f"case when {x} is not null and {cell} not in ('', 'None') then {cell} end"


@query("str17_dedupe_cell", with_views("entries", f"""select row_no, {dedupe_sql('english_translation')}
    as english_translation, {dedupe_sql('part_of_speech')} as part_of_speech from entries"""))
def _(spark, sf):
    return view(spark, sf, "entries").select(
        "row_no", text.dedupe_cell("english_translation").alias("english_translation"),
        text.dedupe_cell("part_of_speech").alias("part_of_speech"))


@query("str18_strip_strings", f"""select doc_id, trim(chr(8195) || chr(10) || text || '  ', {TRIM}) as text, lang
    from documents""")
def _(spark, sf):
    padded = F.concat(F.lit(" \n"), F.col("text"), F.lit("  "))
    return cl.strip_strings(table(spark, sf, "documents").select("doc_id", padded.alias("text"), "lang"))


@query("str19_request_words", with_views("requests", f""", w as (select request_id,
    string_split_regex(trim(lower(user_input), {TRIM}), '{BLANK}+') as ws from requests
    where trim(user_input, {TRIM}) <> '')
    select request_id, cast(unnest(generate_series(0, len(ws) - 1)) as int) as word_pos, unnest(ws) as word from w"""))
def _(spark, sf):
    return view(spark, sf, "requests").select(
        "request_id", F.posexplode(text.words("user_input")).alias("word_pos", "word"))


_SPOKEN_PAGES = """select page_id, replace(html, '<h1>', '<span class="x IPA"> /' || cast(page_id as varchar(20)) ||
    '&amp;/ </span><h1>') as html from {pages}"""


@query("str20_html_pronunciation", """select page_id, case when contains(html, '<h1>') then '/' || page_id || '&/' end
    as ipa from pages""")
def _(spark, sf):
    return ex.extract_html(spark.sql(_SPOKEN_PAGES, pages=table(spark, sf, "pages"))).select("page_id", "ipa")


@query("str20_odd_markup", """select page_id, case when contains(html, '<h1>') then '/' || page_id || '&/' end as ipa,
    cast(null as varchar) as error from pages""")
def _(spark, sf):
    pages = spark.sql(_SPOKEN_PAGES, pages=table(spark, sf, "pages"))
    odd = pages.withColumn("html", F.concat(F.lit("<![foo[bar]]><![endif]--><!-- x"), F.lit(" -->"), "html", F.lit("<![cut")))
    return ex.extract_html(odd).select("page_id", "ipa", "error")


@query("str21_html_section")
def _(spark, sf):
    return ex.extract_html(table(spark, sf, "pages"), heading=None, levels=("h1",)).select("page_id", "section_text")


# whole texts, escaped, between headings, siblings and nested and unclosed elements
_SECTION_PAGES = """select doc_id as page_id, '<h3>Noun</h3><p>not this</p><div><h2>Etymology</h2><h3>Etymology</h3><p>'
    || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</p><div>in <b>' || lang || '<i> &amp; </b>' || source
    || '</div><h3>Noun</h3><p>nor this</p></div>' as html from {documents}"""


@query("str21_wrapped_sections", f"""select doc_id as page_id, trim(text, {TRIM}) || ' in ' || lang || ' & ' || source
    as section_text, cast(null as varchar) as error from documents""")
def _(spark, sf):
    return ex.extract_html(spark.sql(_SECTION_PAGES, documents=table(spark, sf, "documents"))) \
        .select("page_id", "section_text", "error")


MINED_SQL = ("mined as (select row_no, original_characters, ipa_phoneme as o1, english_translation as o2, "
             f"{_MINE_IPA} as n1, {_MINE_TRANS} as n2, {_MINE_POS} as n3 from raw), "
             "found as (select row_no, concat_ws('; ', n1, o1) as ipa_phoneme, concat_ws('; ', n2, o2) "
             "as english_translation, n3 as part_of_speech, original_characters from mined)")


@query("str22_mine_raw_content", with_views("raw", f", {MINED_SQL} select * from found"))
def _(spark, sf):
    return ex.mine_raw_content(view(spark, sf, "raw"), keep=("row_no",))


# ---- sources and sinks (written under the session's shared folder, then read back)

@query("src1_csv_scan", with_views("entries", """select original_characters, ipa_phoneme,
    case when english_translation <> 'None' then english_translation end as english_translation,
    case when row_no % 3 < 2 then part_of_speech end as part_of_speech from entries"""))
def _(spark, sf):
    path = scratch_path(spark, "src1")
    entries = view(spark, sf, "entries")
    layouts = (("original_characters", "ipa_phoneme", "english_translation", "part_of_speech"),
               ("part_of_speech", "english_translation", "row_no", "ipa_phoneme", "original_characters"),
               ("english_translation", "original_characters", "ipa_phoneme"))
    for i, columns in enumerate(layouts):    # files of other column orders, one without a part of speech
        tables.save_table(entries.where(F.col("row_no") % 3 == i).select(*columns), f"{path}/{i}", fmt="csv")
    whole_lines = files.read_csv(spark, [f"{path}/{i}" for i in range(3)], files.LATIN_FULL_SCHEMA, multi_line=False)
    return whole_lines.select("original_characters", "ipa_phoneme", "english_translation", "part_of_speech")


@query("src2_pronunciation_scan", """select p_name as word, 'US English' as language,
    '/' || lower(p_type) || chr(9) || 'x/' as phonetic_representation, p_name as english_translation
    from part where p_size > 10""")
def _(spark, sf):
    path = scratch_path(spark, "src2")
    tab = F.when(F.col("p_size") > 10, F.lit("\t")).otherwise(F.lit(" no "))
    line = F.concat("p_name", F.lit(" "), tab, F.lit("/"), F.lower("p_type"),
                    F.when(F.col("p_size") > 10, F.lit("\t")).otherwise(F.lit("-")), F.lit("x/"))
    table(spark, sf, "part").select(line.alias("value")).write.text(path)
    return files.read_pronunciations(spark, path, "US English")[0]


def _landed_replies(spark, sf, name):
    """Terms as API replies, one JSON document per line, and as many that are cut off."""
    pages = view(spark, sf, "terms")
    revision = F.array(F.struct(F.struct(F.struct(F.col("content").alias("*")).alias("main")).alias("slots")))
    none = F.slice(revision, 1, 0)
    page = F.struct(F.col("page_id").alias("pageid"), "title",
                    F.when(F.col("title").startswith("s"), none).otherwise(revision).alias("revisions"))
    reply = F.struct(F.struct(F.create_map(F.col("page_id").cast("string"), page).alias("pages")).alias("query"))
    path = scratch_path(spark, name)
    cut = F.concat(F.lit('{"query": {"pages": {"'), F.col("page_id").cast("string"))
    pages.select(F.to_json(reply).alias("value")).unionByName(pages.select(cut.alias("value"))).write.text(path)
    return files.read_pages(spark, path)


@query("src4_api_pages", with_views("terms", """select page_id, title, content from terms
    where title not like 's%'"""))
def _(spark, sf):
    return _landed_replies(spark, sf, "src4")[0]


@query("src4_rejected_documents", """select '{"query": {"pages": {"' || p_partkey as document,
    'not a JSON document' as error from part""")
def _(spark, sf):
    return _landed_replies(spark, sf, "src4")[1]


def _never():
    raise RuntimeError("a landed table must not be built again")


@query("src5_read_or_build", "select page_id, url, html from pages")
def _(spark, sf):
    path = scratch_path(spark, "src5")
    tables.read_or_build(spark, path, lambda: table(spark, sf, "pages").select("page_id", "url", "html"))
    return tables.read_or_build(spark, path, _never)


@query("src6_save_table", with_views("lexicon", """select word, english_translation, language,
    phonetic_representation from lexicon"""))
def _(spark, sf):
    path = scratch_path(spark, "src6")
    lexicon = view(spark, sf, "lexicon").select("word", "english_translation", "language", "phonetic_representation")
    tables.save_table(lexicon, f"{path}/out", f"{path}/raw")
    return spark.read.parquet(f"{path}/raw")


@query("src7_land_batch", """select page_id, url, html, 'latin' as language, cast(7 as bigint) as batch_id from pages""")
def _(spark, sf):
    path = scratch_path(spark, "src7")
    for _ in range(2):    # landing the same batch again replaces it
        tables.land_batch(table(spark, sf, "pages").select("page_id", "url", "html"), path, 7, "latin")
    landed = spark.read.parquet(path)
    return landed.select("page_id", "url", "html", "language", F.col("batch_id").cast("long").alias("batch_id"))


@query("src9_compact_chunks", """select vec_id, label, len(embedding)::int as n, embedding[1]::double as x1,
    embedding[64]::double as x64 from embeddings""")
def _(spark, sf):
    path = scratch_path(spark, "src9")
    tables.save_chunks(table(spark, sf, "embeddings"), f"{path}/chunks", "vec_id", 64)
    tables.compact_chunks(spark, f"{path}/chunks", f"{path}/all")
    return spark.read.parquet(f"{path}/all").select(
        "vec_id", "label", F.size("embedding").alias("n"), F.get("embedding", F.lit(0)).cast("double").alias("x1"),
        F.get("embedding", F.lit(63)).cast("double").alias("x64"))


@query("src10_parse_vectors", """select l_orderkey, l_linenumber, l_quantity > 2 as vector_ok,
    case when l_quantity > 2 then l_quantity end as v1, case when l_quantity > 2 then l_discount end as v2
    from lineitem""")
def _(spark, sf):
    broken = F.when(F.col("l_quantity") > 2, F.lit(", ")).otherwise(F.lit(" "))
    as_text = F.concat(F.lit("["), F.col("l_quantity").cast("string"), broken, F.col("l_discount").cast("string"),
                       F.lit("]"))
    parsed = files.parse_vectors(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                                                     as_text.alias("vector")))
    return parsed.select("l_orderkey", "l_linenumber", "vector_ok", F.get("vector", F.lit(0)).alias("v1"),
                         F.get("vector", F.lit(1)).alias("v2"))


# ---- incremental

_STATUS_SQL = with_views("requests", f"""select request_id, case when trim(user_input, {TRIM}) <> '' then 'processed'
    else 'failed' end as status, case when trim(user_input, {TRIM}) = '' then 'Empty input text' end as error
    from requests""")


def _statuses(requests):
    return inc.with_status(requests, text.strip("user_input") != "", F.lit("Empty input text")) \
        .select("request_id", "status", "error")


@query("agg9_outcome_counts", f"select status, count(*) as words from ({_STATUS_SQL}) group by 1")
def _(spark, sf):
    return quality.outcome_counts(_statuses(view(spark, sf, "requests")))


@query("agg9_first_failures", """select l_orderkey * 10 + l_linenumber as row_no, 'failed' as status,
    'high discount' as error from lineitem where l_discount >= 0.09 order by 1 limit 10""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"),
                                               "l_discount")
    marked = inc.with_status(rows, F.col("l_discount") < 0.09, F.lit("high discount"))
    return quality.first_failures(marked.drop("l_discount"), "row_no")


FILE_BYTES = 32 << 20


def arriving(df, path: str, order: str, batches: int) -> int:
    """Writes the rows as files that arrive in ``batches`` batches by ``order``; gives the files of a batch.

    A batch is as many files as keep one near ``FILE_BYTES``, so what a task writes or reads
    does not follow the size of the table.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    per_batch = max(1, -(-size // (batches * FILE_BYTES)))
    df.repartitionByRange(batches * per_batch, order).write.parquet(path)
    return per_batch


@query("stm1_incremental_run", f"""select doc_id, lang, trim(text, {TRIM}) as text from documents""")
def _(spark, sf):
    path = scratch_path(spark, "stm1")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    files = arriving(docs, f"{path}/in", "doc_id", 4)
    for _ in range(2):    # the second run finds nothing new
        inc.run_increments(spark, f"{path}/in", docs.schema, cl.strip_strings, f"{path}/out", f"{path}/progress",
                           files_per_batch=files)
    return spark.read.parquet(f"{path}/out").drop("batch_id")


@query("stm1_broken_run", f"""select doc_id, lang, trim(text, {TRIM}) as text, 3::bigint as kept_points from documents""")
def _(spark, sf):
    """A run that breaks off inside its third batch and is started anew: all rows once, the last progress points on disk."""
    path = scratch_path(spark, "stm1b")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    files = arriving(docs, f"{path}/in", "doc_id", 8)

    def start(breaks_in: int | None) -> None:
        seen = iter(range(100))

        def step(batch):
            return cl.strip_strings(batch).where(F.raise_error(F.lit("broken off")).isNull() if next(seen) == breaks_in else F.lit(True))

        inc.run_increments(spark, f"{path}/in", docs.schema, step, f"{path}/out", f"{path}/progress", files_per_batch=files)

    try:
        start(2)
    except StreamingQueryException:
        start(None)
    points = Store(spark, path).names(f"{path}/progress/commits")
    return read_landed(spark, f"{path}/out", docs.schema).drop("batch_id") \
        .withColumn("kept_points", F.lit(sum(n.isdigit() for n in points)).cast("long"))


@query("stm2_emptied_batch", """select doc_id, lang, cast(case when doc_id % 2 = 0 then 1 else 4 end as bigint) as batch_id from documents
    where doc_id % 2 = 0 or doc_id % 5 = 0""")
def _(spark, sf):
    """Batches landed again replace themselves in both sinks, with fewer rows, other sinks or none."""
    path = scratch_path(spark, "stm2e")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    sinks = {"rows": f"{path}/rows", "failed": f"{path}/failed"}
    even, fifth = F.col("doc_id") % 2 == 0, F.col("doc_id") % 5 == 0
    for batch_id, rows, failed in ((1, even, fifth), (2, ~even, fifth), (4, ~even, ~even), (2, F.lit(False), fifth),
                                   (1, even, F.lit(False)), (4, ~even & fifth, F.lit(True))):
        landing.land_batch_once(docs.where(rows), sinks["rows"], batch_id, sinks, F.when(failed, "failed").otherwise("rows"))
    parts = [read_landed(spark, p, docs.schema, sinks["rows"]) for p in sinks.values()]
    return parts[0].unionByName(parts[1])


@query("stm2_incremental_landing", with_views("raw", f", {MINED_SQL} select * from found"))
def _(spark, sf):
    path = scratch_path(spark, "stm2")
    raw = view(spark, sf, "raw")
    files = arriving(raw, f"{path}/in", "row_no", 3)
    inc.run_increments(spark, f"{path}/in", raw.schema, lambda b: ex.mine_raw_content(b, keep=("row_no",)),
                       f"{path}/out", f"{path}/progress", files_per_batch=files)
    return spark.read.parquet(f"{path}/out").drop("batch_id")


def echo_reply(body: str) -> str:
    """A stand-in for the reply service: the title as the meaning."""
    titles = [line[7:] for line in body.split("\n") if line.startswith("Title: ")]
    return "---".join(f"ipa_phoneme: [/x/]\nenglish_translation: {t}\npart_of_speech: null" for t in titles)


@query("stm2_incremental_harvest", """select 'x' as ipa_phoneme, p_name as english_translation,
    cast(null as varchar) as part_of_speech, p_name as original_characters, cast(null as varchar) as error from part""")
def _(spark, sf):
    path = scratch_path(spark, "stm2h")
    terms = view(spark, sf, "terms")
    files = arriving(terms, f"{path}/in", "page_id", 3)
    for _ in range(2):    # the second run finds nothing new
        inc.run_increments(spark, f"{path}/in", terms.schema, lambda b: harvest(b, "Latin", echo_reply),
                           f"{path}/out", f"{path}/progress", files_per_batch=files)
    return spark.read.parquet(f"{path}/out").drop("batch_id", "batch", "place")


@query("stm3_failure_isolation", _STATUS_SQL)
def _(spark, sf):
    path = scratch_path(spark, "stm3")
    requests = view(spark, sf, "requests")
    requests.repartition(2).write.parquet(f"{path}/in")
    inc.run_increments(spark, f"{path}/in", requests.schema, _statuses, f"{path}/out", f"{path}/progress",
                       quarantine=f"{path}/bad")
    return spark.read.parquet(f"{path}/out").unionByName(spark.read.parquet(f"{path}/bad")).drop("batch_id")
