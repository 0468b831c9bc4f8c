"""Projections, filters, joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, wikitext
from ..functions.replies import reply_field
from ..operators import cleaning as cl
from ..operators import joins, quality, ranking
from ..operators.extraction import extract_terms
from ..operators.prediction import nearest_in_time
from ..operators.replies import batch_bodies, batch_entries, parse_replies
from ..plans.prediction import validate
from ..session import land, scratch_path
from .views import query, table, view, with_views

PERIOD = ("cast(case language when 'US English' then 0 when 'UK English' then -300 when 'Old English' then -1100 "
          "when 'PIE' then -5000 end as int)")
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TRIM = ("chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"
        "||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)"
        "||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)")
NO_BLANKS = "case when trim(english_translation) <> '' then english_translation end"


# ---- projections

@query("prj1_lexicon_names", """select p_name as word, p_type as english_translation,
    p_brand as phonetic_representation from part""")
def _(spark, sf):
    raw = table(spark, sf, "part").selectExpr("p_name as title", "p_name as original_characters",
                                              "p_brand as ipa_phoneme", "p_type as english_translation",
                                              "p_type as raw_content")
    return cl.to_lexicon_names(raw)


@query("prj2_constant_language", "select p_partkey as row_no, p_name as word, 'PIE' as language from part")
def _(spark, sf):
    return cl.with_language(view(spark, sf, "lexicon").select("row_no", "word"), "PIE")


@query("prj3_lexicon_columns", with_views("lexicon", f"""select word, english_translation, language,
    phonetic_representation, {PERIOD} as time_period from lexicon"""))
def _(spark, sf):
    return cl.lexicon_columns(cl.with_period(view(spark, sf, "lexicon")))


@query("prj4_canonical_columns", with_views("entries", """select original_characters, ipa_phoneme,
    english_translation, part_of_speech from entries"""))
def _(spark, sf):
    return cl.canonical_columns(view(spark, sf, "entries"))


@query("prj5_metadata", with_views("lexicon", """select row_no, word, language, english_translation as translation,
    coalesce(phonetic_representation, '') as phonetic, 'Unknown' as time_period from lexicon"""))
def _(spark, sf):
    return cl.with_metadata(view(spark, sf, "lexicon")).select("row_no", "metadata.*")


@query("prj6_root_word", with_views("roots", """select page_id,
    trim(replace(title, 'Reconstruction:Proto-Indo-European/', '')) as original_characters from roots"""))
def _(spark, sf):
    return view(spark, sf, "roots").select("page_id", wikitext.root_word("title").alias("original_characters"))


@query("prj7_percentages", """select l_orderkey, l_linenumber, round(l_discount * 100, 1) as confidence_percent,
    round((1.0::double - l_discount) * 100, 1) as similarity_percent from lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", cl.percent("l_discount").alias("confidence_percent"),
        cl.percent(F.lit(1.0) - F.col("l_discount")).alias("similarity_percent"))


def _coordinates(spark, sf):
    return view(spark, sf, "vectors").withColumns({
        f"x{i + 1}": F.get("vector", F.lit(i)).cast("double") for i in range(3)})


@query("prj8_plot_feed", with_views("vectors", """select vector[1]::double as x1, vector[2]::double as x2,
    vector[3]::double as x3, language as color, word, english_translation, language, time_period,
    phonetic_representation from vectors"""))
def _(spark, sf):
    return cl.plot_feed(_coordinates(spark, sf), ["x1", "x2", "x3"])


@query("prj8_timeline_feed", with_views("vectors", """select time_period as frame, vector[1]::double as x1,
    vector[2]::double as x2, language as color, word, english_translation from vectors order by frame"""))
def _(spark, sf):
    return cl.timeline_feed(_coordinates(spark, sf), ["x1", "x2"])


_LABELS = """select p_partkey as row_no, case p_size % 9 when 0 then 'English-US' when 1 then 'old_english'
    when 2 then 'Proto-Indo-European' when 3 then 'Modern-English' when 4 then 'Latin' when 5 then 'English-UK'
    when 6 then 'PIE' when 7 then 'us_english' else 'Klingon' end as language from {part}"""


@query("prj9_canonical_language", f"""select row_no, case when language in ('English-US', 'Modern-English', 'us_english')
    then 'US English' when language = 'English-UK' then 'UK English' when language = 'old_english' then 'Old English'
    when language in ('PIE', 'Proto-Indo-European') then 'PIE' else language end as language
    from ({_LABELS.format(part="part")})""")
def _(spark, sf):
    return cl.with_canonical_language(spark.sql(_LABELS, part=table(spark, sf, "part")))


# ---- filters

@query("flt1_blank_to_null", with_views("lexicon", f"""select row_no, source_rank, word,
    {NO_BLANKS} as english_translation, language, phonetic_representation from lexicon"""))
def _(spark, sf):
    return cl.blanks_to_null(view(spark, sf, "lexicon"))


@query("flt2_complete_rows", with_views("lexicon", """select * from lexicon
    where trim(english_translation) <> '' and phonetic_representation is not null"""))
def _(spark, sf):
    return cl.complete_rows(cl.blanks_to_null(view(spark, sf, "lexicon")))


@query("flt3_rows_with", with_views("lexicon", "select * from lexicon where phonetic_representation is not null"))
def _(spark, sf):
    return cl.rows_with(view(spark, sf, "lexicon"), "phonetic_representation")


@query("flt4_not_all_null", with_views("entries", """select ipa_phoneme, english_translation, part_of_speech
    from entries where coalesce(ipa_phoneme, english_translation, part_of_speech) is not null"""))
def _(spark, sf):
    return cl.not_all_null(view(spark, sf, "entries").select("ipa_phoneme", "english_translation", "part_of_speech"))


@query("flt5_some_of", with_views("entries", """select row_no, ipa_phoneme, english_translation from entries
    where ipa_phoneme is not null or english_translation is not null"""))
def _(spark, sf):
    return cl.some_of(view(spark, sf, "entries"), "ipa_phoneme", "english_translation") \
        .select("row_no", "ipa_phoneme", "english_translation")


@query("flt6_root_pages", with_views("roots", """select page_id, title from roots
    where title not like 'Category:%' and contains(title, 'Proto-Indo-European')"""))
def _(spark, sf):
    return cl.root_pages(view(spark, sf, "roots")).select("page_id", "title")


@query("flt7_extracted_only", with_views("terms", """select page_id, title, 'x' as raw_content from terms
    where contains(content, '==French==')"""))
def _(spark, sf):
    return extract_terms(view(spark, sf, "terms"), "French", keep=("page_id",)) \
        .select("page_id", "title", "raw_content")


@query("flt8_has_fields", with_views("entries", "select row_no, true as complete, false as partial from entries"))
def _(spark, sf):
    entries = view(spark, sf, "entries")
    complete = cl.has_fields(entries.withColumnRenamed("part_of_speech", "description"))
    return entries.select("row_no", F.lit(complete).alias("complete"), F.lit(cl.has_fields(entries)).alias("partial"))


@query("flt9_check_fields", with_views("raw", """select row_no, original_characters, cast(null as varchar) as
    ipa_phoneme, cast(null as varchar) as english_translation, cast(null as varchar) as description, true as valid
    from raw"""))
def _(spark, sf):
    checked, valid = cl.check_fields(view(spark, sf, "raw"))
    return checked.select("row_no", "original_characters", "ipa_phoneme", "english_translation", "description",
                          F.lit(valid).alias("valid"))


REQUEST_CHECK = f"""select request_id, cast(case language when 'PIE' then -5000 when 'old_english' then -1100
    when 'us_english' then 0 when 'british_english' then -300 when 'future_english_1000' then 1000
    when 'future_english_2000' then 2000 when 'toronto_english' then 0 end as int) as time_period,
    trim(lower(user_input), {TRIM}) as original_text,
    case when language = 'klingon' then 'Unsupported language selection: klingon'
         when trim(lower(user_input), {TRIM}) = '' then 'Empty input text' end as error, language
    from requests"""


@query("flt10_validate_requests", with_views("requests", REQUEST_CHECK))
def _(spark, sf):
    return validate(view(spark, sf, "requests")).select("request_id", "time_period", "original_text", "error", "language")


_VALUES = """select p_partkey as row_no, case p_size % 6 when 0 then 'null' when 1 then 'None' when 2 then '...'
    when 3 then '[]' when 4 then ' ' else p_name end as value from {part}"""


@query("flt12_rejected_values", f"""select row_no, case when value not in ('null', 'None', '...', '[]', ' ')
    then value end as accepted from ({_VALUES.format(part="part")})""")
def _(spark, sf):
    values = spark.sql(_VALUES, part=table(spark, sf, "part"))
    line = F.concat(F.lit("english_translation: "), F.col("value"))
    return values.select("row_no", reply_field(line, "english_translation").alias("accepted"))


# ---- joins

@query("jon1_period_lookup", with_views("requests", f"""select request_id, language,
    {PERIOD} as time_period from requests"""))
def _(spark, sf):
    return cl.with_period(view(spark, sf, "requests").select("request_id", "language"))


_ENTRIES = "p_partkey as position", "p_name as title", "p_type as raw_content"

REPLY_FIELDS = f"""
    seg as (select batch, cast(i - 1 as int) as place, trim(parts[i], {TRIM}) as segment
      from (select batch, string_split(reply, '---') as parts, unnest(generate_series(1, len(string_split(reply, '---'))))
            as i from replies)),
    lines as (select batch, place, n, trim(parts[n], {TRIM}) as line from (select batch, place,
      string_split(segment, chr(10)) as parts,
      unnest(generate_series(1, len(string_split(segment, chr(10))))) as n from seg)),
    vals as (select batch, place, n, lower(split_part(line, ':', 1)) as field,
      trim(trim(substr(line, length(split_part(line, ':', 1)) + 2), {TRIM}), '[]') as value from lines),
    good as (select * from vals where value not in ('', 'null', 'None', '...')),
    rec as (select seg.batch, seg.place,
      max(case when field = 'ipa_phoneme' then replace(replace(replace(trim(value, {TRIM}), '/', ''), '[', ''), ']', '')
        end) as ipa_phoneme,
      arg_max(trim(value, {TRIM}), n) filter (field = 'english_translation') as english_translation,
      arg_max(trim(value, {TRIM}), n) filter (field = 'part_of_speech') as part_of_speech
      from seg left join good using (batch, place) group by all)"""


@query("jon3_reply_zip", with_views("replies", f""", {REPLY_FIELDS} select batch, place, ipa_phoneme,
    english_translation, part_of_speech, p_name as original_characters from rec join part
    on p_partkey = batch * 20 + place"""))
def _(spark, sf):
    entries = batch_entries(table(spark, sf, "part").selectExpr(*_ENTRIES), 20)
    return parse_replies(entries, view(spark, sf, "replies"))


_TARGETS = """select row_no, word, cast(case row_no % 5 when 0 then -5000 when 1 then -4600 when 2 then -1600
    when 3 then -700 else -3000 end as int) as target_time from {lexicon}"""


def _in_time_sql(window: str) -> str:
    return with_views("lexicon", f""", ev as ({_TARGETS.format(lexicon="lexicon")}),
        dated as (select *, {PERIOD} as time_period from lexicon),
        f as (select word, time_period, phonetic_representation from dated
          qualify row_number() over (partition by word, time_period order by row_no) = 1),
        m as (select ev.row_no, f.time_period as matched_period, f.phonetic_representation as matched_ipa
          from ev join f using (word) where abs(f.time_period - target_time) <= {window}
          qualify row_number() over (partition by ev.row_no order by abs(f.time_period - target_time), f.time_period) = 1)
        select ev.row_no, word, target_time, matched_period, matched_ipa from ev left join m using (row_no)
        """)


def _in_time(spark, sf, window):
    lexicon = view(spark, sf, "lexicon")
    events = spark.sql(_TARGETS, lexicon=lexicon)
    return nearest_in_time(events, cl.with_period(lexicon), "word", "row_no", "row_no", window) \
        .select("row_no", "word", "target_time", "matched_period", "matched_ipa")


@query("jon6_nearest_in_window", _in_time_sql("500"))
def _(spark, sf):
    return _in_time(spark, sf, 500)


@query("jon7_nearest_in_time", _in_time_sql("1000000"))
def _(spark, sf):
    return _in_time(spark, sf, None)


@query("jon8_resume", "select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def _(spark, sf):
    return joins.not_done(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


# ---- aggregates

@query("agg1_column_coverage", with_views("entries", " union all ".join(
    f"""select '{c}' as column_name, count({c}) as non_null, count({c}) * 100.0::double / count(*) as percent
    from entries""" for c in ("row_no", "source_rank", "original_characters", "ipa_phoneme", "english_translation",
                              "part_of_speech"))))
def _(spark, sf):
    return quality.column_coverage(view(spark, sf, "entries"))


@query("agg2_distinct_terms", with_views("entries", """select count(distinct original_characters) as unique_terms
    from entries"""))
def _(spark, sf):
    return quality.distinct_terms(view(spark, sf, "entries"), "original_characters")


@query("agg2_sketched_terms", with_views("entries", """select count(distinct original_characters) as exact_terms, true as near,
    true as merged_is_whole, (select count(distinct floor(row_no / 1000)) from entries) as batches from entries"""))
def _(spark, sf):
    """Sketches of batches of rows, stored and merged: within 5 % of the exact count, and the sketch of all rows."""
    entries = view(spark, sf, "entries").withColumn("batch", F.floor(F.col("row_no") / 1000))
    stored = land(quality.term_sketches(entries, "original_characters", "batch"), "sketches")
    merged = quality.sketched_terms(quality.merge_sketches(stored)).select(F.col("unique_terms").alias("merged"))
    whole = quality.distinct_terms(entries, "original_characters", approximate=True).scalar()
    exact = quality.distinct_terms(entries, "original_characters").scalar()
    return merged.select(exact.alias("exact_terms"), (F.abs(F.col("merged") - exact) <= exact * 0.05).alias("near"),
                         (F.col("merged") == whole).alias("merged_is_whole"), stored.agg(F.count("*")).scalar().alias("batches"))


_RATES = """count(*) as entries, avg(case when ipa_phoneme is not null then 1.0::double else 0 end) * 100
    as ipa_phoneme_rate, avg(case when english_translation is not null then 1.0::double else 0 end) * 100
    as english_translation_rate"""


@query("agg3_batch_rates", with_views("entries", f"""select cast(floor(row_no / 100) as bigint) as batch, {_RATES}
    from entries group by 1"""))
def _(spark, sf):
    batches = ranking.with_batches(view(spark, sf, "entries"), 100, "row_no")
    return quality.success_rates(batches, ["ipa_phoneme", "english_translation"], ["batch"])


@query("agg3_overall_rates", with_views("entries", f"select {_RATES} from entries"))
def _(spark, sf):
    return quality.success_rates(view(spark, sf, "entries"), ["ipa_phoneme", "english_translation"])


_AUDIT_SQL = with_views("entries", """, s as (select count(*) as a,
    count(case when coalesce(original_characters, ipa_phoneme, english_translation, part_of_speech) is not null
      then 1 end) as b,
    count(case when original_characters is not null and coalesce(ipa_phoneme, english_translation) is not null
      then 1 end) as c,
    count(distinct case when coalesce(ipa_phoneme, english_translation) is not null then original_characters end) as d
    from entries)
    select 0::int as step, 'loaded' as stage, a as rows_out, 0::bigint as removed from s
    union all select 1, 'not_empty', b, a - b from s union all select 2, 'required', c, b - c from s
    union all select 3, 'unique', d, c - d from s""")


@query("agg4_observed_audit", _AUDIT_SQL)
def _(spark, sf):
    """The same counts, taken by the run that writes the cleaned table."""
    entries = cl.canonical_columns(view(spark, sf, "entries"))
    return quality.write_audited(entries, scratch_path(spark, "agg4"))


@query("agg4_cleaning_audit", _AUDIT_SQL)
def _(spark, sf):
    return quality.cleaning_audit(cl.canonical_columns(view(spark, sf, "entries")))


@query("agg10_batch_bodies", """select cast(floor(p_partkey / 20) as bigint) as batch, count(*)::int as entries,
    string_agg('Entry ' || (p_partkey % 20 + 1) || ':' || chr(10) || 'Title: ' || p_name || chr(10) || 'Content:'
    || chr(10) || p_type || chr(10) || chr(10) || '---' || chr(10), '' order by p_partkey) as body
    from part group by 1""")
def _(spark, sf):
    return batch_bodies(batch_entries(table(spark, sf, "part").selectExpr(*_ENTRIES), 20))


@query("agg10_root_bodies", """select cast(floor(p_partkey / 20) as bigint) as batch, count(*)::int as entries,
    string_agg('Entry ' || (p_partkey % 20 + 1) || ':' || chr(10) || 'Title: ' || p_name || chr(10) || p_type || chr(10)
    || '---' || chr(10), '' order by p_partkey) as body from part group by 1""")
def _(spark, sf):
    return batch_bodies(batch_entries(table(spark, sf, "part").selectExpr(*_ENTRIES), 20), "root")


@query("agg11_group_sizes", with_views("lexicon", f"""select language, {PERIOD} as time_period, count(*) as entries
    from lexicon group by all"""))
def _(spark, sf):
    return quality.group_sizes(cl.with_period(view(spark, sf, "lexicon")), "language", "time_period")


# ---- windows, sort, limit, sampling

@query("win3_keep_first", with_views("lexicon", """select row_no, word, language from lexicon
    qualify row_number() over (partition by word, language order by source_rank, row_no) = 1"""))
def _(spark, sf):
    return ranking.keep_first(view(spark, sf, "lexicon"), ["word", "language"], ["source_rank", "row_no"]) \
        .select("row_no", "word", "language")


@query("win4_keep_smallest", with_views("entries", """select original_characters, ipa_phoneme, english_translation,
    part_of_speech from entries qualify row_number() over (partition by original_characters order by
    ipa_phoneme nulls last, english_translation nulls last, part_of_speech nulls last) = 1"""))
def _(spark, sf):
    return ranking.keep_smallest(cl.canonical_columns(view(spark, sf, "entries")), ["original_characters"])


@query("win5_batches", """select o_orderkey, row_number() over (order by o_orderkey) - 1 as position,
    cast(floor((row_number() over (order by o_orderkey) - 1) / 100) as bigint) as batch from orders""")
def _(spark, sf):
    return ranking.with_batches(ranking.with_position(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey"), 100)


@query("srt1_nulls_last", with_views("entries", """select row_no, original_characters, ipa_phoneme from entries
    order by original_characters nulls last, ipa_phoneme nulls last, row_no"""))
def _(spark, sf):
    rows = view(spark, sf, "entries").select("row_no", "original_characters", "ipa_phoneme")
    return ranking.sort_nulls_last(rows, "original_characters", "ipa_phoneme", "row_no")


@query("srt2_smallest", """select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 100""")
def _(spark, sf):
    return ranking.smallest(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 100,
                            "o_orderkey")


@query("srt3_first_n", "select doc_id, lang, source from documents order by doc_id limit 100")
def _(spark, sf):
    return ranking.first_n(table(spark, sf, "documents").select("doc_id", "lang", "source"), 100, "doc_id")


@query("srt4_sample", """select doc_id, lang from documents order by md5(cast(doc_id as varchar) || ':42'), doc_id
    limit 150""")
def _(spark, sf):
    return ranking.sample_n(table(spark, sf, "documents").select("doc_id", "lang"), 150, "doc_id")


@query("srt4_half_sample", """select doc_id, lang from documents order by md5(cast(doc_id as varchar) || ':7'), doc_id
    limit (select count(*) // 2 from documents)""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return ranking.sample_n(docs, docs.count() // 2, "doc_id", seed=7)


# ---- set operations

@query("set1_stack", """select p_name as word, p_type as english_translation, cast(null as double) as weight,
    0::int as source_rank from part union all select s_name, null, s_acctbal, 1 from supplier""")
def _(spark, sf):
    parts = table(spark, sf, "part").selectExpr("p_name as word", "p_type as english_translation")
    return cl.stack(parts, table(spark, sf, "supplier").selectExpr("s_name as word", "s_acctbal as weight"))


@query("set2_distinct", with_views("lexicon", """select distinct trim(word) as word, trim(english_translation)
    as english_translation, language from lexicon"""))
def _(spark, sf):
    return cl.clean_basic(view(spark, sf, "lexicon").select("word", "english_translation", "language"))


_WORD_LISTS = f"""w as (select doc_id, string_split_regex(trim(lower(text), {TRIM}), '{BLANK}+') as ws
    from documents where trim(text, {TRIM}) <> '')"""


@query("set3_ordered_distinct", f"""with {_WORD_LISTS}, u as (select doc_id, unnest(ws) as word,
    unnest(generate_series(1, len(ws))) as pos from w), f as (select doc_id, word, min(pos) as pos from u group by all),
    j as (select doc_id, string_agg(word, '; ' order by pos) as words from f group by 1)
    select doc_id, words from documents left join j using (doc_id)""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.join_distinct(text.words("text")).alias("words"))


@query("set4_sorted_distinct", f"""with {_WORD_LISTS}, j as (select doc_id,
    array_to_string(list_sort(list_distinct(ws)), '; ') as words from w)
    select doc_id, words from documents left join j using (doc_id)""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.join_sorted_distinct(text.words("text")).alias("words"))
