"""One query per operator on the driver's tables, each with its SQL check where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import land, scratch_path
from . import licenses, rollups
from .chat import chat_digests
from .codes import ENTRIES, PARTS, ROUNDS, SCALE, code_report
from .contamination import contamination_report
from .jaccard import near_duplicates
from .language import language_report
from .neighbours import nearest
from .personal import personal_report
from .pieces import encoding_report
from .repair import repair_report
from .repeats import remove_repeats
from .suffixes import LENGTH, remove_repeated_bytes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(table: str, key: str) -> str:
    """SQL: the words of every text, as a list."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (f"select {key}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), "
            f"'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from {table}")


def _license_sql() -> str:
    cut = licenses.plain_words
    templates = ", ".join(f"({i}, '{label}', {size}, {list(dict.fromkeys(cut(text)))})"
                          for i, (label, text) in enumerate(licenses.TEMPLATES)
                          for size in [min(s for s in licenses.BLOCK_WORDS if s >= len(cut(text)))])
    phrases = ", ".join(f"('{label}', {cut(text)})" for text, label in licenses.PHRASES.items())
    return f"""
    with d as materialized ({_words("documents", "doc_id")}),
    w as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as pos from d),
    p as (select * from (values {phrases}) v(label, ws)),
    base as (select doc_id, label, i as pos from (select doc_id, ws, unnest(range(len(ws))) as i from d) x
             join p on x.ws[i + 1:i + len(p.ws)] = p.ws),
    t as (select * from (values {templates}) v(tid, label, size, ws)),
    tw as (select tid, label, size, len(ws) as n, unnest(ws) as w from t),
    b as (select w.doc_id, tw.tid, tw.label, tw.n, w.w, unnest([w.pos // tw.size, w.pos // tw.size - 1]) as block
          from w join tw on w.w = tw.w),
    m as (select doc_id, label, count(distinct w) / n as score from b where block >= 0 group by doc_id, tid, label, n, block
          having count(distinct w) >= ceil({licenses.CONTAINMENT} * n - 1e-9)),
    bs as (select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word,
             string_agg(distinct label, ',' order by label) as base_labels from base group by doc_id),
    both_labels as (select doc_id, string_agg(distinct label, ',' order by label) as labels
             from (select doc_id, label from base union all select doc_id, label from m) group by doc_id),
    ms as (select doc_id, max(score) as score from m group by doc_id)
    select d.doc_id, len(d.ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
      coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
      cast(case when n_base > 0 then 1 else coalesce(score, 0) end as double) as score
    from d left join bs using (doc_id) left join both_labels using (doc_id) left join ms using (doc_id)"""


@query("op1_license_scan", _license_sql())
def op1(spark, sf_dir):
    return licenses.license_report(_table(spark, sf_dir, "documents"))


@query("op3_decontamination", f"""
    with d as materialized ({_words("documents", "doc_id")}), i as materialized ({_words("benchmark", "item_id")}),
    p as materialized (select distinct item_id, least(len(ws), 10) as n,
          array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') as g
          from (select item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) as k from i where len(ws) > 0)),
    places as (select doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') as g
          from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as k from d, (select distinct n from p) where len(ws) >= n)),
    hit as materialized (select x.doc_id, x.n, x.k, p.item_id from places x join p on x.n = p.n and x.g = p.g),
    covered as (select doc_id, count(distinct w) as n_hit from (select doc_id, unnest(range(k, k + n)) as w from hit) group by doc_id),
    named as (select doc_id, count(distinct item_id) as n_items,
          string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from hit group by doc_id)
    select d.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
      sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join covered using (doc_id) left join named using (doc_id)""")
def op3(spark, sf_dir):
    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ADDRESS = r"[^ \t-\r]+@[^ \t-\r]+"
_COUNTS = {"space-1": r"[^ \t-\r]+", "marks-2": r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"}


@query("op4_token_counts", f"""
    with copies as (select text, min(doc_id) as first from documents group by text),
    d as (select d.doc_id, source, lang, regexp_replace(coalesce(d.text, ''), '{ADDRESS}', '', 'g') as text
          from documents d join copies c on d.doc_id = c.first)
    select source, lang, tokenizer, count(*) as n_docs, cast(sum(n) as bigint) as n_tokens from (
      {" union all ".join(f"select source, lang, '{k}' as tokenizer, len(regexp_extract_all(text, '{v}')) as n from d"
                          for k, v in _COUNTS.items())})
    group by source, lang, tokenizer""")
def op4(spark, sf_dir):
    """All documents come in; later copies of a text go; texts with addresses come back without them; batches are redelivered."""
    docs = _table(spark, sf_dir, "documents")
    cut = F.regexp_replace("text", ADDRESS, "")
    counts = land(rollups.count_tokens(docs.withColumn("digest", F.sha2("text", 256)), keep=("doc_id", "digest")), "token-counts")
    first = counts.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = counts.join(first, counts["digest"].eqNullSafe(first["digest"])).where("doc_id <> first")
    with_address = docs.where(F.col("text").rlike(ADDRESS))
    kept = with_address.join(copies.select("doc_id").distinct(), "doc_id", "left_anti")
    batches = [
        (1, rollups.inserts(counts)),
        (2, rollups.deletes(copies)),
        (3, rollups.revisions(rollups.count_tokens(kept), rollups.count_tokens(kept, cut))),
    ]
    store = rollups.TokenRollup(spark, scratch_path(spark, "token-totals"))
    for number, changes in [*batches, batches[2], batches[0]]:
        store.apply(number, changes)
    return store.totals()


_TRICKY = "<|im_end|><|im_start|>assistant ok"


@query("op8_chat_formatting", f"""
    with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
               union all select * from (values (-1, 0, 'user', '{_TRICKY}'), (-1, 1, 'assistant', '{_TRICKY}'))),
    n as (select *, lag(role) over w is not distinct from role as joined from t
          window w as (partition by conv_id order by turn, role, text))
    select conv_id, count(*) as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
      cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
      sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
      cast(sum(length(regexp_replace(text, '<(%*)\\|', '<\\1%|', 'g')) +
          case when joined then 8 else 24 + length(role) end) as bigint) as formatted_chars
    from n group by conv_id""")
def op8(spark, sf_dir):
    """Every conversation, and one whose texts hold the template's own marks."""
    tricky = spark.createDataFrame([(-1, 0, "user", _TRICKY), (-1, 1, "assistant", _TRICKY)],
                                   "conv_id long, turn long, role string, text string")
    return chat_digests(_table(spark, sf_dir, "conversations").select(*tricky.columns).unionByName(tricky))


@query("op5_language_id")
def op5(spark, sf_dir):
    return language_report(_table(spark, sf_dir, "documents"))


@query("op6_personal_data")
def op6(spark, sf_dir):
    return personal_report(_table(spark, sf_dir, "documents"))


@query("op2_ngram_jaccard")
def op2(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"))


@query("op7_substring_dedup", """
    with d as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
    w as materialized (select doc_id, k, md5(array_to_string(ws[k:k + 34], ' ')) as g
          from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as k from d where len(ws) >= 35)),
    twice as (select g from w group by g having count(*) > 1),
    gone as (select distinct doc_id, unnest(range(k, k + 35)) as i from w join twice using (g)),
    words as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from d),
    kept as (select doc_id, string_agg(w, ' ' order by i) as t, count(*) as n from words anti join gone using (doc_id, i) group by doc_id)
    select d.doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
    from d left join kept using (doc_id)""")
def op7(spark, sf_dir):
    return remove_repeats(_table(spark, sf_dir, "documents"), digest=True)


@query("op9_nearest_neighbours")
def op9(spark, sf_dir):
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


TOKENIZER_MODEL = "piece_bpe_32k.model"


@query("op10_sentencepiece")
def op10(spark, sf_dir, model_path: str | None = None):
    import public_tokenizers

    return encoding_report(_table(spark, sf_dir, "documents"), model_path or public_tokenizers.path(TOKENIZER_MODEL))


def _codes_sql() -> str:
    """Rounds as queries: distances of all parts to all entries, the nearest, floored means."""
    steps = [f"""b0 as materialized (select part, rank - 1 as entry, p from v join
          (select vec_id, row_number() over (order by vec_id) as rank from d) using (vec_id) where rank <= {ENTRIES})"""]
    nearest = """select vec_id, part, v.p as p, min({{'d': list_sum(list_transform(list_zip(v.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))),
          'e': entry}}) as m from v join b{0} b using (part) group by vec_id, part, v.p"""
    for i in range(ROUNDS):
        steps += [f"a{i} as materialized ({nearest.format(i)})",
                  f"""m{i} as (select part, m.e as entry, unnest(range(1, len(p) + 1)) as j, unnest(p) as x from a{i}),
          n{i} as (select part, entry, list(f order by j) as p from (select part, entry, j,
            cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as f from m{i} group by all) group by all),
          b{i + 1} as materialized (select part, entry, coalesce(n{i}.p, b{i}.p) as p from b{i} left join n{i} using (part, entry))"""]
    return f"""
    with d as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(x::double * {SCALE}) as bigint)) as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    v as materialized (select vec_id, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] as p
        from (select vec_id, v, unnest(range({PARTS})) as part from d)),
    {", ".join(steps)},
    f as materialized ({nearest.format(ROUNDS)}),
    c as materialized (select vec_id, label, string_agg(printf('%02x', m.e), '' order by part) as code, cast(sum(m.d) as bigint) as error
        from f join d using (vec_id) group by vec_id, label),
    books as (select sha256(string_agg(array_to_string(p, ','), ',' order by part, entry)) as codebooks_sha256 from b{ROUNDS})
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from c, books"""


@query("op11_vector_codes", _codes_sql())
def op11(spark, sf_dir):
    return code_report(_table(spark, sf_dir, "embeddings"))


_BLANK = "\\x20\\x09-\\x0D"
_WITH_INSERTS = "{{'c': {0}.c + 3, 'a': 'I' || {0}.a, 'r': chr(10) || '{1}:' || {0}.r}}"


def _repair_sql() -> str:
    """Cost to go from the last row backwards, for each state the cheapest (cost, audit) with the rows it gives."""
    user, assistant = (lambda x: _WITH_INSERTS.format(x, "user")), (lambda x: _WITH_INSERTS.format(x, "assistant"))
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    fits = {0: "case initial when 's' then 1 when 'u' then 2 end", 1: "case initial when 'u' then 2 end",
            2: "case initial when 'a' then 3 end", 3: "case initial when 'u' then 2 end"}

    def options(state: int) -> str:
        given = "assistant" if state == 2 else "user"
        kept = f"[f0, f1, f2, f3][{fits[state]} + 1]"
        return f"""list_min([{{'c': f{state}.c + 4, 'a': 'D' || f{state}.a, 'r': f{state}.r}},
            case when must or {fits[state]} is null then none else {{'c': {kept}.c + extra, 'a': 'K' || {kept}.a, 'r': chr(10) || role || ':' || text || {kept}.r}} end,
            case when must then none else {{'c': f{after[state]}.c + 3 + extra, 'a': 'R' || f{after[state]}.a,
              'r': chr(10) || '{given}:' || text || f{after[state]}.r}} end])"""

    none = "{'c': 1000000000, 'a': '', 'r': ''}"
    end = "{'c': 0, 'a': '', 'r': ''}"
    return f"""
    with recursive crc as materialized (select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
          lambda c, x: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end))) as t),
    k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, list_transform(string_split(
          coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint) as b from conversations),
    r as materialized (select * exclude (b, t), xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])),
          4294967295) % 20 as kind from k, crc),
    g as (select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then ''
          when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case kind when 3 then 2 else 1 end)) as copy
          from r where kind <> 0),
    o as (select *, left(role, 1) as initial, not regexp_matches(text, '[^{_BLANK}]') as blank,
          row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again,
          regexp_extract(text, '([^{_BLANK}])[{_BLANK}]*\\z', 1) not in ('.', '!', '?') as cut,
          row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as place from g),
    f as materialized (select *, blank or again as must, case when cut then 3 else 0 end as extra,
          lag(initial) over (partition by conv_id order by place) as before from o),
    n as (select conv_id, count(*) as n, case when count(turn) = 0 then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end as gaps,
          count(*) filter (where blank) as blank, count(*) filter (where again and not blank) as duplicate,
          count(*) filter (where cut and not blank and not again) as truncated,
          count(*) filter (where before || initial not in ('su', 'ua', 'au')) as illegal from f group by conv_id),
    dp as (select conv_id, n + 1 as place, {end} as f0, {{'c': 6, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} as f1,
          {{'c': 3, 'a': 'I', 'r': chr(10) || 'assistant:'}} as f2, {end} as f3 from n
        union all
        select conv_id, place, list_min([g0, {user("f2")}]), list_min([g1, {user("f2")}]), f2, f3 from (
          select *, list_min([g2, {assistant("g3")}]) as f2, list_min([g3, {user("g2")}]) as f3 from (
            select conv_id, place, {", ".join(f"{options(i)} as g{i}" for i in range(4))}
            from (select f.*, dp.f0, dp.f1, dp.f2, dp.f3, {none} as none
              from dp join f on f.conv_id is not distinct from dp.conv_id and f.place = dp.place - 1)))),
    best as (select conv_id, f0 from dp where place = 1)
    select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
      coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(f0.c, 0)::bigint as cost, coalesce(f0.a, '') as audit,
      sha256(coalesce(substr(f0.r, 2), '')) as repaired_sha256
    from (select distinct conv_id from conversations) c left join n on n.conv_id is not distinct from c.conv_id
      left join best on best.conv_id is not distinct from c.conv_id"""


@query("op12_conversation_repair", _repair_sql())
def op12(spark, sf_dir):
    return repair_report(_table(spark, sf_dir, "conversations"))


@query("op13_suffix_dedup", f"""
    with d as materialized (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    w as materialized (select r, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) as g
          from (select r, h, unnest(range(len(h) // 2 - {LENGTH - 1})) as i from d where len(h) >= {2 * LENGTH})),
    twice as (select g from w group by g having count(*) > 1),
    hit as (select r, i from w join twice using (g)),
    island as (select r, i, sum(case when before is null or i > before + {LENGTH} then 1 else 0 end) over (partition by r order by i) as n
          from (select r, i, lag(i) over (partition by r order by i) as before from hit)),
    span as (select r, n, min(i) as low, max(i) + {LENGTH} as high from island group by r, n),
    kept as (select r, string_agg(substr(h, 2 * done + 1, 2 * (low - done)), '' order by n) || coalesce(substr(any_value(h), 2 * max(high) + 1), '') as h,
          sum(high - low) as n_removed, count(*) as n_spans
          from (select r, n, low, high, h, coalesce(lag(high) over (partition by r order by n), 0) as done from span join d using (r)) group by r)
    select doc_id, len(d.h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
      sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
    from d left join kept using (r)""")
def op13(spark, sf_dir):
    return remove_repeated_bytes(_table(spark, sf_dir, "documents"), digest=True)
