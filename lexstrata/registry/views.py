"""The driver's tables seen as lexicon, page, request and token tables.

One SQL text per view serves both engines, so it uses ``chr(10)`` for line breaks
and gives ``varchar`` a length. Braces are doubled because the text is formatted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

VIEWS = {
    # dirty multi-language lexicon: blanks, missing values, repeated words
    "lexicon": """
        select p_partkey as row_no, cast(p_partkey % 4 as int) as source_rank, p_name as word,
          case when p_partkey % 11 = 0 then '  ' else p_type end as english_translation,
          case p_partkey % 4 when 0 then 'PIE' when 1 then 'Old English'
               when 2 then 'US English' else 'UK English' end as language,
          case when p_partkey % 13 = 0 then null else '/' || lower(p_brand) || '/' end as phonetic_representation
        from {part}""",
    # the same rows under the harvest's names, with brackets and multi-value cells
    "entries": """
        select p_partkey as row_no, cast(p_partkey % 3 as int) as source_rank,
          case when p_partkey % 17 = 0 then null else p_name end as original_characters,
          case when p_partkey % 5 = 0 then null else '[' || lower(p_brand) || ']; /' || lower(p_type) || '/' end
            as ipa_phoneme,
          case when p_partkey % 7 < 2 then null when p_partkey % 7 = 2 then 'None'
               else lower(p_type) || '; ' || p_name || '; ' || lower(p_type) end as english_translation,
          case when p_partkey % 6 = 0 then null when p_size % 2 = 0 then 'noun' else 'verb; noun' end
            as part_of_speech
        from {part}""",
    # vector lexicon: four anchor periods plus others
    "vectors": """
        select vec_id as row_id, 'w' || cast(vec_id as varchar(20)) as word,
          cast(case label when 0 then -5000 when 1 then -1100 when 2 then -300 when 3 then 0
               else -100 * label end as int) as time_period,
          case label when 0 then 'PIE' when 1 then 'Old English' when 2 then 'UK English' else 'US English' end
            as language,
          'meaning ' || cast(label as varchar(20)) as english_translation,
          '/' || substr('iɪeɛæʌɔuəɑʊoatdɾðθŋʃʒpbfvmnlrwjhʔkʰ', cast(vec_id % 32 as int) + 1, 3) || '/'
            as phonetic_representation,
          embedding as vector
        from {embeddings}""",
    # term pages; one in three ends in a line break
    "terms": """
        select p_partkey as page_id, p_name as title,
          '==Latin==' || chr(10) || '* IPA(key): /' || lower(p_type) || '/' || chr(10) ||
          case when p_size % 2 = 0 then '===Noun===' else '===Verb===' end || chr(10) || '# ' || p_name ||
          case when p_partkey % 3 = 0 then chr(10) else chr(10) || '==French==' || chr(10) || 'x' end as content
        from {part}""",
    # root pages, some of them not roots
    "roots": """
        select p_partkey as page_id,
          case p_size % 3 when 0 then 'Category:Proto-Indo-European ' || p_name
               when 1 then 'Reconstruction:Proto-Indo-European/' || p_name || '  '
               else 'Reconstruction:Proto-Indo-European/*' || p_brand end as title,
          '===Etymology===' || chr(10) || 'From {{{{PIE|' || p_brand || '|x}}}} by [[' || p_name || '|' || p_type || ']].'
          || chr(10) || '===Reconstruction===' || chr(10) || '*' || lower(p_brand) || chr(10) ||
          '===Root===' || chr(10) || 'root line' || chr(10) || '# to ' || p_name || ' <ref name=a>q</ref>'
          || chr(10) || '# ' || lower(p_type) || chr(10) || chr(10) || '===Derived===' || chr(10) || p_name as content
        from {part}""",
    # marked-up documents, whole texts
    "marked": """
        select doc_id, '''' || '''' || '''' || lang || '''' || '''' || '''' || ' [[' || source || '|go]] {{{{l|en|x}}}} '
          || text || ' <ref name=a>' || lang || chr(10) || '</ref>fast<ref name=b/>' || chr(10) || ' [[now]]' as text
        from {documents}""",
    # raw content to mine, whole texts
    "raw": """
        select doc_id as row_no, 'd' || cast(doc_id as varchar(20)) as original_characters,
          case when doc_id % 5 = 0 then lang else null end as ipa_phoneme,
          case when doc_id % 4 = 0 then source else null end as english_translation,
          cast(null as varchar(20)) as part_of_speech,
          '===Noun===' || chr(10) || '{{{{la-noun|' || lang || '|m}}}}' || chr(10) || '{{{{la-IPA|' || lang
          || '''' || 'a|ann=1}}}}' || chr(10) || '# ' || text || chr(10) || '1. ' || source || chr(10)
          || '{{{{head|la|adj}}}} | pos = Prop N ' || chr(10) || 'meaning "' || lang || '"' || chr(10)
          || '* IPA(key): /' || lang || '.' || source || '/ pronunciation: ' || source || '.' as raw_content
        from {documents}""",
    # requests: the text of every turn, and one blank one for every ten
    "requests": """
        select conv_id * 1000 + turn as request_id,
          case conv_id % 8 when 0 then 'PIE' when 1 then 'old_english' when 2 then 'us_english'
            when 3 then 'british_english' when 4 then 'future_english_1000'
            when 5 then 'future_english_2000' when 6 then 'toronto_english' else 'klingon' end as language,
          text as user_input
        from {conversations}
        union all select -(conv_id * 1000 + turn) - 1, 'PIE', '   ' from {conversations} where turn % 10 = 0""",
    # token vectors: ten items, one of them wholly masked
    "tokens": """
        select cast(label as bigint) as item_id, vec_id as pos,
          case when label = 9 or embedding[{first}] <= 0 then 0 else 1 end as mask, embedding as vec
        from {embeddings}""",
    # replies: one body per batch of 20, with a segment only for larger parts
    "replies": """
        select cast(floor(p_partkey / 20) as bigint) as batch,
          {join_open}case when p_size > 5 then 'IPA_Phoneme: [/' || lower(p_brand) || '/]' || chr(10) || 'english_translation: null' || chr(10)
          || ' english_translation: ' || case p_size % 4 when 0 then '...' when 1 then 'None' else p_name || ': x' end
          || chr(10) || 'part_of_speech:' || case when p_size % 3 = 0 then '' else ' [noun]' end end{join_close} as reply
        from {part} group by 1""",
}

_SPARK = {"first": "0", "join_open": "listagg(", "join_close": ", '---') within group (order by p_partkey)"}
_DUCK = {"first": "1", "join_open": "string_agg(", "join_close": ", '---' order by p_partkey)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    for name, spelling in _SPARK.items():
        text = text.replace("{" + name + "}", spelling)
    return spark.sql(text, **used)


def cte(*names: str) -> str:
    """The views as named queries for the SQL side."""
    fill = {**_DUCK, **{t: t for t in TABLES}}
    return ", ".join(f"{n} as ({VIEWS[n].format(**fill)})" for n in names)


class Query:
    def __init__(self, run: Callable[[SparkSession, str], DataFrame], sql: str | None):
        self.run, self.sql = run, sql


QUERIES: dict[str, Query] = {}


def query(key: str, sql: str | None = None):
    """Register a query under the lower-case inventory id and a short name."""
    def add(fn):
        QUERIES[key] = Query(fn, sql)
        return fn

    return add


def with_views(names: str, body: str) -> str:
    return f"with {cte(*names.split())} {body}"
