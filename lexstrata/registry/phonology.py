"""Vectors, neighbours, phonetics and the composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import phonetics as ph
from ..functions.vectors import cosine_similarity
from ..operators import cleaning as cl
from ..operators import approximate, enrichment, joins, neighbours, pooling, prediction, ranking
from ..operators.replies import batch_bodies, batch_entries
from ..plans import consolidation, harvest, projection
from ..plans import prediction as plan
from ..session import scratch_path
from ..sources import files
from .extraction import MINED_SQL, dedupe_sql, echo_reply
from .relational import BLANK, PERIOD, REQUEST_CHECK, TRIM
from .views import query, table, view, with_views

# ---------------------------------------------------------------- SQL pieces

VEC = "e as (select *, vector::double[64] as v from vectors)"


def near_sql(queries: str, top_n: int = 10, anchors: bool = True) -> str:
    """``near`` from a named query set (query_id, qv)."""
    anchor = "row_number() over (partition by query_id, time_period order by distance, row_id) = 1 " \
             "and time_period in (-5000, -1100, -300, 0)" if anchors else "false"
    return f"""dist as (select query_id, row_id, time_period, word, phonetic_representation,
          round(1 - array_cosine_similarity(qv, v), 9) + 0.0 as distance from {queries}, e),
        anch as (select *, {anchor} as anchor from dist),
        rnk as (select *, cast(row_number() over (partition by query_id order by anchor desc, case when anchor then
          case time_period when -5000 then 1 when -1100 then 2 when -300 then 3 else 4 end end, distance, row_id)
          as int) as rank from anch),
        near as (select * from rnk where rank <= {top_n} or anchor)"""


SELF = "q as (select row_id as query_id, v as qv from e)"


def _feature_list(values) -> str:
    return "[" + ", ".join(f"{float(v)}::double" for v in values) + "]"


PHONES = "phones(ord, phone, feat) as (values " + ", ".join(
    f"({i}, '{p}', {_feature_list(f)})" for i, (p, f) in enumerate(fixed.PHONES)) + ")"
ZERO = _feature_list([0] * 14)

# Features after a gap: f is the vector, a the drift rate, d the gap.
_DRIFTED = """[f[1], f[2],
    f[3] + case when f[1] <> 1 and d > 0 and f[2] = 1 then 0.2 * a else 0 end,
    f[4] + case when f[1] <> 1 and d > 0 and f[2] = 1 then 0.3 * a when f[1] <> 1 and d <= 0 and f[4] = 1
      then -0.2 * a else 0 end,
    f[5], f[6], f[7], f[8], f[9],
    f[10] + case when f[1] = 1 and d > 0 then case when f[10] = 1 and f[14] = 1 then -0.3 * a
      when f[10] = 0 and f[12] = 0 then 0.2 * a when f[12] = 1 then 0.2 * a else 0 end else 0 end,
    f[11] + case when f[1] = 1 and d <= 0 and f[11] = 0 then 0.1 * a else 0 end,
    f[12] + case when f[1] = 1 and d > 0 and not (f[10] = 1 and f[14] = 1) and not (f[10] = 0 and f[12] = 0)
      and f[12] = 1 then -0.3 * a else 0 end,
    f[13],
    f[14] + case when f[1] = 1 and d > 0 and f[10] = 1 and f[14] = 1 then -0.2 * a
      when f[1] = 1 and d <= 0 and f[14] <> 0 then -0.1 * a else 0 end]"""


def drift_sql(name: str, pairs: str) -> str:
    """``name``(phone, d, g): drifted features of the distinct (phone, d) in ``pairs``."""
    return f"""{name}_f as (select k.phone, k.d, pow(least(1.0::double, abs(k.d) / 2000.0::double), 0.3::double) as a,
          coalesce(phones.feat, {ZERO}) as f from (select distinct phone, d from {pairs}) k left join phones using (phone)),
        {name} as (select phone, d, {_DRIFTED} as g from {name}_f)"""


def nearest_sql(name: str, drifted: str) -> str:
    """``name``(phone, d, out): the nearest phone of drifted features, first listed on ties."""
    return f"""{name} as (select t.phone, t.d, p.phone as out from {drifted} t, phones p
        qualify row_number() over (partition by t.phone, t.d order by list_distance(t.g, p.feat), p.ord) = 1)"""


def shift_sql(name: str, source: str) -> str:
    """``name``(d, ipa, shifted) for the (ipa, d) pairs of ``source``."""
    return f"""{name}_s as (select distinct ipa, d, regexp_extract_all(translate(ipa, '/[]', ''), '(?s).') as ps
          from {source} where ipa is not null and d is not null),
        {name}_p as (select ipa, d, unnest(ps) as phone, unnest(generate_series(1, len(ps))) as pos from {name}_s),
        {drift_sql(name + '_g', name + '_p')}, {nearest_sql(name + '_o', name + '_g')},
        {name}_j as (select ipa, d, string_agg(out, '' order by pos) as body from {name}_p
          join {name}_o using (phone, d) group by all),
        {name} as (select s.ipa, s.d, '/' || coalesce(j.body, '') || '/' as shifted from {name}_s s
          left join {name}_j j on s.ipa = j.ipa and s.d = j.d)"""


def _queries(vectors):
    return vectors.select(F.col("row_id").alias("query_id"), "vector")


def _nearest(spark, sf, top_n=10, **kw):
    vectors = view(spark, sf, "vectors")
    return neighbours.nearest_with_coverage(_queries(vectors), vectors, top_n, **kw)


def _forms(spark, sf):
    return prediction.collect_forms(_nearest(spark, sf, keep=("phonetic_representation",)).drop("similarity"))


# ---------------------------------------------------------------- vectors

@query("vec1_cosine", with_views("vectors", f""", {VEC}, a as (select * from e qualify row_number() over
    (partition by time_period order by row_id) = 1) select e.row_id, round(array_cosine_similarity(e.v, a.v), 6)
    as similarity, round(1 - array_cosine_similarity(e.v, a.v), 6) as distance from e join a using (time_period)"""))
def _(spark, sf):
    rows = view(spark, sf, "vectors").select("row_id", "time_period", "vector")
    firsts = ranking.keep_first(rows, ["time_period"], ["row_id"]).select("time_period", F.col("vector").alias("first"))
    paired = joins.lookup(rows, firsts, "time_period", "row_id", "inner")
    similarity = cosine_similarity("vector", "first")
    return paired.select("row_id", F.round(similarity, 6).alias("similarity"),
                         F.round(F.lit(1.0) - similarity, 6).alias("distance"))


@query("jon2_query_distances", with_views("vectors", f""", {VEC}, q as (select v as qv from e order by row_id limit 1)
    select row_id, round(1 - array_cosine_similarity(v, qv), 6) as distance from e, q"""))
def _(spark, sf):
    rows = view(spark, sf, "vectors").select("row_id", "vector")
    one = rows.agg(F.min_by("vector", "row_id").alias("v")).scalar()
    return neighbours.query_distances(rows.withColumn("q", one), "q") \
        .select("row_id", F.round("distance", 6).alias("distance"))


@query("win1_nearest_coverage", with_views("vectors", f""", {VEC}, {SELF}, {near_sql('q')}
    select query_id, rank, row_id, time_period, word, round(distance, 6) as distance,
    round(1 - distance, 6) as similarity from near"""))
def _(spark, sf):
    return _nearest(spark, sf, keep=("word",)).select(
        "query_id", "rank", "row_id", "time_period", "word", F.round("distance", 6).alias("distance"),
        F.round("similarity", 6).alias("similarity"))


@query("win1_odd_queries", with_views("vectors", f""", {VEC}, {SELF}, {near_sql('q', 5)}
    select query_id, rank, row_id, round(distance, 6) as distance from near"""))
def _(spark, sf):
    """Queries that have no answer, placed before all others, change nothing for them."""
    vectors = view(spark, sf, "vectors")
    odd = spark.createDataFrame([(-1, [1.0]), (-2, []), (-3, None), (-4, [0.0] * 64), (-5, [1.0] * 65)],
                                "query_id long, vector array<float>")
    queries = odd.unionByName(_queries(vectors).select(F.col("query_id").cast("long").alias("query_id"), "vector"))
    near = neighbours.nearest_with_coverage(queries.coalesce(1), vectors, 5)
    return near.select("query_id", "rank", "row_id", F.round("distance", 6).alias("distance"))


@query("win1_coverage_beats_n", with_views("vectors", f""", {VEC}, {SELF}, {near_sql('q', 2)}
    select query_id, rank, row_id, time_period, round(distance, 6) as distance from near"""))
def _(spark, sf):
    return _nearest(spark, sf, 2).select("query_id", "rank", "row_id", "time_period",
                                         F.round("distance", 6).alias("distance"))


@query("win1_pivot_groups", with_views("vectors", f""", {VEC}, {SELF}, {near_sql('q')}
    select query_id, rank, row_id, time_period, round(distance, 6) as distance from near"""))
def _(spark, sf):
    """Neither side within the budget: rows and queries meet by pivot groups, and nothing is lost."""
    return _nearest(spark, sf, budget=0).select("query_id", "rank", "row_id", "time_period", F.round("distance", 6).alias("distance"))


def _approximate(spark, sf):
    vectors = view(spark, sf, "vectors").select("row_id", "vector")
    return vectors, approximate.approximate_neighbours(_queries(vectors), vectors)


@query("vec10_lsh", with_views("vectors", """select row_id as query_id, least(10, (select count(*) from vectors)) as found,
    least(10, (select count(*) from vectors)) as with_right_distance from vectors"""))
def _(spark, sf):
    """Approximate neighbours of every vector: how many were found, and how many of them at their exact distance."""
    vectors, near = _approximate(spark, sf)
    own, other = (vectors.select(F.col("row_id").alias(k), F.col("vector").alias(v)) for k, v in (("query_id", "qv"), ("row_id", "v")))
    right = F.abs(F.lit(1.0) - cosine_similarity("qv", "v") - F.col("distance")) < 1e-8
    return near.join(own, "query_id").join(other, "row_id").groupBy("query_id") \
        .agg(F.count("*").alias("found"), F.count_if(right).alias("with_right_distance"))


@query("vec10_recall", with_views("vectors", f""", {VEC}, {SELF}, {near_sql('q', 10, False)}
    select count(*) as pairs, true as found_nine_of_ten from near"""))
def _(spark, sf):
    """Of the pairs of the exact search, at least 0.9 are found."""
    _, near = _approximate(spark, sf)
    return approximate.recall(near, _nearest(spark, sf, periods=())).select("pairs", (F.col("recall") >= 0.9).alias("found_nine_of_ten"))


@query("vec10_coverage", with_views("vectors", f""", {VEC}, {SELF}, {near_sql('q')},
    first as (select query_id, time_period from near where anchor) select query_id, count(*) as periods_covered, true as nine_of_ten from first
    group by query_id"""))
def _(spark, sf):
    """Approximate neighbours with each anchor period covered, and whether nine of ten rows of the exact answer are among all found."""
    vectors = view(spark, sf, "vectors")
    near = approximate.approximate_with_coverage(_queries(vectors), vectors)
    share = approximate.recall(near, _nearest(spark, sf)).select("recall").scalar()
    return near.groupBy("query_id").agg(F.count_distinct(F.when(F.col("time_period").isin(*fixed.ANCHOR_PERIODS), F.col("time_period")))
                                        .alias("periods_covered")).withColumn("nine_of_ten", share >= 0.9)


@query("flt11_similarity_threshold", with_views("vectors", f""", {VEC}, {SELF}, {near_sql('q')}
    select query_id, row_id, round(1 - distance, 6) as similarity from near where 1 - distance >= 0.3"""))
def _(spark, sf):
    return _nearest(spark, sf, min_similarity=0.3).select("query_id", "row_id",
                                                          F.round("similarity", 6).alias("similarity"))


@query("jon4_not_chosen", with_views("vectors", f""", {VEC}, {SELF}, {near_sql('q', 4)}, chosen as (select distinct
    row_id from near) select row_id, word from e where row_id not in (select row_id from chosen)"""))
def _(spark, sf):
    rows = view(spark, sf, "vectors").select("row_id", "word")
    return joins.not_done(rows, _nearest(spark, sf, 4), "row_id")


@query("jon5_chosen", with_views("vectors", f""", {VEC}, {SELF}, {near_sql('q', 4)}, chosen as (select distinct
    row_id from near) select row_id, word, time_period from e where row_id in (select row_id from chosen)"""))
def _(spark, sf):
    rows = view(spark, sf, "vectors").select("row_id", "word", "time_period")
    return joins.chosen(rows, _nearest(spark, sf, 4), "row_id")


@query("jon9_own_vector", with_views("vectors", """select english_translation as word, row_id,
    round(vector[1]::double, 6) as x1 from vectors qualify row_number() over (partition by english_translation
    order by row_id) = 1"""))
def _(spark, sf):
    rows = view(spark, sf, "vectors").select(F.col("english_translation").alias("word"), "row_id", "vector")
    return neighbours.first_vectors(rows).select(
        "word", "row_id", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("x1"))


@query("win2_similar_words", with_views("vectors", f""", {VEC}, {SELF}, {near_sql('q', 6, False)},
    o as (select *, row_number() over (partition by query_id order by rank) as r from near where row_id <> query_id)
    select 'w' || query_id as word, cast(r as int) as rank, row_id, round(1 - distance, 6) as similarity from o
    where r <= 5"""))
def _(spark, sf):
    vectors = view(spark, sf, "vectors")
    return neighbours.similar_words(vectors, vectors).select("word", "rank", "row_id",
                                                             F.round("similarity", 6).alias("similarity"))


@query("agg5_mean_pooling", with_views("tokens", """, x as (select item_id, mask, unnest(vec)::double as value,
    unnest(generate_series(1, len(vec))) - 1 as dim from tokens) select item_id, cast(dim as int) as dim,
    round(sum(value * mask) / greatest(sum(mask), 1e-9), 6) + 0.0 as value from x group by item_id, dim"""))
def _(spark, sf):
    pooled = pooling.mean_pooling(view(spark, sf, "tokens"))
    return pooled.select("item_id", F.posexplode("vector").alias("dim", "v")) \
        .select("item_id", "dim", (F.round("v", 6) + 0.0).alias("value"))


_FIRST_TOKENS = """select label as item_id, cast(row_number() over (partition by label order by vec_id) - 1 as int)
    as pos, embedding as vec from {embeddings}"""


@query("agg6_first_token", f"""select item_id, round(vec[1]::double, 6) as x1, round(vec[64]::double, 6) as x64
    from ({_FIRST_TOKENS.format(embeddings="embeddings")}) where pos = 0""")
def _(spark, sf):
    tokens = spark.sql(_FIRST_TOKENS, embeddings=table(spark, sf, "embeddings"))
    return pooling.first_token(tokens).select(
        "item_id", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("x1"),
        F.round(F.get("vector", F.lit(63)).cast("double"), 6).alias("x64"))


@query("src8_chunks", """select vec_id, x1, x64, cast(floor(rn / 64) + 1 as bigint) as chunk_number,
    cast(ceil(total / 64.0) as bigint) as total_chunks,
    count(*) over (partition by floor(rn / 64)) as words_in_chunk
    from (select vec_id, embedding[1]::double as x1, embedding[64]::double as x64,
    row_number() over (order by vec_id) - 1 as rn, count(*) over () as total from embeddings)""")
def _(spark, sf):
    chunks = ranking.with_chunks(table(spark, sf, "embeddings").select("vec_id", "embedding"), 64, "vec_id")
    return chunks.select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x1"),
                         F.get("embedding", F.lit(63)).cast("double").alias("x64"),
                         "chunk_number", "total_chunks", "words_in_chunk")


@query("vec9_projection")
def _(spark, sf):
    return projection.reduce_dimensions(view(spark, sf, "vectors").select("row_id", "vector"), 3).drop("vector")


@query("vec9_projection_variance", """with x as (select vec_id, unnest(embedding)::double as v,
    unnest(range(len(embedding))) as dim from embeddings), t as (select sum(s) as total from (select var_samp(v) as s
    from x group by dim)) select (select count(*) + 1 from embeddings) as n_rows, 1::bigint as n_without,
    round(total, 3) as total_variance, 0.0::double as largest_covariance from t""")
def _(spark, sf):
    """All coordinates together keep the variance, none varies with another, and a row without a vector stays."""
    vectors = view(spark, sf, "vectors").select("row_id", "vector")
    whole = projection.reduce_dimensions(vectors.unionByName(vectors.limit(1).withColumn("vector", F.lit(None).cast("array<float>"))), 64)
    total = sum((F.var_samp(f"x{i}") for i in range(2, 65)), F.var_samp("x1"))
    pairs = [F.abs(F.covar_samp(f"x{i}", f"x{j}")) for i in range(1, 7) for j in range(1, i)]
    return whole.agg(F.count("*").alias("n_rows"), F.count_if(F.col("x1").isNull()).alias("n_without"),
                     F.round(total, 3).alias("total_variance"), F.round(F.greatest(*pairs), 6).alias("largest_covariance"))


@query("vec9_graph_layout")
def _(spark, sf):
    return projection.neighbour_layout(view(spark, sf, "vectors").select("row_id", "vector")).rows


@query("vec9_graph_check", """select count(*) as n_rows, i::int as axis, 1.0::double as length, 0.0::double as along_roots, true as settled,
    0.0::double as along_others from embeddings, (select unnest([1, 2, 3]) as i) group by i""")
def _(spark, sf):
    """The layout's axes against its graph: of length one, at right angles to one another and to the trivial axis, and
    the links move each along itself."""
    graph = projection.neighbour_graph(view(spark, sf, "vectors").select("row_id", "vector"))
    rows = projection.spectral_layout(graph).rows.withColumnRenamed("row_id", "a")
    x, y = ["x1", "x2", "x3"], ["y1", "y2", "y3"]
    moved = graph.join(rows.withColumnRenamed("a", "b"), "b").groupBy("a").agg(
        F.sqrt(F.count("*")).alias("root"), *[F.sum(F.col("w") * F.col(c)).alias(d) for c, d in zip(x, y)])
    both = rows.join(moved, "a")

    def total(f):
        return F.sum(f)

    axes = []
    for i, (c, d) in enumerate(zip(x, y)):
        value = total(F.col(c) * F.col(d))
        # |Sx - vx|^2 = |Sx|^2 - v^2 for an axis of length one
        rest = total(F.col(d) * F.col(d)) - value * value
        others = F.greatest(*[F.abs(total(F.col(c) * F.col(o))) for o in x if o != c])
        axes.append(F.struct(F.lit(i + 1).alias("axis"), F.round(total(F.col(c) * F.col(c)), 6).alias("length"),
                             (F.round(F.abs(total(F.col(c) * F.col("root"))), 6) + 0.0).alias("along_roots"), (rest < 1e-6).alias("settled"),
                             (F.round(others, 6) + 0.0).alias("along_others")))
    return both.agg(F.count("*").alias("n_rows"), F.array(*axes).alias("axes")).select("n_rows", F.explode("axes").alias("p")).select("n_rows", "p.*")


def letter_counts(batches):
    """A stand-in model that SQL can repeat: length and two letter counts."""
    for texts in batches:
        yield texts.map(lambda t: [float(len(t)), float(t.count("e")), float(t.count("t"))])


def _counts_sql(x: str) -> str:
    return (f"length({x})::double as v1, (length({x}) - length(replace({x}, 'e', '')))::double as v2, "
            f"(length({x}) - length(replace({x}, 't', '')))::double as v3")


def _counts(df, *columns):
    return df.select(*columns, *[F.get("vector", F.lit(i)).cast("double").alias(f"v{i + 1}") for i in range(3)])


@query("udf1_embed", f"select doc_id, {_counts_sql('text')} from documents")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return _counts(enrichment.embed(docs, "text", letter_counts, "doc_id"), "doc_id")


def picky_counts(batches):
    """The same, but it refuses a batch that holds a text whose length is a multiple of seven."""
    for texts in batches:
        if any(len(t) % 7 == 0 for t in texts):
            raise ValueError("cannot read this")
        yield texts.map(lambda t: [float(len(t)), float(t.count("e")), float(t.count("t"))])


@query("udf1_failing_model", f"""select doc_id, case when length(text) % 7 <> 0 then v1 end as v1,
    case when length(text) % 7 <> 0 then v2 end as v2, case when length(text) % 7 <> 0 then v3 end as v3,
    case when length(text) % 7 = 0 then 'ValueError: cannot read this' end as error
    from (select doc_id, text, {_counts_sql('text')} from documents)""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return _counts(enrichment.embed(docs, "text", picky_counts, "doc_id"), "doc_id", F.col("vector_error").alias("error"))


# ---------------------------------------------------------------- phonetics

# every phone of every stored pronunciation
_PHONE_ROWS = """pr as (select row_id, time_period, regexp_extract_all(translate(phonetic_representation, '/[]', ''),
    '(?s).') as ps from vectors), pp as (select row_id, 1000 - time_period as d, unnest(ps) as phone,
    cast(unnest(generate_series(1, len(ps))) - 1 as int) as pos from pr)"""


def _phone_rows(spark, sf):
    return view(spark, sf, "vectors").select(
        "row_id", (F.lit(1000) - F.col("time_period")).alias("d"),
        F.posexplode(ph.phones("phonetic_representation")).alias("pos", "phone"))


@query("vec2_nearest_phone", with_views("vectors", f""", {PHONES}, {_PHONE_ROWS}, {drift_sql('g', 'pp')},
    {nearest_sql('o', 'g')} select row_id, pos, phone, o.out as nearest from pp join o using (phone, d)"""))
def _(spark, sf):
    moved = ph.drift_features(ph.phone_features("phone"), "d")
    return _phone_rows(spark, sf).withColumn("g", moved).select(
        "row_id", "pos", "phone", ph.nearest_phone("g").alias("nearest"))


@query("vec3_phone_features", with_views("vectors", f""", {PHONES}, {_PHONE_ROWS}, j as (select row_id, pos, phone,
    coalesce(feat, {ZERO}) as feat from pp left join phones using (phone)) select row_id, pos, phone,
    cast(unnest(generate_series(0, 13)) as int) as dim, unnest(feat) as value from j"""))
def _(spark, sf):
    rows = _phone_rows(spark, sf).withColumn("f", ph.phone_features("phone"))
    return rows.select("row_id", "pos", "phone", F.posexplode("f").alias("dim", "value"))


@query("vec4_spell", with_views("vectors", f""", {PHONES}, src as (select distinct phonetic_representation as ipa,
    0 as d from vectors), s_p as (select ipa, d, unnest(regexp_extract_all(translate(ipa, '/[]', ''), '(?s).'))
    as phone, unnest(generate_series(1, length(translate(ipa, '/[]', '')))) as pos from src),
    g as (select distinct phone, d, coalesce(feat, {ZERO}) as g from s_p left join phones using (phone)),
    {nearest_sql('o', 'g')}, j as (select ipa, '/' || string_agg(out, '' order by pos) || '/' as spelled from s_p
    join o using (phone, d) group by 1) select row_id, spelled from vectors join j on ipa = phonetic_representation"""))
def _(spark, sf):
    features = F.transform(ph.phones("phonetic_representation"), ph.phone_features)
    return view(spark, sf, "vectors").select("row_id", ph.spell(features).alias("spelled"))


@query("vec5_drift_features", with_views("vectors", f""", {PHONES}, {_PHONE_ROWS}, {drift_sql('g', 'pp')}
    select row_id, pos, phone, cast(unnest(generate_series(0, 13)) as int) as dim,
    round(unnest(g), 6) as value from pp join g using (phone, d)"""))
def _(spark, sf):
    rows = _phone_rows(spark, sf).withColumn("g", ph.drift_features(ph.phone_features("phone"), "d"))
    return rows.select("row_id", "pos", "phone", F.posexplode("g").alias("dim", "v")) \
        .select("row_id", "pos", "phone", "dim", F.round("v", 6).alias("value"))


@query("vec5_sound_shift", with_views("vectors", f""", {PHONES}, pairs as (select row_id,
    phonetic_representation as ipa, t - time_period as d, t as target_time from vectors,
    (values (-3000), (-700), (0), (90), (1000), (2000)) x(t)), {shift_sql('sh', 'pairs')}
    select row_id, cast(target_time as int) as target_time, shifted from pairs join sh using (ipa, d)"""))
def _(spark, sf):
    times = F.explode(F.array(*[F.lit(t) for t in (-3000, -700, 0, 90, 1000, 2000)]))
    rows = view(spark, sf, "vectors").select("row_id", "phonetic_representation", "time_period", times.alias("target_time"))
    return rows.select("row_id", "target_time", ph.sound_shift(
        "phonetic_representation", F.col("target_time") - F.col("time_period")).alias("shifted"))


@query("win7_latest_form", with_views("vectors", f""", {VEC}, {SELF}, {near_sql('q')} select query_id, time_period,
    rank, phonetic_representation from near qualify row_number() over (partition by query_id order by time_period desc,
    rank desc) = 1"""))
def _(spark, sf):
    return _forms(spark, sf).select("query_id", ph.latest_form("forms").alias("f")).select("query_id", "f.*")


_FUTURE = (500, 1000, 2000)


@query("vec6_future_form", with_views("vectors", f""", {PHONES}, {VEC}, {SELF}, {near_sql('q')}, base as (select * from
    near qualify row_number() over (partition by query_id order by time_period desc, rank desc) = 1),
    pairs as (select query_id, t as target_time, phonetic_representation as ipa, t - time_period as d from base,
    (values (-300), (0), (500), (1000), (2000)) x(t)), {shift_sql('sh', 'pairs')}
    select query_id, cast(target_time as int) as target_time, case when target_time > 0 then shifted end as ipa
    from pairs join sh using (ipa, d)"""))
def _(spark, sf):
    times = F.explode(F.array(*[F.lit(t) for t in (-300, 0, *_FUTURE)]))
    rows = _forms(spark, sf).select("query_id", "forms", times.alias("target_time"))
    return prediction.with_future_form(rows).select("query_id", "target_time", "ipa")


def form_sql(name: str, targets: str) -> str:
    """``name``(query_id, t, ipa): the pronunciation at each target, from ``near``."""
    return f"""{name}_n as (select {targets}.query_id, t, phonetic_representation as ipa from {targets} join near
          using (query_id) where abs(time_period - t) <= 500 qualify row_number() over (partition by
          {targets}.query_id, t order by abs(time_period - t), time_period, rank) = 1),
        {name}_b as (select {targets}.query_id, t, phonetic_representation as ipa, t - time_period as d from {targets}
          join near using (query_id) qualify row_number() over (partition by {targets}.query_id, t order by
          case when t > 0 then -time_period else abs(time_period - t) end,
          case when t > 0 then -rank else time_period end, rank) = 1),
        {shift_sql(name + '_sh', name + '_b')},
        {name} as (select b.query_id, b.t, case when b.t < 0 then coalesce(n.ipa, s.shifted) when b.t > 0 then s.shifted
          end as ipa, n.ipa as near_ipa from {name}_b b left join {name}_n n using (query_id, t)
          left join {name}_sh s on s.ipa = b.ipa and s.d = b.d)"""


_TIMES = (-6000, -5000, -3000, -1600, -700, 0, 100, 1000)


@query("vec7_form_at", with_views("vectors", f""", {PHONES}, {VEC}, {SELF}, {near_sql('q')}, tg as (select query_id,
    cast(t as int) as t from q, (values {', '.join(f'({t})' for t in _TIMES)}) x(t)), {form_sql('fm', 'tg')}
    select query_id, t as target_time, ipa from fm"""))
def _(spark, sf):
    times = F.explode(F.array(*[F.lit(t) for t in _TIMES]))
    rows = _forms(spark, sf).select("query_id", "forms", times.alias("target_time"))
    return prediction.with_form_at(rows).select("query_id", "target_time", "ipa")


_RULE_ROWS = """select p_partkey as row_no, '/hwæt' || lower(p_name) || 'aːiːuːɒ k_in k_[ieæ] g_' || lower(p_type) || '/'
    as ipa, cast(case p_size % 6 when 0 then -1200 when 1 then -1100 when 2 then -700 when 3 then -300 when 4 then -100
    else 1 end as int) as year from {part}"""


def _rules_sql() -> str:
    out = "ipa"
    for sound, target, first, last, context in fixed.VOWEL_SHIFTS + fixed.CONSONANT_SHIFTS:
        new = f"replace({out}, '{sound}', '{target}')" if context is None else \
            f"regexp_replace({out}, '{sound}{context}', '{target}]', 'g')"
        out = f"(case when year between {first} and {last} then {new} else {out} end)"
    return out


@query("vec8_timed_rules", f"""with x as ({_RULE_ROWS.format(part="part")}) select row_no, year, {_rules_sql()} as ipa
    from x""")
def _(spark, sf):
    rows = spark.sql(_RULE_ROWS, part=table(spark, sf, "part"))
    return rows.select("row_no", "year", ph.timed_rules("ipa", "year").alias("ipa"))


# ---------------------------------------------------------------- jobs

@query("job1_consolidate", with_views("lexicon", f"""select word, english_translation, language,
    phonetic_representation, {PERIOD} as time_period from lexicon where trim(english_translation) <> ''
    and trim(word) <> '' and trim(phonetic_representation) <> '' qualify row_number() over
    (partition by word, language order by source_rank, row_no) = 1"""))
def _(spark, sf):
    lexicon = view(spark, sf, "lexicon")
    own = ("row_no", "word", "english_translation", "language", "phonetic_representation")
    roots, old_english = (lexicon.where(F.col("language") == name).select(
        "row_no", F.col("word").alias("original_characters"), F.col("phonetic_representation").alias("ipa_phoneme"),
        "english_translation", F.lit("left out").alias("description")) for name in ("PIE", "Old English"))
    us, uk = (lexicon.where(F.col("language") == name).select(*own) for name in ("US English", "UK English"))
    return consolidation.consolidate_files(roots, old_english, us, uk)


def _latin_folder(spark, sf) -> str:
    """The entries as full files and the raw content as batch files."""
    folder = scratch_path(spark, "latin")
    sources = {
        "Latin_terms_full_1.csv": view(spark, sf, "entries").select(
            "row_no", "ipa_phoneme", "english_translation", "part_of_speech", "original_characters"),
        "latin_batch_1.csv": view(spark, sf, "raw").where("row_no % 2 = 0").select(
            "row_no", F.col("original_characters").alias("title"), "original_characters", "ipa_phoneme",
            "english_translation", "part_of_speech", "raw_content"),
        "latin_batch_2.csv": view(spark, sf, "raw").where("row_no % 2 <> 0").select(    # no part of speech, another order
            "row_no", "raw_content", "english_translation", "ipa_phoneme", "original_characters"),
    }
    for name, rows in sources.items():
        ordered = rows.repartitionByRange(4, "row_no").sortWithinPartitions("row_no").drop("row_no")
        ordered.write.csv(f"{folder}/{name}", header=True, quote='"', escape='"')
    return folder


@query("src3_file_glob", with_views("raw entries", """select 0::int as precedence, original_characters, ipa_phoneme,
    case when english_translation <> 'None' then english_translation end as english_translation, cast(null as varchar)
    as raw_content from entries union all select 1, original_characters, ipa_phoneme, english_translation, raw_content
    from raw"""))
def _(spark, sf):
    folder = _latin_folder(spark, sf)
    columns = ("original_characters", "ipa_phoneme", "english_translation", "raw_content")
    kinds = cl.stack(files.read_latin_files(spark, folder, "full"), files.read_latin_files(spark, folder, "batch"))
    return kinds.select(F.col("source_rank").alias("precedence"), *columns)


@query("job2_latin_merge", with_views("raw entries", f""", {MINED_SQL}, u as (select ipa_phoneme,
    case when english_translation <> 'None' then english_translation end as english_translation,
    part_of_speech, original_characters, 0 as k, row_no from entries union all select ipa_phoneme,
    english_translation, part_of_speech, original_characters, 1, row_no from found)
    select ipa_phoneme, english_translation, part_of_speech, original_characters from u qualify
    row_number() over (partition by original_characters order by k, row_no) = 1"""))
def _(spark, sf):
    folder = _latin_folder(spark, sf)
    return consolidation.load_latin(spark, folder)


@query("job3_latin_clean", with_views("entries", f""", k as (select original_characters, translate(ipa_phoneme, '/[]', '')
    as ipa_phoneme, english_translation, part_of_speech from entries where original_characters is not null and
    (ipa_phoneme is not null or english_translation is not null)), f as (select * from k qualify row_number() over
    (partition by original_characters order by ipa_phoneme nulls last, english_translation nulls last,
    part_of_speech nulls last) = 1) select original_characters, {dedupe_sql('ipa_phoneme')} as ipa_phoneme,
    {dedupe_sql('english_translation')} as english_translation, {dedupe_sql('part_of_speech')} as part_of_speech
    from f order by original_characters"""))
def _(spark, sf):
    return consolidation.clean_latin(view(spark, sf, "entries"))


@query("job4_enrich", with_views("lexicon", f"""select row_no, word, english_translation,
    {_counts_sql('english_translation')} from lexicon where trim(english_translation) <> ''"""))
def _(spark, sf):
    lexicon = cl.blanks_to_null(view(spark, sf, "lexicon"))
    return _counts(consolidation.enrich(lexicon, letter_counts, "row_no"), "row_no", "word", "english_translation")


@query("job5_clean_basic", f"""select distinct trim(text, {TRIM}) as text, lang from documents""")
def _(spark, sf):
    return cl.clean_basic(table(spark, sf, "documents").select("text", "lang"))


# A request word's vector: a stored one picked by the word's length and first letter.
def word_vectors(vectors):
    def of(words):
        n = vectors.agg(F.count("*")).scalar()
        keyed = words.withColumn("row_id", ((F.length("word") * 37 + F.ascii("word")) % n).cast("long"))
        return keyed.join(vectors.select("row_id", "vector"), "row_id").drop("row_id")

    return of


def _requests(spark, sf):
    return view(spark, sf, "requests").withColumns({
        "dialect_text": F.concat(F.lit("Yo "), F.col("user_input")),
        "dialect_ipa": F.lit(None).cast("string"),
    })


def _answers(spark, sf):
    vectors = view(spark, sf, "vectors")
    return plan.predict_requests(_requests(spark, sf), vectors, word_vectors(vectors))


_WORDS = f"""chk as ({REQUEST_CHECK}), tok as (select request_id, time_period, unnest(ws) as word,
      unnest(generate_series(1, len(ws))) - 1 as pos from (select request_id, time_period,
      string_split_regex(original_text, '{BLANK}+') as ws from chk where error is null and language in
      ('PIE', 'old_english', 'future_english_1000', 'future_english_2000'))),
    wv as (select distinct word, (length(word) * 37 + ascii(word)) % (select count(*) from e) as query_id from tok),
    q as (select row_id as query_id, v as qv from e where row_id in (select query_id from wv))"""
_ANSWERED = f"""tg as (select distinct wv.query_id, tok.time_period as t from tok join wv using (word)),
    {form_sql('fm', 'tg')},
    top as (select query_id, time_period as first_period from near where rank = 1),
    again as (select fm.query_id, fm.t, fm.ipa, fm.t - first_period as d from fm join top using (query_id)),
    {shift_sql('ag', 'again')},
    ans as (select fm.query_id, fm.t, case when fm.t <= 0 and fm.near_ipa is not null then fm.near_ipa
      else coalesce(ag.shifted, '/???/') end as ipa from fm left join again using (query_id, t)
      left join ag on ag.ipa = again.ipa and ag.d = again.d),
    conf as (select query_id, 1 - min(distance) as confidence from near group by 1),
    said as (select tok.request_id, tok.time_period, tok.pos, tok.word, wv.query_id, ans.ipa, conf.confidence from tok
      join wv using (word) join ans on ans.query_id = wv.query_id and ans.t = tok.time_period
      join conf on conf.query_id = wv.query_id)"""
_PREDICT = f", {PHONES}, {VEC}, {_WORDS}, {near_sql('q')}, {_ANSWERED}"


@query("agg8_word_confidence", with_views("vectors", f""", {VEC}, {SELF}, {near_sql('q')} select query_id,
    round(1 - min(distance), 6) as confidence from near group by 1"""))
def _(spark, sf):
    return _forms(spark, sf).select("query_id", F.round(plan.confidence("forms"), 6).alias("confidence"))


@query("agg7_sentences", with_views("vectors requests", f"""{_PREDICT} select request_id,
    string_agg(ipa, ' ' order by pos) as predicted_text, round(avg(confidence), 6) as confidence_score from said
    group by 1"""))
def _(spark, sf):
    spoken = _answers(spark, sf).where(~F.col("is_modern") & F.col("error").isNull())
    return spoken.select("request_id", "predicted_text", F.round("confidence_score", 6).alias("confidence_score"))


@query("win6_top_matches", with_views("vectors requests", f"""{_PREDICT}, pool as (select said.request_id, said.pos,
    said.word as original_word, near.word, near.time_period, near.phonetic_representation as ipa, near.distance,
    near.rank from said join near using (query_id) where near.rank <= 3)
    select request_id, cast(row_number() over (partition by request_id order by distance, pos, rank) - 1 as int)
    as place, word, time_period, ipa, round(distance, 6) as distance, original_word from pool
    qualify row_number() over (partition by request_id order by distance, pos, rank) <= 5"""))
def _(spark, sf):
    found = _answers(spark, sf).select("request_id", F.posexplode("nearest_matches").alias("place", "m"))
    return found.select("request_id", "place", "m.word", "m.time_period", "m.ipa",
                        F.round("m.distance", 6).alias("distance"), "m.original_word")


@query("job6_predict_requests", with_views("vectors requests", f"""{_PREDICT}, spoken as (select request_id,
    string_agg(ipa, ' ' order by pos) as predicted_text, round(avg(confidence), 6) as confidence_score from said
    group by 1)
    select chk.request_id, chk.language, chk.time_period, chk.original_text,
    case when chk.error is not null then null when chk.language in ('us_english', 'british_english')
      then chk.original_text when chk.language = 'toronto_english' then 'Yo ' || r.user_input
      else spoken.predicted_text end as predicted_text, cast(null as varchar) as ipa_text,
    case when chk.error is null and chk.language = 'toronto_english' then split_part('Yo ' || r.user_input, chr(10), 1)
      end as explanation,
    case when chk.error is not null then null when chk.language in ('us_english', 'british_english', 'toronto_english')
      then 1.0::double else spoken.confidence_score end as confidence_score,
    chk.error is null and chk.language in ('us_english', 'british_english', 'toronto_english') as is_modern,
    chk.error is null and chk.language = 'toronto_english' as is_toronto, chk.error
    from chk join requests r using (request_id) left join spoken using (request_id)"""))
def _(spark, sf):
    return _answers(spark, sf).select(
        "request_id", "language", "time_period", "original_text", "predicted_text", "ipa_text", "explanation",
        F.round("confidence_score", 6).alias("confidence_score"), "is_modern", "is_toronto", "error")


@query("job6_word_predictions", with_views("vectors requests", f"""{_PREDICT}, direct as (select chk.request_id,
    string_split_regex(trim(case when chk.language = 'toronto_english' then 'Yo ' || r.user_input else chk.original_text
      end, {TRIM}), '{BLANK}+') as ws from chk join requests r using (request_id) where chk.error is null
      and chk.language in ('us_english', 'british_english', 'toronto_english'))
    select request_id, cast(pos as int) as pos, word as original, ipa, round(confidence, 6) as confidence from said
    union all select request_id, cast(unnest(generate_series(0, len(ws) - 1)) as int), unnest(ws), unnest(ws), 1.0::double
    from direct"""))
def _(spark, sf):
    found = _answers(spark, sf).select("request_id", F.posexplode("word_predictions").alias("pos", "w"))
    return found.select("request_id", "pos", "w.original", "w.ipa", F.round("w.confidence", 6).alias("confidence"))


@query("job7_timeline", with_views("vectors", f""", {PHONES}, {VEC}, {SELF}, {near_sql('q')},
    past as (select query_id, time_period as t, row_number() over (partition by query_id order by time_period) - 1
      as step from (select distinct query_id, time_period from near)),
    steps as (select query_id, t, step from past union all select query_id, x.t, n + x.i from
      (select query_id, count(*) as n from past group by 1),
      (values (0, 0), (1, 1000), (2, 2000), (3, 3000), (4, 4000), (5, 5000)) x(i, t)),
    tg as (select distinct query_id, cast(t as int) as t from steps), {form_sql('fm', 'tg')}
    select steps.query_id, cast(step as int) as step, cast(steps.t as int) as target_time,
    case when steps.t > 0 then 'FUTURE' else 'PAST' end as era, ipa from steps join fm
    on fm.query_id = steps.query_id and fm.t = steps.t"""))
def _(spark, sf):
    return plan.timeline(_forms(spark, sf))


_HARVEST = """with r as (select p_name, row_number() over (order by p_partkey) - 1 as rn from part)
    select cast(floor(rn / 20) as bigint) as batch, cast(rn % 20 as int) as place, 'x' as ipa_phoneme,
    p_name as english_translation, cast(null as varchar) as part_of_speech, p_name as original_characters, cast(null as varchar) as error from r"""


@query("job8_harvest", _HARVEST)
def _(spark, sf):
    return harvest.harvest(view(spark, sf, "terms"), "Latin", echo_reply)


def failing_reply(body: str) -> str:
    """No answer to a batch whose first title has an odd number of letters."""
    if len(body.split("\n")[1]) % 2:
        raise TimeoutError("no answer")
    return echo_reply(body)


@query("job8_failed_batches", """with r as (select p_name, row_number() over (order by p_partkey) - 1 as rn from part),
    e as (select rn // 20 as batch, cast(rn % 20 as int) as place, p_name, first(length('Title: ' || p_name) order by rn)
    over (partition by rn // 20 order by rn) % 2 = 1 as failed from r)
    select cast(batch as bigint) as batch, place, case when not failed then 'x' end as ipa_phoneme,
    case when not failed then p_name end as english_translation, cast(null as varchar) as part_of_speech,
    case when not failed then p_name end as original_characters,
    case when failed then 'TimeoutError: no answer' end as error from e""")
def _(spark, sf):
    path = scratch_path(spark, "replies")
    for _ in range(2):    # the second run asks for the failed batches again
        parsed = harvest.harvest(view(spark, sf, "terms"), "Latin", failing_reply, replies=path)
        parsed.count()
    return parsed


def root_reply(body: str) -> str:
    """A stand-in for the reply service: a root's title and the length of its sections."""
    entries = [e.split("\n", 2) for e in body.split("\n---\n")[:-1]]
    return "---".join(f"ipa_phoneme: [x]\nenglish_translation: {e[1][7:]}\ndescription: {len(e[2].strip())}" for e in entries)


@query("job8_root_harvest", with_views("roots", """, r as (select title, trim(replace(title, 'Reconstruction:Proto-Indo-European/', ''))
    as word, content, row_number() over (order by page_id) - 1 as rn from roots where title not like 'Category:%'),
    s as (select *, split_part(split_part(content, '===Etymology===' || chr(10), 2), chr(10) || '===', 1) as etymology,
      split_part(split_part(content, '===Reconstruction===' || chr(10), 2), chr(10) || '===', 1) as reconstruction,
      split_part(split_part(content, '===Root===' || chr(10), 2), chr(10) || '===', 1) as root from r)
    select cast(rn // 20 as bigint) as batch, cast(rn % 20 as int) as place, 'x' as ipa_phoneme,
    trim(title) as english_translation, cast(length('Root Section:') + length('Etymology Section:')
    + length('Reconstruction Section:') + length(trim(root, ' ' || chr(10))) + length(trim(etymology, ' ' || chr(10)))
    + length(trim(reconstruction, ' ' || chr(10))) + 7 as varchar) as description, word as original_characters,
    cast(null as varchar) as error from s"""))
def _(spark, sf):
    return harvest.harvest_roots(view(spark, sf, "roots"), root_reply)


@query("udf2_ask", """select cast(floor(p_partkey / 20) as bigint) as batch, string_agg('ipa_phoneme: [/x/]' || chr(10)
    || 'english_translation: ' || p_name || chr(10) || 'part_of_speech: null', '---' order by p_partkey) as reply
    from part group by 1""")
def _(spark, sf):
    entries = table(spark, sf, "part").selectExpr("p_partkey as position", "p_name as title", "p_type as raw_content")
    return enrichment.ask(batch_bodies(batch_entries(entries, 20)), echo_reply).drop("error")
