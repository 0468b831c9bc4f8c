"""Batch prediction: request tables to pronunciations, and word timelines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import strip, words
from ..operators import neighbours as nn
from ..operators.cleaning import literal_map
from ..operators.prediction import collect_forms, nearest_in_time, with_form_at, with_future_form, with_requested_form  # noqa: F401
from ..session import land

MATCHES_PER_WORD = 3
MATCHES_PER_REQUEST = 5
PART_WORDS = 1 << 18    # of requests whose words are answered together
WORD_TYPE = "array<struct<original: string, ipa: string, confidence: double>>"
MATCH_TYPE = ("array<struct<word: string, time_period: int, ipa: string, distance: double, original_word: string>>")


def validate(requests: DataFrame) -> DataFrame:
    """Add ``time_period``, ``original_text`` and ``error`` (null when the request is good)."""
    language, raw = F.col("language"), F.col("user_input")
    cleaned = strip(F.lower(raw))
    period = F.element_at(literal_map(fixed.REQUEST_PERIODS), language).cast("int")

    def missing(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    error = F.when(missing(language) | missing(raw), F.lit("Missing required fields")) \
        .when(period.isNull(), F.concat(F.lit("Unsupported language selection: "), language)) \
        .when(cleaned == "", F.lit("Empty input text"))
    return requests.withColumns({"time_period": period, "original_text": cleaned, "error": error})


def in_parts(requests: DataFrame) -> DataFrame:
    """Requests with the ``words`` of their text and a ``_part`` by id; a part has some ``PART_WORDS`` words. Without words or id: none."""
    spoken = requests.withColumn("words", words("original_text")).where(F.col("request_id").isNotNull() & (F.size("words") > 0))
    total = spoken.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    parts = max(-(-total // PART_WORDS), requests.sparkSession.sparkContext.defaultParallelism)
    return spoken.withColumn("_part", F.pmod(F.xxhash64("request_id"), F.lit(parts)).cast("int"))


def part_words(spoken: DataFrame) -> DataFrame:
    """(_part, time_period, word): each word once a part and time, counted off where the part's texts lie."""
    return spoken.select("_part", "time_period", "original_text").repartition("_part") \
        .select("_part", "time_period", F.explode(words("original_text")).alias("word")).distinct()


def vocabulary(found: DataFrame) -> DataFrame:
    """(word, times): each word once, with the few times it is asked for."""
    return found.groupBy("word").agg(F.collect_set("time_period").alias("times"))


def word_neighbours(word_vectors: DataFrame, lexicon: DataFrame, top_n: int = 10, nearest=nn.nearest_with_coverage, **search) -> DataFrame:
    """The ranked neighbours of each word, with their lexicon columns, as ``forms``.

    ``nearest`` is the search: the exact one, or ``approximate.approximate_with_coverage``
    where a lexicon is too large to be read for every word.

    ``word_vectors``: (word, vector, ...), one row per word; its other columns are
    handed through. ``lexicon``: (row_id, word, time_period,
    phonetic_representation, vector).
    """
    ids = [c for c in word_vectors.columns if c != "vector"]
    queries = word_vectors.select(F.struct(*ids).alias("query_id"), "vector")
    named = lexicon.withColumnRenamed("word", "form")
    near = nearest(queries, named, top_n, keep=("form", "phonetic_representation"), **search)
    return collect_forms(near.drop("similarity")).select("query_id.*", "forms")


def confidence(forms: Column | str) -> Column:
    """1 - the least distance among the neighbours; 0 without neighbours."""
    forms = F.col(forms) if isinstance(forms, str) else forms
    least = F.array_min(F.transform(forms, lambda f: f["distance"]))
    return F.coalesce(F.lit(1.0) - least, F.lit(0.0))


def predict_words(neighbours: DataFrame) -> DataFrame:
    """(word, target_time) rows of (word, times, forms), with ipa, confidence and the word's first matches."""
    first = F.transform(F.slice("forms", 1, MATCHES_PER_WORD), lambda f: F.struct(
        f["distance"].alias("distance"), f["rank"].alias("rank"), f["form"].alias("word"),
        f["time_period"].alias("time_period"), f["phonetic_representation"].alias("ipa")))
    pairs = neighbours.select("word", "forms", F.explode("times").alias("target_time"))
    return with_requested_form(pairs).select(
        "word", "target_time", "ipa", confidence("forms").alias("confidence"), first.alias("matches"))


def _spoken(text: Column, word_type: str = WORD_TYPE) -> Column:
    return F.transform(words(text), lambda w: F.struct(
        w.alias("original"), w.alias("ipa"), F.lit(1.0).alias("confidence"))).cast(word_type)


_SHAPE = ("request_id", "language", "time_period", "original_text", "predicted_text", "ipa_text",
          "confidence_score", "is_modern", "is_toronto", "explanation", "word_predictions", "nearest_matches", "error")


def _row(df: DataFrame, **columns: Column) -> DataFrame:
    empty = {
        "predicted_text": F.lit(None).cast("string"),
        "ipa_text": F.lit(None).cast("string"),
        "confidence_score": F.lit(None).cast("double"),
        "is_modern": F.lit(False),
        "is_toronto": F.lit(False),
        "explanation": F.lit(None).cast("string"),
        "word_predictions": F.lit(None).cast(WORD_TYPE),
        "nearest_matches": F.array().cast(MATCH_TYPE),
    }
    return df.withColumns({**empty, **columns}).select(*_SHAPE)


def passthrough(valid: DataFrame) -> DataFrame:
    """Modern and dialect requests: no search, confidence 1.

    The dialect's wording and pronunciation come with the request
    (``dialect_text``, ``dialect_ipa``); without them the request fails.
    """
    dialect = F.col("language") == fixed.DIALECT_LABEL
    said = F.when(dialect, F.col("dialect_text")).otherwise(F.col("original_text"))
    failed = dialect & F.col("dialect_text").isNull()
    return _row(
        valid,
        predicted_text=said,
        ipa_text=F.when(dialect, F.col("dialect_ipa")),
        confidence_score=F.when(~failed, F.lit(1.0)),
        is_modern=~failed,
        is_toronto=dialect & ~failed,
        explanation=F.when(dialect, F.get(F.split("dialect_text", "\n"), F.lit(0))),
        word_predictions=_spoken_dialect(dialect, said),
        error=F.when(failed, F.lit("Toronto translation failed")),
    )


def _spoken_dialect(dialect: Column, said: Column) -> Column:
    # The dialect's words keep their case; cleaned text is lower case already.
    plain = F.filter(F.split(strip(said), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    kept = F.transform(plain, lambda w: F.struct(
        w.alias("original"), w.alias("ipa"), F.lit(1.0).alias("confidence"))).cast(WORD_TYPE)
    return F.when(dialect, kept).otherwise(_spoken(said))


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type with nulls allowed at every depth, as a declared schema has it; which columns hold none depends on the search."""
    if pa.types.is_list(kind):
        return pa.list_(pa.field("element", _nullable(kind.value_type)))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    return kind


def _spoken_words(requests: pa.Table, answers: pa.Table) -> pa.Table:
    """The requests of a part with the answers of their words as ``ws``, in the order of the words; rows of one id share theirs."""
    texts = requests.column("words").combine_chunks()
    sizes = pc.list_value_length(texts).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)

    def key(word, time):
        return pc.binary_join_element_wise(word, pc.cast(time, pa.string()), "\x01")

    said = pc.list_flatten(texts)
    at = pc.index_in(key(said, requests.column("time_period").combine_chunks().take(pa.array(row))),
                     value_set=key(answers.column("word").combine_chunks(), answers.column("target_time").combine_chunks()))
    ids = requests.column("request_id").combine_chunks().dictionary_encode().indices.to_numpy()
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # A word without a vector or without neighbours has no answer.
    matches = answers.column("matches").combine_chunks()
    found = pa.table({
        "id": ids[row], "word_pos": place.astype(np.int32), "word": said,
        "ipa": pc.fill_null(answers.column("ipa").combine_chunks().take(at), fixed.UNKNOWN_PREDICTION),
        "confidence": pc.fill_null(answers.column("confidence").combine_chunks().take(at), 0.0),
        "matches": matches.cast(_nullable(matches.type)).take(at)})
    if len(ids) and ids.max() + 1 < len(ids):
        order = [(c, "ascending") for c in ("id", "word_pos", "word", "ipa", "confidence")]
        found = found.take(pc.sort_indices(found.drop_columns(["matches"]), sort_keys=order))
    entries = found.drop_columns(["id"]).to_struct_array().combine_chunks()
    ends = np.cumsum(np.bincount(ids[row], minlength=ids.max() + 1 if len(ids) else 0))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), entries)
    lists = lists.cast(_nullable(lists.type)).take(pa.array(ids))
    return requests.drop_columns(["_part", "words"]).append_column("ws", lists)


def assemble(spoken: DataFrame, found: DataFrame, predictions: DataFrame) -> DataFrame:
    """Word predictions back into requests, words in order.

    ``spoken``: requests ``in_parts``; ``found``: their ``part_words``. An answer goes once to
    each part that has its word, and meets the texts there: words said often move once a part.
    A list is as long as its request's own text. The average is summed in word
    order, so it is the same on every run.
    """
    asked = found.withColumnRenamed("time_period", "target_time")
    answers = asked.join(predictions, ["word", "target_time"]).select("_part", "word", "target_time", "ipa", "confidence", "matches")
    kept = ("request_id", "language", "time_period", "original_text")
    texts = spoken.select("_part", *kept).repartition("_part").withColumn("words", words("original_text"))
    matches = predictions.schema["matches"].dataType.simpleString()
    schema = ", ".join([f"{c} {spoken.schema[c].dataType.simpleString()}" for c in kept]
                       + [f"ws array<struct<word_pos: int, word: string, ipa: string, confidence: double, matches: {matches}>>"])
    packed = texts.groupBy("_part").cogroup(answers.groupBy("_part")).applyInArrow(_spoken_words, schema)
    total = F.aggregate("ws", F.lit(0.0), lambda acc, w: acc + w["confidence"])
    pool = F.flatten(F.transform("ws", lambda w: F.transform(F.coalesce(w["matches"], F.array().cast(matches)), lambda m: F.struct(
        m["distance"].alias("distance"), w["word_pos"].alias("pos"), m["rank"].alias("rank"),
        m["word"].alias("word"), m["time_period"].alias("time_period"), m["ipa"].alias("ipa"),
        w["word"].alias("original_word")))))
    best = F.transform(F.slice(F.sort_array(pool), 1, MATCHES_PER_REQUEST), lambda m: F.struct(
        m["word"].alias("word"), m["time_period"].alias("time_period"), m["ipa"].alias("ipa"),
        m["distance"].alias("distance"), m["original_word"].alias("original_word")))
    return _row(
        packed,
        predicted_text=F.array_join(F.transform("ws", lambda w: w["ipa"]), " "),
        confidence_score=total / F.size("ws"),
        word_predictions=F.transform("ws", lambda w: F.struct(
            w["word"].alias("original"), w["ipa"].alias("ipa"), w["confidence"].alias("confidence"))).cast(WORD_TYPE),
        nearest_matches=best.cast(MATCH_TYPE),
        error=F.lit(None).cast("string"),
    )


def predict_requests(requests: DataFrame, lexicon: DataFrame, word_vectors, top_n: int = 10, **search) -> DataFrame:
    """Answer a table of requests (request_id, language, user_input[, dialect_text, dialect_ipa]).

    ``word_vectors`` is a function that adds a ``vector`` to a table with a ``word``
    column of distinct words. Every distinct word is searched once, every distinct
    (word, time) predicted once. The checked requests and the distinct words of their
    parts are landed, as several branches read them. ``search`` goes to ``word_neighbours``.
    """
    for name in ("dialect_text", "dialect_ipa"):
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast("string"))
    # Of the texts only the one to answer is landed, and a dialect's wording where it is asked for.
    dialect = F.col("language") == fixed.DIALECT_LABEL
    said = {c: F.when(dialect, F.col(c)) for c in ("dialect_text", "dialect_ipa")}
    checked = land(validate(requests).withColumns(said).select(
        "request_id", "language", "time_period", "original_text", *said, "error"), "requests")
    good, bad = checked.where(F.col("error").isNull()), checked.where(F.col("error").isNotNull())
    direct = F.col("language").isin(*fixed.MODERN_LABELS, fixed.DIALECT_LABEL)
    spoken_requests = in_parts(good.where(~direct))
    found = land(part_words(spoken_requests), "words")
    forms = word_neighbours(word_vectors(vocabulary(found)), lexicon, top_n, **search)
    spoken = assemble(spoken_requests, found, predict_words(forms))
    errors = _row(bad, error=F.col("error"), nearest_matches=F.lit(None).cast(MATCH_TYPE))
    return passthrough(good.where(direct)).unionByName(spoken).unionByName(errors)


def timeline(neighbours: DataFrame) -> DataFrame:
    """Each query's pronunciation at its neighbours' periods and then the future steps.

    ``neighbours``: (query_id, forms). The present may appear twice.
    """
    past = F.sort_array(F.array_distinct(F.transform("forms", lambda f: f["time_period"])))
    times = F.concat(past, F.array(*[F.lit(t) for t in fixed.FUTURE_TIMELINE]).cast("array<int>"))
    steps = neighbours.select("*", F.posexplode(times).alias("step", "target_time"))
    era = F.when(F.col("target_time") > 0, F.lit("FUTURE")).otherwise(F.lit("PAST"))
    return with_form_at(steps).select("query_id", "step", "target_time", era.alias("era"), "ipa")
