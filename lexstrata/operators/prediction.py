"""Pronunciations through time for tables of words and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.phonetics import closest_form, latest_form, sound_shift
from ..session import shuffle_partitions
from .joins import hot_keys, lookup


def collect_forms(neighbours: DataFrame, key: str = "query_id") -> DataFrame:
    """One row per query with its ranked neighbours; a list is as long as the search's top n."""
    columns = [c for c in neighbours.columns if c not in (key, "rank")]
    entry = F.struct("rank", *columns)
    return neighbours.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("forms"))


def _time_slices(points: DataFrame, key: str, parts: int) -> DataFrame:
    """The points with a ``_slice`` of time inside their key; keys without many points have one.

    Keys with more than 1/parts of the points are cut at quantiles of their times, so
    points of one time stay together. Cuts add up to about twice ``parts``.
    """
    hot = hot_keys(points, key, parts).where(F.col(key).isNotNull())
    if hot.isEmpty():
        return points.withColumn("_slice", F.lit(0))
    hot = F.broadcast(hot.withColumn("_step", F.ceil(F.lit(parts) / F.col("_slices")).cast("int")).drop("_slices"))
    shares = [i / parts for i in range(1, parts)]
    cuts = points.join(hot, key).groupBy(key).agg(F.first("_step").alias("_step"), F.percentile_approx("_time", shares, 10 * parts).alias("_cuts"))
    cuts = cuts.select(key, F.array_distinct(F.filter("_cuts", lambda c, i: (i + 1) % F.col("_step") == 0)).alias("_cuts"))
    table = points.sparkSession.createDataFrame(cuts.collect(), cuts.schema)    # as many cuts as slices
    return points.join(F.broadcast(table), key, "left") \
        .withColumn("_slice", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_time"))), F.lit(0))).drop("_cuts")


def _with_neighbours(points: DataFrame, key: str, parts: int, hot: bool) -> DataFrame:
    """Points ``key, _time, _form`` with the last form up to their time and the first one from it on.

    Both are carried along the sorted points of a slice. Slices of one key are stitched
    by their edges: what no form of the own slice answers, the nearest slice with a form does.
    """
    sliced = _time_slices(points, key, parts) if hot else points.withColumn("_slice", F.lit(0))
    forms_first = F.asc("_asked")
    up = Window.partitionBy(key, "_slice").orderBy(F.asc("_time"), forms_first).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key, "_slice").orderBy(F.desc("_time"), forms_first).rowsBetween(Window.unboundedPreceding, 0)
    carried = sliced.withColumns({"_before": F.last("_form", ignorenulls=True).over(up), "_after": F.last("_form", ignorenulls=True).over(down)})
    if not hot:
        return carried.drop("_slice")
    many = sliced.where(F.col("_slice") > 0).select(key).distinct()    # at most ``parts`` keys
    time = F.when(F.col("_form").isNotNull(), F.col("_time"))
    edges = sliced.join(F.broadcast(many), key).groupBy(key, "_slice").agg(F.max_by("_form", time).alias("_last"), F.min_by("_form", time).alias("_first"))
    left = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    right = Window.partitionBy(key).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(key, "_slice", F.last("_last", ignorenulls=True).over(left).alias("_left"),
                         F.last("_first", ignorenulls=True).over(right).alias("_right"))
    return carried.join(F.broadcast(edges), [key, "_slice"], "left").withColumns({
        "_before": F.coalesce("_before", "_left"), "_after": F.coalesce("_after", "_right")}).drop("_slice", "_left", "_right")


def nearest_in_time(events: DataFrame, attested: DataFrame, key: str, order: str, spread: str,
                    window: int | None = fixed.TIME_WINDOW, parts: int | None = None) -> DataFrame:
    """Each event with the attested form of its key nearest in time.

    Events carry ``target_time``; without a form in the window the match is null, as it
    is for events without a key or time. Of forms of one period the first in ``order``
    counts, of two equally near ones the earlier.

    A merge: distinct times asked for and forms are sorted together by key and time, and
    the form before and after each time is carried along. No key is ever one list or one
    task, however many periods it has. ``spread`` is any column that varies inside a key.
    """
    parts = parts or 4 * shuffle_partitions(events.sparkSession)
    # Without a key of more than its share of rows there is nothing to slice, neither times nor events.
    hot = not hot_keys(events.select(key).unionByName(attested.select(key)), key, parts).isEmpty()
    form = F.min(F.struct(F.col(order), F.col("phonetic_representation").alias("ipa")))
    forms = attested.where(F.col("time_period").isNotNull() & F.col(key).isNotNull()) \
        .groupBy(key, F.col("time_period").cast("long").alias("_time")).agg(form.alias("f")) \
        .select(key, "_time", F.lit(0).alias("_asked"), F.struct(F.col("_time").alias("period"), F.col("f.ipa").alias("ipa")).alias("_form"))
    at = F.struct(F.col(key), F.col("target_time").cast("long").alias("_time"))
    asked = events.where(F.col("target_time").isNotNull() & F.col(key).isNotNull()).select(at.alias("a")).distinct() \
        .select("a.*", F.lit(1).alias("_asked"), F.lit(None).cast(forms.schema["_form"].dataType).alias("_form"))
    carried = _with_neighbours(forms.unionByName(asked), key, parts, hot).where("_asked = 1")
    since, until = F.col("_time") - F.col("_before.period"), F.col("_after.period") - F.col("_time")
    near = F.when(F.col("_after").isNull() | (since <= until), F.col("_before")).otherwise(F.col("_after"))
    if window is not None:
        near = F.when(F.least(since, until) <= window, near)
    kind = attested.schema["time_period"].dataType
    answers = carried.select(F.struct(key, "_time").alias("_at"), near.alias("_m"))
    placed = events.withColumn("_at", at)
    out = lookup(placed, answers, "_at", spread, parts=parts) if hot else placed.join(answers, "_at", "left")
    return out.withColumns({"matched_period": F.col("_m.period").cast(kind), "matched_ipa": F.col("_m.ipa")}).drop("_at", "_m")


def with_form_at(df: DataFrame, out: str = "ipa", forms: str = "forms", time: str = "target_time") -> DataFrame:
    """The pronunciation at a time.

    Past: the form within the window, else the closest one shifted. Present:
    null. Future: the latest form shifted. No forms: null.
    """
    t = F.col(time)
    staged = df.withColumns({
        "_near": closest_form(forms, t, fixed.TIME_WINDOW),
        "_base": F.when(t > 0, _as_base(latest_form(forms))).otherwise(_as_base(closest_form(forms, t))),
    })
    shifted = sound_shift("_base.phonetic_representation", t - F.col("_base.time_period"))
    return staged.withColumn(
        out,
        F.when((t < 0) & F.col("_near").isNotNull(), F.col("_near.phonetic_representation"))
        .when(t != 0, shifted),
    ).drop("_near", "_base")


def _as_base(form: Column) -> Column:
    return F.when(form.isNotNull(), F.struct(
        form["time_period"].alias("time_period"),
        form["phonetic_representation"].alias("phonetic_representation"),
    ))


def with_future_form(df: DataFrame, out: str = "ipa", forms: str = "forms", time: str = "target_time") -> DataFrame:
    """The latest form shifted to a future time; null for other times."""
    t = F.col(time)
    staged = df.withColumn("_base", latest_form(forms))
    shifted = sound_shift("_base.phonetic_representation", t - F.col("_base.time_period"))
    return staged.withColumn(out, F.when(t > 0, shifted)).drop("_base")


def with_requested_form(df: DataFrame, out: str = "ipa", forms: str = "forms", time: str = "target_time") -> DataFrame:
    """The pronunciation a request gets.

    Up to the present the form within the window is used as it is. Otherwise the
    predicted form is shifted once more, by the gap to the first-ranked form.
    """
    t = F.col(time)
    staged = with_form_at(df, "_first", forms, time).withColumns({
        "_near": closest_form(forms, t, fixed.TIME_WINDOW),
        "_gap": t - F.get(F.col(forms), F.lit(0))["time_period"],
    })
    again = F.when(F.coalesce(F.col("_first"), F.lit("")) != "", sound_shift("_first", F.col("_gap"))) \
        .otherwise(F.lit(fixed.UNKNOWN_PREDICTION))
    return staged.withColumn(
        out,
        F.when((t <= 0) & F.col("_near").isNotNull(), F.col("_near.phonetic_representation")).otherwise(again),
    ).drop("_first", "_near", "_gap")
