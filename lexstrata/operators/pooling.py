"""Vector pooling."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_pooling(tokens: DataFrame, item: str = "item_id") -> DataFrame:
    """Masked mean of token vectors per item; an all-masked item gives zeros.

    Tokens are summed in each task before the shuffle, so an item may own any
    share of the tokens.
    """
    masked = F.transform(F.col("vec").cast("array<double>"), lambda x: x * F.col("mask").cast("double"))
    sums = tokens.select(item, F.col("mask").cast("double").alias("mask"), array_to_vector(masked).alias("v")) \
        .groupBy(item).agg(
            Summarizer.mean(F.col("v")).alias("mean"),
            F.count("*").alias("n"),
            F.sum("mask").alias("weight"),
        )
    scale = F.col("n") / F.greatest(F.col("weight"), F.lit(1e-9))
    return sums.select(item, F.transform(vector_to_array("mean"), lambda x: x * scale).alias("vector"))


def first_token(tokens: DataFrame) -> DataFrame:
    """The vector at position 0 of each item."""
    return tokens.where(F.col("pos") == 0).select("item_id", F.col("vec").alias("vector"))
