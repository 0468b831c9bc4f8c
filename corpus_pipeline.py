"""A training corpus from raw documents in five stages.

1. language ID: texts without a recognisable language go
2. n-gram Jaccard join: of each group of near duplicates the smallest doc_id stays
3. benchmark decontamination: documents that hold a benchmark passage go
4. personal data: every span found is masked in the text
5. SentencePiece: texts become token ids, checked by decoding them

All but the last return the columns of ``documents``; each works on what the one
before has kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.llm import contamination, jaccard, language, personal, pieces
from lexstrata.llm.components import saved
from lexstrata.session import shared_dir

LEAST_SCORE = 0.35    # mean probability of the language below which a text is rejected: short texts full of numbers stay
ORACLE_SQL = None    # the learned stages are beyond SQL; tests compare with plain versions


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on ``doc_id``; the ids are broadcast only if they are few. A null id matches nothing."""
    few = ids.count() <= jaccard.BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and sure enough."""
    return language.keep_known(docs, language.learn(docs), LEAST_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group, once where its row is repeated.

    Rows with a null doc_id are linked with nothing: each is its own group and stays.
    Of rows with one doc_id and one text a single one stays; a doc_id that is given to
    different texts keeps one row of each, so no text goes only because of its id.
    """
    first = F.max(F.col("doc_id") == F.col("component_id"))
    gone = saved(jaccard.near_duplicates(docs).groupBy("doc_id").agg(first.alias("kept")).where("not kept").select("doc_id"))
    twice = saved(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    kept = _by_id(docs, gone, "left_anti")
    return _by_id(kept, twice, "left_anti").unionByName(_by_id(kept, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return contamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; ``n_chars`` follows the text."""
    return personal.mask_personal(docs, personal.learn(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    import public_tokenizers

    return pieces.tokenized(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("personal data", personal_stage),
    ("SentencePiece encoding and decoding", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next stage."""
    folder = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
