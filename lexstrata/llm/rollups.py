"""Token totals kept up to date by signed changes.

A change is a row ``sign, source, lang, tokenizer, tokens``: an insert counts plus,
a delete minus, a revision is the old row minus and the new row plus. Totals are
sums, so a batch of changes is summed by itself and only its few sums are stored;
the texts are never read again and the totals never rebuilt.

Each batch has its folder under the store. Spark marks a folder as done when its
last file is written, and only folders so marked are read. A batch that comes again
after that is ignored; one that broke off before is written anew. So a batch counts
once, whatever is lost or repeated. One writer at a time works on a store.

Defined results: a null text has no tokens but is a document; a null source or
language is a group of its own; equal rows within a batch count each; sums that come
to no documents and no tokens are left out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["source", "lang", "tokenizer"]

TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "space-1": lambda text: F.regexp_count(text, F.lit(r"[^ \t-\r]+")),
    "marks-2": lambda text: F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")),
}


def count_tokens(docs: DataFrame, text: Column | str = "text", tokenizers=TOKENIZERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``source, lang, tokenizer, tokens`` per document and tokenizer version, with the columns to keep."""
    text = F.col(text) if isinstance(text, str) else text
    counted = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.coalesce(count(text), F.lit(0)).cast("long").alias("tokens"))
                        for name, count in tokenizers.items()])
    return docs.select(*keep, "source", "lang", F.explode(counted).alias("_t")).select(*keep, "source", "lang", "_t.*")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(F.lit(1).alias("sign"), *GROUP, "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(F.lit(-1).alias("sign"), *GROUP, "tokens")


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """A store of totals at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, batch: int) -> str:
        return f"{self.path}/batch={int(batch)}"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        path, files = self._files()
        if not files.exists(path):
            return []
        folders = [f.getPath() for f in files.listStatus(path) if f.getPath().getName().startswith("batch=")]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()[6:]) for p in folders if files.exists(done(p, "_SUCCESS")))

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Add a batch of signed changes; False if it was counted before."""
        if batch in self.committed():
            return False
        summed = changes.groupBy(*GROUP).agg(F.sum(F.col("sign").cast("long")).alias("n_docs"),
                                             F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens"))
        summed.write.mode("overwrite").parquet(self._folder(batch))
        return True

    def totals(self) -> DataFrame:
        done = [self._folder(b) for b in self.committed()]
        schema = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
        rows = self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")
