"""Token counts as rollups that signed deltas maintain.

A batch is a list of changes: inserts, deletes and revised counts of documents under a tokenizer version.
Committing it writes two things below the rollup's folder: the ledger rows (the count a document has
from this batch on) and the signed sums per source, language and version. Totals are the sum of
the committed deltas; nothing is recounted.

    ledger/<batch>/   doc_id, tokenizer, source, lang, n_tokens (null once deleted), batch
    deltas/<batch>/   source, lang, tokenizer, n_docs, n_tokens (signed)
    commits/<batch>/  one row, written last: a batch is there if its commit is

A batch that is committed again is skipped. A batch that was cut short has no commit, so its files are
overwritten by the retry. Batches are committed one after the other by one writer.

Defined cases: an insert or revision of a document that is there replaces its count, source and language;
a delete of one that is not there, and any change without doc_id or tokenizer, changes nothing. Several changes of one
document and version in a batch: the highest ``seq`` holds; among equal ones the last by op, source, lang,
count. Null source and language are groups of their own; a null count is 0. An empty batch commits empty deltas.
Groups whose documents are all gone keep a row of zeros in the deltas and are left out of the totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.llm.common import shuffle_files_dropped

GROUP = ("source", "lang", "tokenizer")
_LEDGER = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint, batch bigint"
_DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


class TokenRollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def committed(self) -> list[int]:
        """Numbers of the committed batches, from the names of their commits."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        files = root.getFileSystem(sc._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        done = [s.getPath() for s in files.listStatus(root) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("batch=")) for p in done)

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [self._path(kind, b) for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """``changes``: op (insert, delete, revise), seq, doc_id, source, lang, tokenizer, n_tokens.

        False if the batch was committed before. Runs jobs.
        """
        if batch in (done := self.committed()):
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} is older than the last committed one, {done[-1]}")
        with shuffle_files_dropped(self.spark):
            self._write(batch, changes)
        return True

    def _write(self, batch: int, changes: DataFrame) -> None:
        wanted = changes.where(F.col("doc_id").isNotNull() & F.col("tokenizer").isNotNull() & F.col("op").isin("insert", "delete", "revise"))
        value = F.struct("seq", "op", "source", "lang", "n_tokens")
        new = wanted.groupBy("doc_id", "tokenizer").agg(F.max(value).alias("new"))
        old = self.current().select("doc_id", "tokenizer", F.struct("source", "lang", "n_tokens").alias("old"))
        gone = F.col("new.op") == "delete"
        both = new.join(old, ["doc_id", "tokenizer"], "left").where(~gone | F.col("old").isNotNull())
        count = F.when(~gone, F.coalesce("new.n_tokens", F.lit(0)))
        both.select(
            "doc_id", "tokenizer",
            F.when(gone, F.col("old.source")).otherwise(F.col("new.source")).alias("source"),
            F.when(gone, F.col("old.lang")).otherwise(F.col("new.lang")).alias("lang"),
            count.cast("long").alias("n_tokens"),
            F.lit(batch).cast("long").alias("batch"),
            F.col("old"),
        ).write.mode("overwrite").parquet(self._path("ledger", batch))

        # the signed rows come from what was written, so a lost executor can not make the two differ
        written = self.spark.read.parquet(self._path("ledger", batch))
        minus = F.when(F.col("old").isNotNull(), F.struct("old.source", "old.lang", "tokenizer", F.lit(-1).cast("long").alias("d"), (-F.col("old.n_tokens")).alias("t")))
        plus = F.when(F.col("n_tokens").isNotNull(), F.struct("source", "lang", "tokenizer", F.lit(1).cast("long").alias("d"), F.col("n_tokens").alias("t")))
        signed = written.select(F.explode(F.array_compact(F.array(minus, plus))).alias("x")).select("x.*")
        deltas = signed.groupBy(*GROUP).agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"))
        deltas.coalesce(1).write.mode("overwrite").parquet(self._path("deltas", batch))
        self.spark.range(1).select(F.lit(batch).alias("batch")).coalesce(1).write.mode("overwrite").parquet(self._path("commits", batch))

    def current(self) -> DataFrame:
        """The ledger's present rows: doc_id, tokenizer, source, lang, n_tokens."""
        rows = self._read("ledger", _LEDGER)
        newest = rows.groupBy("doc_id", "tokenizer").agg(F.max_by(F.struct("source", "lang", "n_tokens"), "batch").alias("v"))
        return newest.select("doc_id", "tokenizer", "v.*").where(F.col("n_tokens").isNotNull())

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        sums = self._read("deltas", _DELTA).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))
