"""Token counts as delta-maintained rollups.

Batches of events (inserts, deletes, revised counts) become signed rows; a batch is summed by source,
language and tokenizer version and written under its own name. A batch whose success marker is there
is not written again, and a batch that broke off is written anew in full, so committing twice adds
once. The totals are sums over all batches.

Events: kind (insert, delete, revise), source, lang, tokenizer, n_tokens (of a delete: the count that
goes), old_tokens (of a revise: the count before). Sums are made before the shuffle, so a source
with a third of all rows is a few rows a task.

Defined cases: null source, lang or tokenizer are groups of their own; null counts are 0; an unknown
kind raises an error when read; an empty batch is a commit without rows; totals without documents
and without tokens are left out; other columns of the events are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.llm.common import WORD, fresh_path, stash, table, text_of

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Tokenizer versions by name: what counts as a token.
TOKENIZERS = {"words-1": WORD, "letters-2": "[A-Za-z]+|[0-9]+"}


def signed(events: DataFrame) -> DataFrame:
    kind, n, old = F.col("kind"), F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    bad = F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce(kind, F.lit("null"))))
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(bad.cast("int"))
    tokens = F.when(kind == "insert", n).when(kind == "delete", -n).otherwise(n - old)
    return events.select(*KEYS, docs.cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """The batches under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Paths of the whole batches."""
        if not self.fs.exists(self.path(self.folder)):
            return []
        found = [str(x.getPath()) for x in self.fs.listStatus(self.path(self.folder)) if x.isDirectory()]
        return sorted(p for p in found if self.fs.exists(self.path(f"{p}/_SUCCESS")))

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Adds the batch; False, and nothing changes, if it is there already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        path = f"{self.folder}/batch-{batch}"
        if self.fs.exists(self.path(f"{path}/_SUCCESS")):
            return False
        summed(signed(events)).write.mode("overwrite").parquet(path)
        return True

    def totals(self) -> DataFrame:
        paths = self.committed()
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return summed(rows).filter("n_docs <> 0 OR n_tokens <> 0")


def token_count(version: str, text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKENIZERS[version])).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """A row for each document: its counts by tokenizer version, before and after repeated lines go."""
    text = text_of()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    lines = F.split("text", "\n")
    rows = rows.select("*", F.when(F.contains("text", F.lit("\n")), lines).alias("lines")).select("*", F.array_distinct("lines").alias("kept"))
    kept = F.when(F.size("kept") < F.size("lines"), F.array_join("kept", "\n"))
    rows = rows.select("rid", "doc_id", "source", "lang", "text", kept.alias("kept")).select("*", F.sha2("text", 256).alias("digest"))
    counts = [F.struct(F.lit(v).alias("tokenizer"), token_count(v, F.col("text")).alias("n_tokens"), token_count(v, F.col("kept")).alias("kept_tokens")) for v in TOKENIZERS]
    return rows.select("rid", "doc_id", "source", "lang", F.unhex("digest").alias("digest"), F.array(*counts).alias("counts"))


def corpus_events(docs: DataFrame) -> dict[str, DataFrame]:
    """Three batches: all documents come; repeated lines of a document go, which revises its counts;
    exact copies of a text go, but for the row with the smallest doc_id."""
    rows = stash(counted(docs), "rollup-rows")
    each = rows.select("rid", "digest", "source", "lang", F.explode("counts").alias("c")).select("rid", "digest", "source", "lang", "c.*")
    now = F.coalesce("kept_tokens", "n_tokens")
    first = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "rid")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = each.join(first, "digest").filter(F.col("rid") != F.col("first.rid"))
    blank = F.lit(None).cast("long").alias("old_tokens")
    return {
        "load": each.select(F.lit("insert").alias("kind"), *KEYS, "n_tokens", blank),
        "repeated-lines": each.filter("kept_tokens IS NOT NULL").select(F.lit("revise").alias("kind"), *KEYS, F.col("kept_tokens").alias("n_tokens"), F.col("n_tokens").alias("old_tokens")),
        "copies": copies.select(F.lit("delete").alias("kind"), *KEYS, now.alias("n_tokens"), blank),
    }


def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three batches are committed, one of them twice."""
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    batches = corpus_events(table(spark, sf_dir, "documents"))
    for name in ("load", "repeated-lines", "copies", "repeated-lines"):
        rollup.commit(name, batches[name])
    return rollup.totals()


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id NULLS FIRST) AS place, source, lang,
    array_to_string(list_transform(list_filter(list_transform(range(1, len(l) + 1), lambda i: {'i': i, 'x': l[i]}), lambda s: list_position(l, s.x) = s.i), lambda s: s.x), chr(10)) AS text
  FROM (SELECT doc_id, text, source, lang, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), counts AS (
  SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM docs WHERE place = 1
  UNION ALL
  SELECT source, lang, 'letters-2', len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+')) FROM docs WHERE place = 1
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM counts GROUP BY ALL
"""
