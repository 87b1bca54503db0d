"""What the training-data operators share: table access, the shared folder, written cuts of lineage."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.operators.storage import shared_dir

#: ASCII white space as the contracts spell it; everything between is a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/dapple/{label}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here and
    survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stash`` that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files and "/dapple/" in files[0]:
            drop_path(df.sparkSession, files[0].rsplit("/", 1)[0])


def let_go(spark: SparkSession) -> None:
    """Collects what nothing refers to any more on the driver, plans, generated classes and broadcasts among
    it: Spark drops a broadcast or a shuffle when its handle is collected, which a long session puts off."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a written table, to be broadcast if it has at most ``rows`` rows, else for a sort-merge join."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes that a batch for a Python task may have, but for a single longer row.
BATCH_BYTES = 16 << 20


def batch_rows(spark: SparkSession, rows: int = 1000) -> None:
    """How much Python tasks get at a time: ``BATCH_BYTES`` at most, so whole texts are bounded, and ``rows``.

    It holds for what runs from then on; who asks for other rows runs its jobs at once and calls this again.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def held_out(remainder_of: int) -> Column:
    """crc32 of the doc_id written as text, modulo ``remainder_of``, is 2; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % remainder_of == 2


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
