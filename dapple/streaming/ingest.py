"""Structured Streaming: windows over event time with late data, idempotent ingestion, dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """STM-1 (beyond the reference): counts by window and key; events later than ``late`` behind the newest go."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each key that end after a gap."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def start_ingest(stream: DataFrame, path: str, dead: str, checkpoint: str, good: str) -> StreamingQuery:
    """STM-2, STM-3, STM-4: rows that meet ``good`` go to ``path``, others to ``dead``.

    A batch is written under its number, so a batch that is run again after a failure replaces
    itself; the checkpoint holds what was read.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_ok", F.coalesce(F.expr(good), F.lit(False)))
        rows.filter("_ok").drop("_ok").write.mode("overwrite").parquet(f"{path}/batch={number}")
        rows.filter("NOT _ok").drop("_ok").write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_cells(before: DataFrame, after: DataFrame, keys: list[str], content: str) -> DataFrame:
    """STM-5: the keys whose content is new or differs, which is what has to be compiled again."""
    old = before.select(*keys, F.col(content).alias("_old"), F.lit(True).alias("_has"))
    return after.join(old, keys, "left").filter(F.col("_has").isNull() | ~F.col(content).eqNullSafe(F.col("_old"))).select(*after.columns)


def file_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "json", per_batch: int = 100) -> DataFrame:
    """SRC-15: an inbox folder as a stream; each file is taken once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(fmt).load(folder)
