"""UPS-4: runs over many inputs with a ledger from which a broken-off run goes on.

An input's rows, good and rejected ones, are written first; then one commit of the ledger names them together
with their counts. So an input is in the ledger with all its rows or not at all: a run that breaks off leaves the
inputs it had finished, and the same run started again skips those and does the rest. What was written for an
input without a commit is never read.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.operators.storage import CommitLog, Conflict

ENTRY = "run string, input string, day string, status string, rows long, rejected long, path string, error string"


class RunLedger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.log = CommitLog(spark, folder)

    def entries(self) -> DataFrame:
        """One row for each input of each run."""
        if not self.log.numbers():
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).json(f"{self.folder}/log/*.json")

    def entry(self, run: str, name: str) -> dict | None:
        found = self.entries().filter((F.col("run") == run) & (F.col("input") == name)).limit(1).collect()
        return found[0].asDict() if found else None

    def put(self, entry: dict) -> dict:
        """Adds an entry; if another writer was quicker with the same input, that one's stands."""
        while True:
            numbers = self.log.numbers()
            try:
                self.log.commit(numbers[-1] + 1 if numbers else 1, entry)
                return entry
            except Conflict:
                own = self.entry(entry["run"], entry["input"])
                if own is not None:
                    return own

    def ingest(self, run: str, name: str, rows: DataFrame, problem: Column, day: str | None = None) -> dict:
        """Writes an input's rows and its entry. ``problem`` is null for good rows, else why a row is rejected.

        The status is success without rejected rows, failed if all are rejected, else partial. An input that the
        run has done is left as it is.
        """
        own = self.entry(run, name)
        if own is not None:
            return own
        path = f"batch-{uuid.uuid4().hex}"
        rows.withColumn("_problem", problem).write.parquet(f"{self.folder}/{path}")
        n, bad = self.spark.read.parquet(f"{self.folder}/{path}").agg(F.count("*"), F.count("_problem")).first()
        status = "success" if not bad else "failed" if bad == n else "partial"
        return self.put({"run": run, "input": name, "day": day or datetime.date.today().isoformat(), "status": status, "rows": n, "rejected": bad, "path": path, "error": None})

    def run(self, run: str, inputs: Mapping[str, Callable[[], DataFrame]] | Iterable[tuple[str, Callable[[], DataFrame]]], problem: Column, day: str | None = None) -> str:
        """Ingests all inputs that the run has not done; one that can't be read is entered as failed and the run goes on.

        A failed input is done too: another run takes it up again. The status of the run: success or failed if all inputs have that status, else partial.
        """
        pairs = inputs.items() if isinstance(inputs, Mapping) else inputs
        done = {r.input: r.status for r in self.entries().filter(F.col("run") == run).select("input", "status").collect()}
        seen = []
        for name, read in pairs:
            if name in done:
                seen.append(done[name])
                continue
            try:
                seen.append(self.ingest(run, name, read(), problem, day)["status"])
            except PySparkException as error:
                text = str(error).split("\n")[0][:500]
                seen.append(self.put({"run": run, "input": name, "day": day or datetime.date.today().isoformat(), "status": "failed", "rows": 0, "rejected": 0, "path": None, "error": text})["status"])
        return seen[0] if seen and len(set(seen)) == 1 else "partial" if seen else "success"

    def rows(self, rejected: bool = False) -> DataFrame:
        """All good rows of the ledger's inputs, or all rejected ones with their ``_problem``."""
        paths = [f"{self.folder}/{r.path}" for r in self.entries().filter("path IS NOT NULL").select("path").distinct().collect()]
        if not paths:
            raise ValueError(f"{self.folder} holds no batch yet")
        every = self.spark.read.option("mergeSchema", "true").parquet(*paths)
        return every.filter("_problem IS NOT NULL") if rejected else every.filter("_problem IS NULL").drop("_problem")

    def days(self) -> DataFrame:
        """The ledger by day: inputs, rows, rejected rows, failed inputs."""
        return self.entries().groupBy("day").agg(F.count("*").alias("inputs"), F.sum("rows").alias("rows"), F.sum("rejected").alias("rejected"), F.count_if(F.col("status") == "failed").alias("failed"))
