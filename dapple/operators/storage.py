"""Written tables in the folder that driver and executors share: cuts of lineage, stored indexes, swapped tables."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local session without it gets a folder under /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        base = "file://" + tempfile.mkdtemp(prefix="dapple-", dir="/tmp/checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/dapple-tables/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written out and read back: its lineage ends here and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_table(rows: DataFrame, folder: str) -> str:
    """SNK-1, SNK-4: a new version of a table, which readers see whole or not at all.

    The version goes to a folder of its own; then a pointer file is put in place of the old one by a
    rename, which is one step. A job that breaks off leaves the old version in force.
    """
    spark = rows.sparkSession
    version = f"v-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(f"{folder}/{version}")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    draft, pointer = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}") for name in (f"_draft-{version}", "current"))
    fs = pointer.getFileSystem(conf)
    out = fs.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), conf)
    overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(draft, pointer, options)
    return version


def current_table(spark: SparkSession, folder: str) -> DataFrame:
    """The version of a table of ``replace_table`` that is in force."""
    version = spark.read.format("binaryFile").load(f"{folder}/current").select("content").first()["content"].decode()
    return spark.read.parquet(f"{folder}/{version}")


def files_state(df: DataFrame) -> tuple:
    """Path, length and time of the last change of each file of a table: another state if the table was replaced."""
    spark = df.sparkSession
    conf, out = spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in sorted(df.inputFiles()):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


class Conflict(RuntimeError):
    """Another writer took the commit first."""


class CommitLog:
    """Numbered commits in a folder, each a small JSON file; a number can be taken once.

    A commit appears whole, by a rename that does not replace, so of two writers that began from the same
    state one fails, and what a broken-off writer left behind is in no commit.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder}/log"
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def numbers(self) -> list[int]:
        folder = self.path("")
        fs = folder.getFileSystem(self.conf)
        if not fs.exists(folder):
            return []
        return sorted(int(name[:8]) for f in fs.listStatus(folder) if (name := f.getPath().getName()).endswith(".json") and name[:8].isdigit())

    def read(self, number: int) -> dict:
        path = self.path(f"{number:08d}.json")
        file = path.getFileSystem(self.conf).open(path)
        try:
            return json.loads(bytes(file.readAllBytes()))
        finally:
            file.close()

    def latest(self) -> tuple[int, dict]:
        """The last commit and its number; 0 and nothing where there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def commit(self, number: int, entry: dict) -> None:
        draft, final = self.path(f"draft-{uuid.uuid4().hex}"), self.path(f"{number:08d}.json")
        out = draft.getFileSystem(self.conf).create(draft, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, final, options)
        except Exception as error:
            draft.getFileSystem(self.conf).delete(draft, False)
            if "already exists" in str(error).lower() or "alreadyexists" in str(error).lower():
                raise Conflict(f"commit {number} of {self.folder} is taken") from None
            raise


def folder_bytes(spark: SparkSession, folder: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


class DeltaTable:
    """SNK-4: a keyed table as a base and small signed changes to it, each written once and committed whole.

    A change is a file of rows that replace those of their key, and of keys that go. A reader takes, of each
    key, the row of the latest change; changes are folded into a new base when they hold more than ``fold`` of
    its rows. A writer gives the commit it began from, and fails with ``Conflict`` if another came first.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], fold: float = 0.25):
        self.spark, self.folder, self.keys, self.fold = spark, folder, list(keys), fold
        self.log = CommitLog(spark, folder)

    @property
    def version(self) -> int:
        return self.log.latest()[0]

    def write(self, rows: DataFrame, seq: int) -> dict:
        name = f"part-{seq:08d}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.folder}/{name}")
        written = self.spark.read.parquet(f"{self.folder}/{name}")
        return {"name": name, "seq": seq, "rows": written.count()}

    def merged(self, parts: list[dict]) -> DataFrame:
        """The rows of some parts, the latest of each key, those that are gone too."""
        out = None
        for p in parts:
            rows = self.spark.read.parquet(f"{self.folder}/{p['name']}").withColumn("_seq", F.lit(p["seq"]))
            out = rows if out is None else out.unionByName(rows)
        if len(parts) == 1:
            return out.drop("_seq")
        values = [c for c in out.columns if c not in self.keys and c != "_seq"]
        latest = out.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_seq").alias("_last"))
        return latest.select(*self.keys, "_last.*")

    def read(self, version: int | None = None) -> DataFrame:
        state = self.log.latest()[1] if version is None else self.log.read(version)
        return self.merged(state["parts"]).filter("NOT _gone").drop("_gone")

    def create(self, rows: DataFrame) -> int:
        """The first commit; ``rows`` have one row for each key."""
        self.log.commit(1, {"parts": [self.write(rows.withColumn("_gone", F.lit(False)), 1)]})
        return 1

    def apply(self, changed: DataFrame, gone: DataFrame | None = None, since: int | None = None) -> int:
        """A change on top of commit ``since``, by default the last: rows by key and keys that go. The new commit."""
        now, state = self.log.latest()
        if since is not None and since != now:
            raise Conflict(f"commit {since} is not the last of {self.folder}")
        names = [c for c in changed.columns if c not in self.keys]
        rows = changed.withColumn("_gone", F.lit(False))
        if gone is not None:
            empty = [F.lit(None).cast(changed.schema[c].dataType).alias(c) for c in names]
            left = gone.select(*self.keys).distinct().join(changed.select(*self.keys), self.keys, "left_anti")
            rows = rows.unionByName(left.select(*self.keys, *empty, F.lit(True).alias("_gone")))
        parts = [*state["parts"], self.write(rows, now + 1)]
        if sum(p["rows"] for p in parts[1:]) > self.fold * max(1, parts[0]["rows"]):
            parts = [self.write(self.merged(parts).filter("NOT _gone"), now + 1)]
        self.log.commit(now + 1, {"parts": parts})
        return now + 1
