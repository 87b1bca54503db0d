"""Sources, sinks and streams as queries: what is derived from the driver tables is written out and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dapple.operators.storage import DeltaTable, current_table, fresh_path, replace_table
from dapple.plans.registry import Tables, query
from dapple.sources import files as src
from dapple.streaming import ingest


def nations(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", "n_name", "n_regionkey")


@query("src1_inventory", "SELECT 'csv' AS extension, 'text' AS mode, count(DISTINCT n_regionkey) AS files, true AS sized FROM nation UNION ALL SELECT 'parquet', 'binary', count(DISTINCT c_mktsegment), true FROM customer")
def _(t: Tables) -> DataFrame:
    """SRC-1: the files below a folder, of which each key of a table has one."""
    folder = fresh_path(t.spark, "inbox")
    nations(t).repartition("n_regionkey").write.partitionBy("n_regionkey").csv(f"{folder}/nations")
    t.customer.repartition("c_mktsegment").write.partitionBy("c_mktsegment").option("compression", "none").parquet(f"{folder}/deep/er/customers")
    found = src.inventory(t.spark, folder).filter(~F.col("path").rlike(r"/[_.][^/]*$"))
    return found.groupBy("extension", "mode").agg(F.count("*").alias("files"), F.every(F.col("size") > 0).alias("sized"))


@query("src2_5_texts", "SELECT c_mktsegment AS segment, 'indexed' AS status, count(*) AS lines, (sum(length(c_name)) + count(*))::BIGINT AS chars FROM customer GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """SRC-2, SRC-5: whole files as texts, a file for each market segment."""
    folder = fresh_path(t.spark, "texts")
    t.customer.select("c_mktsegment", "c_name").repartition("c_mktsegment").write.partitionBy("c_mktsegment").text(folder)
    got = src.texts(t.spark, folder).filter(F.col("path").endswith(".txt"))
    return got.select(F.regexp_extract("path", "c_mktsegment=([^/]+)", 1).alias("segment"), "status", F.regexp_count("text", F.lit("\n")).cast("long").alias("lines"), F.length("text").cast("long").alias("chars"))


@query("src7_8_json_lines", "SELECT c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'n' || c_nationkey END AS place FROM customer")
def _(t: Tables) -> DataFrame:
    """SRC-7, SRC-8: JSON lines whose columns have several names, some filled with blanks; broken lines are set aside."""
    path = fresh_path(t.spark, "jsonl")
    even = F.col("c_custkey") % 2 == 0
    rows = t.customer.select(F.col("c_custkey").alias("ID"), F.when(even, F.col("c_name")).alias("title"), F.when(~even, F.col("c_name")).alias("name"), F.when(even, F.col("c_mktsegment")).otherwise("  ").alias("region"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("place"))
    lines = src.canonical_json(rows).unionByName(t.region.select(F.concat(F.lit('{"ID": '), F.col("r_name")).alias("value")))
    lines.write.text(path)
    good, _ = src.json_lines(t.spark, path, {"id": ("id", "ID"), "name": ("name", "title"), "place": ("region", "place")})
    return good


@query("src9_csv", """SELECT p_partkey::VARCHAR AS p_partkey, 'say "' || p_name || '", ' || chr(10) || p_brand AS note, p_size::VARCHAR AS p_size FROM part""")
def _(t: Tables) -> DataFrame:
    """SRC-9, SNK-2: CSV with quotes, commas and line breaks in its fields, written in order and read back."""
    path = fresh_path(t.spark, "csv")
    rows = t.part.select("p_partkey", F.concat(F.lit('say "'), "p_name", F.lit('", \n'), "p_brand").alias("note"), "p_size")
    src.export_csv(rows, path, ["p_partkey"])
    return src.csv_rows(t.spark, path)


@query("src12_markdown_table", "SELECT l_orderkey, l_linenumber::VARCHAR AS line, 'part ' || l_partkey AS part FROM lineitem")
def _(t: Tables) -> DataFrame:
    """SRC-12: the table under a heading, out of documents with two tables each."""
    line = F.concat(F.lit("| "), F.col("l_linenumber").cast("string"), F.lit(" |  part "), F.col("l_partkey").cast("string"), F.lit("|"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("rows"))
    text = F.concat(F.lit("# Order\n\n| x | y |\n|---|---|\n| 0 | none |\n\n## Lines\n\n| line | part |\n|:--|--:|\n"), "rows", F.lit("\n\nend"))
    table = rows.select("l_orderkey", F.posexplode(src.markdown_table(text, "Lines")).alias("i", "cells")).filter("i > 0")
    return table.select("l_orderkey", F.get("cells", F.lit(0)).alias("line"), F.get("cells", F.lit(1)).alias("part"))


@query("snk1_swapped_table", "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """SNK-1: a table built beside the one in force and put in its place whole."""
    folder = fresh_path(t.spark, "swapped")
    replace_table(t.part.groupBy("p_brand").agg(F.count("*").alias("n")), folder)
    replace_table(t.part.filter("p_size > 25").groupBy("p_brand").agg(F.count("*").alias("n")), folder)
    return current_table(t.spark, folder)


@query("snk4_delta_table", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 1 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 11 <> 2 OR c_custkey % 9 = 1")
def _(t: Tables) -> DataFrame:
    """SNK-4: a keyed table to which signed changes are committed: rows that go, then rows that come or change."""
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_nationkey")
    table = DeltaTable(t.spark, fresh_path(t.spark, "delta"), ["c_custkey"])
    table.create(rows)
    table.apply(rows.limit(0), rows.filter("c_custkey % 11 = 2").select("c_custkey"))
    table.apply(rows.filter("c_custkey % 9 = 1").withColumn("c_mktsegment", F.lit("MOVED")))
    return table.read()


@query("snk2_markdown", "SELECT '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS value FROM nation")
def _(t: Tables) -> DataFrame:
    """SNK-2: pipe tables in order; each part file begins with its header."""
    path = fresh_path(t.spark, "markdown")
    src.export_markdown(nations(t), path, ["n_nationkey"])
    return t.spark.read.text(path).filter(r"value RLIKE '^\\| [0-9]'")


@query("snk3_canonical_json", """SELECT '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"' || CASE WHEN c_nationkey % 5 > 0 THEN ',"c_nationkey":' || c_nationkey ELSE '' END || '}' AS value FROM customer""")
def _(t: Tables) -> DataFrame:
    """SNK-3, SNK-2: one JSON text a row, keys in order, nulls left out; written as lines and read back."""
    path = fresh_path(t.spark, "canonical")
    rows = t.customer.select(F.when(F.col("c_nationkey") % 5 > 0, F.col("c_nationkey")).alias("c_nationkey"), "c_mktsegment", "c_custkey")
    src.export_json_lines(rows, path, ["c_custkey"])
    return t.spark.read.text(path)


@query("src15_stm2_3_ingest", "SELECT event_type, 'good' AS side, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE value >= 5 GROUP BY 1 UNION ALL SELECT event_type, 'dead', count(*), sum(event_id)::BIGINT FROM events WHERE value < 5 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """SRC-15, STM-2, STM-3, STM-4: an inbox read as a stream; it is stopped, files come in, and it goes on at its checkpoint."""
    base = fresh_path(t.spark, "stream")
    rows = t.events.select("event_id", "event_type", "value")
    schema = "event_id long, event_type string, value double"

    def go() -> None:
        stream = ingest.file_stream(t.spark, f"{base}/inbox", schema, per_batch=4)
        ingest.start_ingest(stream, f"{base}/good", f"{base}/dead", f"{base}/checkpoint", "value >= 5").awaitTermination()

    for part in (0, 1):
        rows.filter(F.col("event_id") % 2 == part).repartition(6, "event_id").write.mode("append").json(f"{base}/inbox")
        go()
    go()  # nothing new: nothing is taken twice
    side = lambda name: t.spark.read.schema(schema).parquet(f"{base}/{name}").withColumn("side", F.lit(name))
    return side("good").unionByName(side("dead")).groupBy("event_type", "side").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("stm5_changed", """
WITH b AS (SELECT c_custkey AS k, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS v FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), a AS (SELECT o_custkey AS k, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS v FROM orders GROUP BY 1)
SELECT a.k, a.v FROM a LEFT JOIN b ON a.k = b.k WHERE b.k IS NULL OR a.v <> b.v""")
def _(t: Tables) -> DataFrame:
    """STM-5: the keys whose content is new or differs from an earlier state."""
    state = lambda rows: rows.groupBy(F.col("o_custkey").alias("k")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("v"))
    return ingest.changed_cells(state(t.orders.filter("o_orderdate < TIMESTAMP_NTZ '1997-01-01'")), state(t.orders), ["k"], "v")
