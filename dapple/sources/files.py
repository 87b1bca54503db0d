"""Sources and sinks: file inventories, text of several formats, JSON lines with aliases, canonical export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_FORMATS = ("txt", "md", "csv", "json", "jsonl", "html", "htm", "xml", "yaml", "yml")
SYSTEM_PARTS = r"/(\.git|__pycache__|\.DS_Store|node_modules)(/|$)"
_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-1: a row for each file below a folder, but for system files: path, size, changed, extension, mode.

    Contents are not read: the column is pruned.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = extension(F.col("path"))
    mode = F.when(ext.isin(*TEXT_FORMATS), "text").when(ext.isin("pdf", "docx", "xlsx", "pptx"), "office").otherwise("binary")
    return files.filter(~F.col("path").rlike(SYSTEM_PARTS)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"), ext.alias("extension"), mode.alias("mode"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-2, SRC-5: path, status, text. Statuses: indexed, empty, ocr_required (scans), not_text.

    Bytes that are not valid UTF-8 are replaced; HTML and XML lose their tags.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(~F.col("path").rlike(SYSTEM_PARTS))
    ext = extension(F.col("path"))
    raw = F.when(ext.isin(*TEXT_FORMATS), F.make_valid_utf8(F.col("content").cast("string")))
    plain = F.when(ext.isin("html", "htm", "xml"), F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " "))).otherwise(raw)
    magic = F.hex(F.substring("content", 1, 4))
    status = F.when(plain.isNull(), F.when(magic.isin("89504E47", "FFD8FFE0", "25504446"), "ocr_required").otherwise("not_text")).when(F.trim(plain) == "", "empty").otherwise("indexed")
    return files.select("path", status.alias("status"), plain.alias("text"))


def json_lines(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """SRC-7, SRC-8, PRJ-3: records with named columns from the first alias that is filled, and the lines that do not parse."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    # names may differ in case only, so records are maps and not structs
    rows = lines.select("value", F.from_json("value", "map<string,string>").alias("r"))
    filled = lambda n: F.nullif(F.trim(F.try_element_at("r", F.lit(n))), F.lit(""))
    good = rows.filter("r IS NOT NULL").select(*[F.coalesce(*[filled(a) for a in xs]).alias(c) for c, xs in aliases.items()])
    return good, rows.filter("r IS NULL").select("value")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: CSV with a header, a byte order mark allowed, all columns text."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def table_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """SRC-11: (key, row, cells) of the table rows in HTML."""
    row = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    clean = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " ")))
    return pages.select(key, F.posexplode(row).alias("row", "tr")).select(key, "row", clean.alias("cells"))


def table_entities(pages: DataFrame, name: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """STR-9: (key, place, sequence, name, context) of the table rows that hold a name.

    ``name`` is a pattern for a whole cell; the first cell of a row that fits is its name. The sequence is the
    first cell, if it is a number and not the name; the context is the text of the last heading before the row,
    or else ''. Places count headings and rows from 0. Pages that are null or have no rows give none.
    """
    part = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>|<tr\b[^>]*>.*?</tr>"), F.lit(0))
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    is_row = lambda x: F.lower(F.left(x, F.lit(3))) == "<tr"
    first = F.struct(F.lit("").alias("context"), F.from_json(F.lit("[]"), "array<struct<context:string,tr:string>>").alias("rows"))

    def carry(acc: Column, x: Column) -> Column:
        row = F.struct(acc["context"].alias("context"), F.when(is_row(x), x).alias("tr"))
        return F.struct(F.when(is_row(x), acc["context"]).otherwise(bare(x)).alias("context"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    rows = pages.select(key, F.posexplode(F.aggregate(part, first, carry)["rows"]).alias("place", "r")).select(key, "place", "r.*").filter("tr IS NOT NULL")
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: bare(c))
    held = rows.select(key, "place", "context", cells.alias("cells")).withColumn("name", F.get(F.filter("cells", lambda c: c.rlike(f"^(?:{name})$")), F.lit(0))).filter("name IS NOT NULL")
    lead = F.get("cells", F.lit(0))
    return held.select(key, "place", F.when((lead != F.col("name")) & lead.rlike("^[0-9]{1,9}$"), lead.cast("int")).alias("sequence"), "name", "context")


def json_entities(rows: DataFrame, key: str, text: str, fields: dict[str, tuple[str, ...]], containers: tuple[str, ...] = ("records", "data", "items", "rows")) -> DataFrame:
    """JSN-2: (key, place, one column for each field) of the records in JSON texts.

    A list is its records; an object that holds a list under one of ``containers`` is that list's, the first of
    them in order; any other object is one record. A field is the first of its names that a record has with a
    value that is neither null nor blank, as text. Records without the first field, and texts that are no JSON,
    give nothing.
    """
    read = rows.select(key, F.try_parse_json(text).alias("v")).filter("v IS NOT NULL")
    listed = lambda path: F.try_variant_get("v", path, "array<variant>")
    found = F.coalesce(listed("$"), *[listed(f"$.{c}") for c in containers], F.array("v"))
    each = read.select(key, F.posexplode(found).alias("place", "r"))
    value = lambda name: F.nullif(F.trim(F.try_variant_get("r", f"$.{name}", "string")), F.lit(""))
    out = each.select(key, "place", *[F.coalesce(*[value(n) for n in names]).alias(f) for f, names in fields.items()])
    return out.filter(F.col(next(iter(fields))).isNotNull())


def markdown_table(text: Column, heading: str) -> Column:
    """SRC-12: the cells of the pipe table under a heading, row by row, without the ruler."""
    block = F.regexp_extract(text, rf"(?m)^#+\s*{heading}\s*$\n+((?:^\|.*$\n?)+)", 1)
    rows = F.filter(F.split(block, "\n"), lambda r: r.startswith("|") & ~r.rlike(r"^\|[\s:|-]+$"))
    return F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\||\|\s*$", ""), r"\|"), lambda c: F.trim(c)))


def canonical_json(rows: DataFrame) -> DataFrame:
    """SNK-3: one JSON text a row, keys in order, nulls left out."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)])).alias("value"))


def export_csv(rows: DataFrame, path: str, order: Sequence[str]) -> None:
    """SNK-2: ordered CSV files with a header, quotes doubled as ``csv_rows`` reads them; the order runs through the part files."""
    rows.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_json_lines(rows: DataFrame, path: str, order: Sequence[str]) -> None:
    """SNK-2: ordered JSON lines, canonical."""
    canonical_json(rows.orderBy(*order)).write.mode("overwrite").text(path)


def export_markdown(rows: DataFrame, path: str, order: Sequence[str]) -> None:
    """SNK-2: ordered rows of pipe tables; each part file begins with the header."""
    names = rows.columns
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"[|\n]", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in names]), F.lit(" |")).alias("value")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(line, F.monotonically_increasing_id().alias("n"))
    first = F.col("n") == F.shiftleft(F.spark_partition_id().cast("long"), 33)
    head = [F.lit(f"| {' | '.join(names)} |"), F.lit("|" + "---|" * len(names))]
    lines = F.when(first, F.array(*head, F.col("value"))).otherwise(F.array("value"))
    dealt.select(F.explode(lines).alias("value")).write.mode("overwrite").text(path)
