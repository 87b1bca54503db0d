"""Licence scan by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form (lower case, equivalent spellings, copyright lines and
punctuation gone, single spaces) and its SHA-256 is hash-joined to the digests of known licences in
the same form. The whole text is looked up, and so is each of its lines and each block of lines
between lines without letters and digits, so licence statements within a document are found as well;
a statement must be an entire line, block or text. A text is normalised once for all of these.

The known texts are the whole public licences in ``licence_texts`` (by SPDX name; those of a page or
less also under a heading) and short public statements, ``STATEMENTS``; ``known`` takes more as a table
of (licence, text). That table is broadcast only while its rows stay within ``BROADCAST_ROWS``.
Lines are reduced to distinct digests before the join, so a line that a third of all rows hold
meets the known digests once per task.

Defined cases: null and empty texts match nothing; repeated rows each keep their result row; a text
that several names share gives the first name in order; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.llm.common import stash, table, text_of

BROADCAST_ROWS = 100_000

#: Short public licence statements by SPDX name.
STATEMENTS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Headings under which short licences stand.
HEADINGS = {"MIT": ("MIT License", "The MIT License (MIT)", "The MIT License"), "ISC": ("ISC License",), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",), "Zlib": ("zlib License",), "0BSD": ("BSD Zero Clause License",)}


def _whole_licences() -> Iterator[tuple[str, str]]:
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        yield path.stem, text
        for heading in HEADINGS.get(path.stem, ()):
            yield path.stem, f"{heading}\n\n{text}"


LICENCES = (*STATEMENTS, *_whole_licences())

#: Spellings that count as one, as words of the canonical form.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("labour", "labor"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("version", "v"),
    ("https", "http"),
)
#: What a copyright line has after signs at its start: the word with a sign or year, the sign with a year, the usual formula.
COPYRIGHT = r"copyright\s*(?:\(c\)|©|:|by\b)|copyright\b[^\n]*\b[12][0-9]{3}\b|(?:\(c\)|©)\s*(?:copyright\b|[12][0-9]{3}\b)|all rights reserved"
COPYRIGHT_LINE = rf"(?m)^[^\p{{L}}\p{{N}}\n©(]*+(?:{COPYRIGHT})[^\n]*+$"


#: In a marked text: stands for a copyright line, which goes, but leaves its place a line.
GONE = "\x01"


def marked(text: Column) -> Column:
    """A text in lower case, with lines as they are, two spaces for each run of other signs, single words respelt."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, GONE)
    out = F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}\n{GONE}]++", "  ")
    # every word has spaces of its own on both sides, so neighbours are respelt alike
    out = F.concat(F.lit(" "), F.replace(out, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new} "))
    return out


def finished(part: Column) -> Column:
    """The canonical form of a part of a marked text: words with single spaces; '' if nothing is left."""
    out = F.regexp_replace(part, rf"[\x20\n{GONE}]++", " ")
    for old, new in SPELLINGS:
        if " " in old:  # across lines
            out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def canonical(text: Column) -> Column:
    """The canonical form; '' if nothing is left."""
    return finished(marked(text))


def digest(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.unhex(F.sha2(text, 256)))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, licence), one row for each digest."""
    rows = spark.createDataFrame(LICENCES, "licence string, text string")
    rows = rows if known is None else rows.unionByName(known.select("licence", "text"))
    got = rows.select("licence", digest(canonical(F.col("text"))).alias("digest")).filter("digest IS NOT NULL")
    return got.groupBy("digest").agg(F.min("licence").alias("licence"))


def units_of(text: Column) -> Column:
    """Of a marked text the whole, then its blocks and lines where it has several; each with its kind."""

    def kind(name: str, parts: Column, least: int) -> Column:
        parts = F.filter(parts, lambda p: F.length(F.trim(F.replace(p, F.lit("\n"), F.lit(" ")))) > 0) if least > 1 else parts
        return F.transform(F.when(F.size(parts) >= least, parts).otherwise(F.slice(parts, 1, 0)), lambda p: F.struct(F.lit(name).alias("unit"), p.alias("part")))

    return F.concat(kind("text", F.array(text), 1), kind("block", F.split(text, r"\n\x20*(?:\n\x20*)+"), 2), kind("line", F.split(text, r"\n"), 2))


def scan_licences(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, whole (licence of the entire text), licences (of all units, distinct, in order), n_units (that match)."""
    digests = stash(known_digests(docs.sparkSession, known), "licence-digests")
    side = F.broadcast(digests) if digests.count() <= BROADCAST_ROWS else digests
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", marked(text_of()).alias("text"))
    units = rows.select("rid", "doc_id", F.explode(units_of(F.col("text"))).alias("u"))
    units = units.select("rid", "doc_id", F.col("u.unit").alias("unit"), finished(F.col("u.part")).alias("form"))
    hits = units.select("rid", "doc_id", "unit", digest(F.col("form")).alias("digest")).join(side, "digest", "left")
    # sums over the units of a document are made where it was read; one row a document is shuffled
    out = hits.groupBy("rid", "doc_id").agg(
        F.min(F.when(F.col("unit") == "text", F.col("licence"))).alias("whole"),
        F.array_sort(F.collect_set("licence")).alias("licences"),
        F.count("licence").alias("n_units"),
    )
    return out.drop("rid")


def op3_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.coalesce("whole", F.lit("")).alias("whole"), F.array_join("licences", ",").alias("licences"), "n_units")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(lower({text}), '(?m)^[^\\p{{L}}\\p{{N}}\\n©(]*(?:{COPYRIGHT})[^\\n]*$', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g'))"
    out = f"'  ' || {out} || '  '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {new} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


ORACLE = f"""
WITH known AS (
  SELECT {_canonical_sql("t")} AS form, min(l) AS licence
  FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in LICENCES)}) AS v(l, t) GROUP BY 1
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), parts AS (
  SELECT rid, 'text' AS unit, [text] AS p FROM docs
  UNION ALL SELECT rid, 'block', list_filter(regexp_split_to_array(text, '\n(?:[^\\p{{L}}\\p{{N}}©\n]*\n)+'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}©]')) FROM docs
  UNION ALL SELECT rid, 'line', list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}©]')) FROM docs
), units AS (
  SELECT rid, unit, unnest(p) AS part FROM parts WHERE unit = 'text' OR len(p) >= 2
), hits AS (
  SELECT u.rid, u.unit, k.licence FROM units u JOIN known k ON k.form = {_canonical_sql("u.part")} WHERE k.form <> ''
)
SELECT d.doc_id, coalesce(min(CASE WHEN h.unit = 'text' THEN h.licence END), '') AS whole,
  coalesce(string_agg(DISTINCT h.licence, ',' ORDER BY h.licence), '') AS licences, count(h.licence) AS n_units
FROM docs d LEFT JOIN hits h ON d.rid = h.rid GROUP BY d.rid, d.doc_id
"""
