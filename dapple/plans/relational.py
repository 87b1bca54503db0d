"""Scans, filters, joins, aggregations, windows, sorts and set operations on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dapple.functions import text as T
from dapple.operators import dictionary as D
from dapple.operators import relational as R
from dapple.plans.registry import Tables, query


def year(c: str):
    return F.year(c).cast("long")


# filters ------------------------------------------------------------------------------------------


@query("flt1_prefix_scope", "SELECT page_id, url FROM pages WHERE url LIKE 'https://example.com/%' OR url LIKE 'https://site1%' OR url LIKE 'http://%'")
def _(t: Tables) -> DataFrame:
    """FLT-1: any of several path prefixes."""
    scopes = ("https://example.com/", "https://site1", "http://")
    some = F.lit(False)
    for s in scopes:
        some = some | F.col("url").startswith(s)
    return t.pages.filter(some).select("page_id", "url")


@query("flt2_escaped_contains", r"SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%e\_%' ESCAPE '\' OR p_name ILIKE '%al%' ESCAPE '\'")
def _(t: Tables) -> DataFrame:
    """FLT-2: contains, with the pattern's own signs escaped, whatever the case."""

    def contains(c: str, value: str):
        escaped = value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        return F.col(c).ilike(f"%{escaped}%") if value else F.lit(True)

    return t.part.filter(contains("p_name", "e_") | contains("p_name", "al")).select("p_partkey", "p_name")


@query("flt3_keyword_conjunction", "SELECT p_partkey FROM part WHERE (p_name ILIKE '%a%' OR p_type ILIKE '%a%' OR p_brand ILIKE '%a%') AND (p_name ILIKE '%1%' OR p_type ILIKE '%1%' OR p_brand ILIKE '%1%') AND p_size > 10")
def _(t: Tables) -> DataFrame:
    """FLT-3: each keyword in at least one of several columns, active rows only."""
    keep = F.col("p_size") > 10
    for word in ("a", "1"):
        hit = F.lit(False)
        for c in ("p_name", "p_type", "p_brand"):
            hit = hit | F.col(c).ilike(f"%{word}%")
        keep = keep & hit
    return t.part.filter(keep).select("p_partkey")


@query("flt4_hierarchical_region", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = (SELECT min(r_name) FROM region) OR n.n_name = (SELECT max(n_name) FROM nation)")
def _(t: Tables) -> DataFrame:
    """FLT-4: a place matches at any level of its hierarchy."""
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    asked = t.region.agg(F.min("r_name").alias("asked_r")).crossJoin(t.nation.agg(F.max("n_name").alias("asked_n")))
    places = places.crossJoin(F.broadcast(asked)).filter((F.col("r_name") == F.col("asked_r")) | (F.col("n_name") == F.col("asked_n")))
    return t.customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("flt5_verified_only", "SELECT doc_id FROM documents WHERE lower(text) NOT LIKE '%draft%' AND text NOT LIKE '%$$$%' AND (n_chars > 1000 OR source IN ('src1','src2'))")
def _(t: Tables) -> DataFrame:
    """FLT-5: none of the negative signs and one of the positive ones."""
    bad = F.lower("text").contains("draft") | F.col("text").contains("$$$")
    return t.documents.filter(~bad & ((F.col("n_chars") > 1000) | F.col("source").isin("src1", "src2"))).select("doc_id")


@query("flt6_tuple_in", "SELECT o_orderkey FROM orders WHERE (year(o_orderdate), o_orderstatus) IN ((1995, 'F'), (1996, 'O'), (1997, 'P'))")
def _(t: Tables) -> DataFrame:
    """FLT-6: pairs in a list; an empty list keeps nothing."""
    pairs = [(1995, "F"), (1996, "O"), (1997, "P")]
    keep = F.lit(False)
    for y, s in pairs:
        keep = keep | ((year("o_orderdate") == y) & (F.col("o_orderstatus") == s))
    return t.orders.filter(keep).select("o_orderkey")


@query("flt7_name_terms", "SELECT page_id FROM pages WHERE regexp_extract(url, '[^/]*$') ILIKE '%p%' AND regexp_extract(url, '[^/]*$') NOT ILIKE '%9%'")
def _(t: Tables) -> DataFrame:
    """FLT-7: a wanted and no unwanted term in the last part of the path."""
    name = F.regexp_extract("url", "[^/]*$", 0)
    return t.pages.filter(name.ilike("%p%") & ~name.ilike("%9%")).select("page_id")


@query("flt8_rolling_window", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'excluded_status' WHEN year(o_orderdate) >= y - 2 THEN 'in_window'
 WHEN o_totalprice > 200000 THEN 'exception' ELSE 'too_old' END AS reason FROM orders, (SELECT max(year(o_orderdate)) AS y FROM orders)""")
def _(t: Tables) -> DataFrame:
    """FLT-8: in the last years, with excluded statuses and flagged exceptions; says why."""
    last = t.orders.agg(F.max(year("o_orderdate")).alias("y"))
    reason = F.when(F.col("o_orderstatus") == "F", "excluded_status").when(year("o_orderdate") >= F.col("y") - 2, "in_window").when(F.col("o_totalprice") > 200000, "exception").otherwise("too_old")
    return t.orders.crossJoin(F.broadcast(last)).select("o_orderkey", reason.alias("reason"))


@query("flt9_official_host", "SELECT page_id FROM pages WHERE regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) = 'example.com' OR regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) LIKE '%.example.com' OR regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) LIKE '%.test'")
def _(t: Tables) -> DataFrame:
    """FLT-9: the host is a domain or lies under it."""
    host = F.regexp_extract(F.lower("url"), "^[a-z]+://([^/:?#]+)", 1)
    return t.pages.filter((host == "example.com") | host.endswith(".example.com") | host.endswith(".test")).select("page_id")


@query("flt10_reason_counts", """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.toxic = 1 THEN 'sensitive'
 WHEN l.quality = 0 THEN 'unverified' ELSE 'eligible' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY reason""")
def _(t: Tables) -> DataFrame:
    """FLT-10: eligibility with counts by reason."""
    both = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality", "toxic", F.lit(1).alias("has")), "doc_id", "left")
    reason = F.when(F.col("has").isNull(), "missing").when(F.col("toxic") == 1, "sensitive").when(F.col("quality") == 0, "unverified").otherwise("eligible")
    return both.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("flt11_excluded_terms", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING NOT bool_or(coalesce(text, '') ILIKE '%stupid%' OR coalesce(text, '') ILIKE '%password%')")
def _(t: Tables) -> DataFrame:
    """FLT-11: groups whose evidence holds no excluded term."""
    bad = F.coalesce("text", F.lit("")).rlike("(?i)stupid|password")
    return t.conversations.groupBy("conv_id").agg(F.bool_or(bad).alias("bad")).filter(~F.col("bad")).select("conv_id")


@query("flt12_year_cover", """
SELECT s_suppkey, y FROM (SELECT s_suppkey, 1993 + s_nationkey % 3 AS a, 1995 + s_nationkey % 4 AS b, s_acctbal < 0 AS listed FROM supplier),
 (VALUES (1994),(1996),(1998)) v(y) WHERE CASE WHEN listed THEN y IN (a, b) ELSE y BETWEEN a AND b END""")
def _(t: Tables) -> DataFrame:
    """FLT-12: covered by an explicit list of years, else by a range."""
    s = t.supplier.select("s_suppkey", (F.col("s_nationkey") % 3 + 1993).alias("a"), (F.col("s_nationkey") % 4 + 1995).alias("b"), (F.col("s_acctbal") < 0).alias("listed"))
    s = s.select("*", F.explode(F.array(*[F.lit(y) for y in (1994, 1996, 1998)])).alias("y"))
    return s.filter(F.when(F.col("listed"), F.col("y").isin(F.col("a"), F.col("b"))).otherwise(F.col("y").between(F.col("a"), F.col("b")))).select("s_suppkey", "y")


@query("flt13_mode_gate", """
SELECT event_type, mode, CASE WHEN event_type = 'error' THEN false WHEN mode = 'current' THEN event_type <> 'view' WHEN mode = 'historical' THEN true ELSE false END AS allowed,
 CASE WHEN event_type = 'error' THEN 'layer_blocked' WHEN mode = 'current' AND event_type = 'view' THEN 'not_current' WHEN mode = 'planning' THEN 'mode_blocked' ELSE 'ok' END AS reason
FROM (SELECT DISTINCT event_type FROM events), (VALUES ('current'),('historical'),('planning')) m(mode)""")
def _(t: Tables) -> DataFrame:
    """FLT-13: what a layer may be used for in a time mode, and why not."""
    e, m = F.col("event_type"), F.col("mode")
    rows = t.events.select("event_type").distinct().select("*", F.explode(F.array(*[F.lit(x) for x in ("current", "historical", "planning")])).alias("mode"))
    allowed = F.when(e == "error", False).when(m == "current", e != "view").otherwise(m == "historical")
    reason = F.when(e == "error", "layer_blocked").when((m == "current") & (e == "view"), "not_current").when(m == "planning", "mode_blocked").otherwise("ok")
    return rows.select("event_type", "mode", allowed.alias("allowed"), reason.alias("reason"))


# joins --------------------------------------------------------------------------------------------


@query("jn1_inner_lookup", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_name = 'Customer#000000001' OR c.c_mktsegment LIKE '%BUILD%'")
def _(t: Tables) -> DataFrame:
    """JN-1: foreign key lookup, exact or contains; the filter reaches the scan of the looked-up side."""
    c = t.customer.filter((F.col("c_name") == "Customer#000000001") | F.col("c_mktsegment").contains("BUILD"))
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("jn2_evidence_first", "SELECT o_orderkey, min(l_linenumber) AS line, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey")
def _(t: Tables) -> DataFrame:
    """JN-2: records with their evidence, the first kept for each record."""
    o = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    return o.join(t.lineitem.select("l_orderkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.min("l_linenumber").alias("line"), F.count("*").alias("n"))


@query("jn3_left_three_keys", """
SELECT a.nation, a.y, a.status, coalesce(b.n, 0) AS n FROM (SELECT DISTINCT c_nationkey AS nation, year(o_orderdate) AS y, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey) a
LEFT JOIN (SELECT s_nationkey AS nation, year(l_shipdate) AS y, l_linestatus AS status, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) b
ON a.nation = b.nation AND a.y = b.y AND a.status = b.status""")
def _(t: Tables) -> DataFrame:
    """JN-3: left outer join on three keys, both sides aggregated first."""
    a = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("status")).distinct()
    b = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("nation"), year("l_shipdate").alias("y"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"))
    return a.join(b, ["nation", "y", "status"], "left").select("nation", "y", "status", F.coalesce("n", F.lit(0)).alias("n"))


@query("jn4_left_count", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(t: Tables) -> DataFrame:
    """JN-4: parents with the number of their children; counted before the join."""
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("jn5_canonical_document", """
WITH f AS (SELECT sha256(text) AS h, min(doc_id) AS canonical FROM documents GROUP BY 1)
SELECT d.doc_id, f.canonical, c.source AS canonical_source, l.quality FROM documents d JOIN f ON sha256(d.text) = f.h JOIN documents c ON c.doc_id = f.canonical LEFT JOIN labels l ON l.doc_id = f.canonical""")
def _(t: Tables) -> DataFrame:
    """JN-5: document to its canonical copy, that copy's row, and a catalogue."""
    d = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("h"))
    f = d.groupBy("h").agg(F.min_by(F.struct("doc_id", F.col("source").alias("canonical_source")), "doc_id").alias("c")).select("h", F.col("c.doc_id").alias("canonical"), "c.canonical_source")
    got = d.select("doc_id", "h").join(f, "h").join(t.labels.select(F.col("doc_id").alias("canonical"), "quality"), "canonical", "left")
    return got.select("doc_id", "canonical", "canonical_source", "quality")


@query("jn6_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def _(t: Tables) -> DataFrame:
    """JN-6: parents that have a relation."""
    return t.customer.join(t.orders.filter("o_totalprice > 150000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("jn7_anti_rescue", """
SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE sha256(c.text) = sha256(d.text) AND c.doc_id < d.doc_id AND NOT (d.n_chars > 5000 OR d.source = 'src0'))""")
def _(t: Tables) -> DataFrame:
    """JN-7: drop copies that are not canonical unless something rescues them."""
    d = t.documents.select("doc_id", "n_chars", "source", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    return d.join(first, "h").filter((F.col("doc_id") == F.col("first")) | (F.col("n_chars") > 5000) | (F.col("source") == "src0")).select("doc_id")


@query("jn8_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(t: Tables) -> DataFrame:
    """JN-8: set difference by key."""
    return t.part.join(t.lineitem.filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("jn9_name_registry", """
WITH r AS (SELECT p_name AS name, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY p_name)
SELECT p.p_partkey, CASE WHEN r.n IS NULL THEN 'none' WHEN r.n = 1 THEN 'one' ELSE 'many' END AS outcome, CASE WHEN r.n = 1 THEN r.k END AS found FROM part p LEFT JOIN r ON r.name = p.p_name""")
def _(t: Tables) -> DataFrame:
    """JN-9: a name probes a registry: none, one or many."""
    r = t.part.groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("k"))
    outcome = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "one").otherwise("many")
    return t.part.select("p_partkey", "p_name").join(r, "p_name", "left").select("p_partkey", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("k")).alias("found"))


@query("jn10_list_comparison", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1995), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'final_only' WHEN a.k IS NULL THEN 'public_only' ELSE 'both' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def _(t: Tables) -> DataFrame:
    """JN-10: two populations compared."""
    k = t.orders.select(F.col("o_custkey").alias("k"), year("o_orderdate").alias("y"))
    return R.compare_lists(k.filter("y = 1995"), k.filter("y = 1996"), ["k"], ("final", "public"))


@query("jn11_snapshot_diff", """
WITH a AS (SELECT o_custkey AS k, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1993-01-01' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def _(t: Tables) -> DataFrame:
    """JN-11: added, removed and modified keys between two snapshots."""
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("v")
    before = t.orders.filter("o_orderdate < TIMESTAMP_NTZ '1997-01-01'").groupBy(F.col("o_custkey").alias("k")).agg(cents)
    after = t.orders.filter("o_orderdate >= TIMESTAMP_NTZ '1993-01-01'").groupBy(F.col("o_custkey").alias("k")).agg(cents)
    return R.snapshot_diff(before, after, ["k"], "v")


@query("jn16_containment", r"""
WITH b AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark), lengths(n) AS (VALUES (1), (2), (3)),
t AS (SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS term FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b, lengths)), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS term FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths))
SELECT doc_id, term, count(*) AS n FROM g JOIN t USING (term) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    """JN-16: the terms of a dictionary table, thousands of one to three words, in all texts."""
    w = T.words(F.col("text"))
    terms = t.benchmark.select(F.explode(F.flatten(F.array(*[D.grams(w, F.lit(n)) for n in (1, 2, 3)]))).alias("g")).select(F.col("g.gram").alias("term"))
    return D.dictionary_matches(t.documents, terms)


@query("jn16_substring_terms", """
WITH t AS (SELECT DISTINCT substr(lower(text), CAST(i AS INTEGER), 7) AS term FROM (SELECT text, unnest(range(1, length(text) - 5, 5)) AS i FROM benchmark))
SELECT doc_id, term, strpos(x, term) AS first_at FROM (SELECT doc_id, lower(text) AS x FROM documents) JOIN t ON contains(x, term)""")
def _(t: Tables) -> DataFrame:
    """JN-16: thousands of terms anywhere in all texts, across and inside words, as scripts without spaces need it."""
    at = F.sequence(F.lit(1), F.greatest(F.length("text") - 6, F.lit(1)), F.lit(5))
    pieces = t.benchmark.filter(F.length("text") > 6).select(F.explode(F.transform(at, lambda i: F.substring(F.lower("text"), i, F.lit(7)))).alias("term"))
    return D.term_hits(t.documents.select("doc_id", F.lower("text").alias("x")), "doc_id", "x", pieces).drop("n")


@query("jn17_region_expansion", """
WITH co AS (SELECT s_nationkey AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = 3 GROUP BY 1),
w AS (SELECT 3 AS n UNION SELECT b FROM co WHERE n > (SELECT avg(n) FROM co)) SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n FROM w)""")
def _(t: Tables) -> DataFrame:
    """JN-17: asked regions and those that occur with them more often than the mean, one hop."""
    line = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    co = line.join(t.customer.filter("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("n")).agg(F.count("*").alias("lines"))
    often = co.crossJoin(F.broadcast(co.agg(F.avg("lines").alias("mean")))).filter("lines > mean").select("n")
    wide = often.unionByName(t.spark.range(1).select(F.lit(3).alias("n"))).distinct()
    return t.supplier.join(F.broadcast(wide), F.col("s_nationkey") == F.col("n"), "left_semi").select("s_suppkey")


@query("jn18_id_remap", """
WITH m AS (SELECT o_orderkey AS old, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS new FROM orders WHERE o_orderstatus <> 'P')
SELECT l.l_orderkey, l.l_linenumber, m.new AS new_key, m.new IS NULL AS missing FROM lineitem l LEFT JOIN m ON l.l_orderkey = m.old""")
def _(t: Tables) -> DataFrame:
    """JN-18: old ids to new ones; what has none is flagged."""
    big = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    m = R.numbered(big, [F.col("o_orderdate"), F.col("l_orderkey")], "new_key").select("l_orderkey", "new_key")
    return t.lineitem.select("l_orderkey", "l_linenumber").join(m, "l_orderkey", "left").withColumn("missing", F.col("new_key").isNull())


@query("jn19_manifest", """
WITH a AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 10 <> 1), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 10 <> 2)
SELECT CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'orphan' WHEN a.n_chars <> b.n_chars THEN 'size_mismatch' ELSE 'ok' END AS status, count(*) AS n, CAST(sum(coalesce(a.n_chars, b.n_chars)) AS BIGINT) AS size
FROM a FULL JOIN b ON a.doc_id = b.doc_id GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    """JN-19: a manifest against what is there, with sizes. (The two sides are made from one table.)"""
    d = t.documents.select("doc_id", "n_chars")
    a = d.filter("doc_id % 10 <> 1").select("doc_id", F.col("n_chars").alias("x"))
    b = d.filter("doc_id % 10 <> 2").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("y"))
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "orphan").when(F.col("x") != F.col("y"), "size_mismatch").otherwise("ok")
    return a.join(b, "doc_id", "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum(F.coalesce("x", "y")).alias("size"))


# aggregations -------------------------------------------------------------------------------------


@query("agg1_group_count", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """AGG-1."""
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("agg2_conditional_sum", "SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_open, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_discount FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """AGG-2."""
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.count_if(F.col("l_discount") > 0.05).alias("n_discount"))


@query("agg3_distinct_since", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """AGG-3: usage and distinct users since a date."""
    since = t.events.agg((F.min("ts") + F.expr("INTERVAL 1 DAY")).alias("since"))
    return t.events.crossJoin(F.broadcast(since)).filter("ts >= since").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("agg4_distinct_strings", "SELECT n_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """AGG-4: distinct values joined, in order."""
    return t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments")).join(F.broadcast(t.nation.select("n_nationkey")), "n_nationkey", "left_semi")


@query("agg5_rate", "SELECT count(*) AS n, coalesce(sum(quality), 0)::BIGINT AS good, round(coalesce(sum(quality), 0) / count(*), 4) AS rate FROM labels")
def _(t: Tables) -> DataFrame:
    """AGG-5: global sums with a rate; an empty table gives 0."""
    return t.labels.agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good")).select("n", "good", F.round(F.try_divide("good", "n"), 4).alias("rate"))


@query("agg6_min_max", "SELECT source, min(doc_id) AS first, max(n_chars) AS longest FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """AGG-6."""
    return t.documents.groupBy("source").agg(F.min("doc_id").alias("first"), F.max("n_chars").alias("longest"))


@query("agg7_pick_best", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(t: Tables) -> DataFrame:
    """AGG-7: the best of each group by several criteria."""
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return R.pick_best(o, ["o_custkey"], [F.col("o_orderstatus") != "F", -F.col("o_totalprice"), F.col("o_orderkey")]).drop("o_orderstatus")


@query("agg8_exact_dedup", "SELECT sha256(text) AS digest, min(doc_id) AS canonical, count(*) - 1 AS copies, CAST(sum(n_chars) - min(n_chars) AS BIGINT) AS waste FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """AGG-8: groups of exact content, the canonical row and what copies waste."""
    return t.documents.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("canonical"), (F.count("*") - 1).alias("copies"), (F.sum("n_chars") - F.min("n_chars")).alias("waste"))


@query("agg9_rule_clusters", "SELECT CASE WHEN p_partkey % 97 = 0 THEN 'manual' WHEN p_size > 40 THEN 'size:' || p_size WHEN p_brand LIKE '%1' THEN 'brand:' || p_brand ELSE 'name:' || lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g')) END AS cluster, count(*) AS n, min(p_partkey) AS canonical FROM part GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """AGG-9: cluster key by the first rule that applies; an assignment made by hand wins. (Those are made up here.)"""
    hand = t.part.filter("p_partkey % 97 = 0").select("p_partkey", F.lit("manual").alias("hand"))
    key = F.when(F.col("p_size") > 40, F.concat(F.lit("size:"), F.col("p_size"))).when(F.col("p_brand").endswith("1"), F.concat(F.lit("brand:"), F.col("p_brand"))).otherwise(F.concat(F.lit("name:"), F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]+", ""))))
    rows = t.part.join(hand, "p_partkey", "left")
    return rows.groupBy(F.coalesce("hand", key).alias("cluster")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("canonical"))


@query("agg10_priority_merge", """
WITH r AS (SELECT user_id, event_type, ts, event_id, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS p FROM events)
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, max(p) AS priority, count(*) AS n FROM r x WHERE NOT (p = 1 AND EXISTS (SELECT 1 FROM r y WHERE y.user_id = x.user_id AND CAST(y.ts AS DATE) = CAST(x.ts AS DATE) AND y.p > 1)) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    """AGG-10: plain rows go where a detailed one exists, then the highest priority of each key."""
    p = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    g = t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max(p).alias("priority"), F.count_if(p > 1).alias("detailed"), F.count("*").alias("every"))
    return g.select("user_id", "day", "priority", F.when(F.col("priority") > 1, F.col("detailed")).otherwise(F.col("every")).alias("n"))


@query("agg11_set_union", "SELECT l_partkey, string_agg(DISTINCT l_shipmode_, ',' ORDER BY l_shipmode_) AS flags, min(l_suppkey) AS supplier FROM (SELECT l_partkey, l_suppkey, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """AGG-11: arrays of rows with the same key united."""
    flags = F.array(F.concat("l_returnflag", "l_linestatus"))
    return t.lineitem.select("l_partkey", "l_suppkey", F.explode(flags).alias("f")).groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("f")), ",").alias("flags"), F.min("l_suppkey").alias("supplier"))


@query("agg12_annual_fact", "SELECT user_id, day, event_id FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_id) AS r FROM events) WHERE r = 1")
def _(t: Tables) -> DataFrame:
    """AGG-12: the strongest event of each subject and period."""
    strength = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    e = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", strength.alias("s"))
    return R.pick_best(e, ["user_id", "day"], [F.col("s"), F.col("event_id")]).drop("s")


@query("agg14_thresholds", "SELECT user_id, count(*) AS signals, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT event_type) >= 3 ORDER BY signals DESC, user_id LIMIT 20")
def _(t: Tables) -> DataFrame:
    """AGG-14: groups over several minimums, the top of them."""
    g = t.events.groupBy("user_id").agg(F.count("*").alias("signals"), F.count_distinct("event_type").alias("kinds"))
    return g.filter("signals >= 5 AND kinds >= 3").orderBy(F.desc("signals"), "user_id").limit(20)


_CELLS = """
WITH n AS (SELECT n_nationkey FROM nation), y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), e AS (SELECT c_nationkey, year(o_orderdate) AS y, list(DISTINCT o_orderstatus) AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT n.n_nationkey, y.y, coalesce(e.n, 0) AS n, CASE WHEN e.s IS NULL THEN 'missing' WHEN list_contains(s, 'F') AND list_contains(s, 'O') THEN 'complete' WHEN list_contains(s, 'F') THEN 'final' WHEN list_contains(s, 'P') THEN 'pending' ELSE 'open' END AS status
FROM n CROSS JOIN y LEFT JOIN e ON e.c_nationkey = n.n_nationkey AND e.y = y.y"""


@query("agg15_16_coverage_matrix", _CELLS)
def _(t: Tables) -> DataFrame:
    """AGG-15, AGG-16: every cell of a grid with the status that its evidence gives."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    e = o.groupBy(F.col("c_nationkey").alias("n_nationkey"), year("o_orderdate").alias("y")).agg(F.collect_set("o_orderstatus").alias("s"), F.count("*").alias("n"))
    cells = R.grid(t.orders.select(year("o_orderdate").alias("y")).distinct(), t.nation.select("n_nationkey"))
    has = lambda x: F.array_contains("s", x)
    status = F.when(F.col("s").isNull(), "missing").when(has("F") & has("O"), "complete").when(has("F"), "final").when(has("P"), "pending").otherwise("open")
    return cells.join(e, ["n_nationkey", "y"], "left").select("n_nationkey", "y", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


@query("agg17_region_completeness", """
SELECT r.r_regionkey, count(DISTINCT n.n_nationkey) AS expected, count(DISTINCT s.s_nationkey) AS covered, coalesce(string_agg(DISTINCT CASE WHEN s.s_nationkey IS NULL THEN n.n_name END, ',' ORDER BY CASE WHEN s.s_nationkey IS NULL THEN n.n_name END), '') AS missing, count(DISTINCT n.n_nationkey) = count(DISTINCT s.s_nationkey) AS complete
FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000) s ON s.s_nationkey = n.n_nationkey GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    """AGG-17: expected against covered regions, with the missing ones."""
    s = t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(1).alias("has")).distinct()
    g = t.nation.join(s, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey"))
    out = g.agg(F.count_distinct("n_nationkey").alias("expected"), F.count_distinct(F.when(F.col("has") == 1, F.col("n_nationkey"))).alias("covered"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("has").isNull(), F.col("n_name")))), ",").alias("missing"))
    return out.withColumn("complete", F.col("expected") == F.col("covered"))


@query("agg18_completeness_delta", "SELECT o_orderkey, expected, extracted, expected - extracted AS delta, expected = extracted AS claim_allowed FROM (SELECT l_orderkey AS o_orderkey, CAST(max(l_linenumber) AS BIGINT) AS expected, count(*) AS extracted FROM lineitem GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    """AGG-18: stated against found numbers of rows."""
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").cast("long").alias("expected"), F.count("*").alias("extracted"))
    return g.select("*", (F.col("expected") - F.col("extracted")).alias("delta"), (F.col("expected") == F.col("extracted")).alias("claim_allowed"))


@query("agg19_scope_counts", "SELECT d.source, count(*) FILTER (l.quality = 1) AS verified, count(*) FILTER (l.doc_id IS NULL) AS pending, count(*) FILTER (l.toxic = 1) AS coded FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """AGG-19: verified, pending and coded rows of each scope."""
    d = t.documents.select("doc_id", "source").join(t.labels.withColumn("has", F.lit(1)), "doc_id", "left")
    return d.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("verified"), F.count_if(F.col("has").isNull()).alias("pending"), F.count_if(F.col("toxic") == 1).alias("coded"))


@query("agg20_observed_mean", """
WITH f AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal / 100 END AS a, CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey * 2.0 END AS b FROM customer)
SELECT c_custkey, round((coalesce(a * 0.6, 0) + coalesce(b * 0.4, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END, 0), 4) AS score,
 CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'full' WHEN a IS NULL AND b IS NULL THEN 'none' ELSE 'partial' END AS coverage FROM f""")
def _(t: Tables) -> DataFrame:
    """AGG-20: weighted mean over the observed values only."""
    f = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 100).alias("a"), F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey") * F.lit(2.0)).alias("b"))
    seen = F.when(F.col("a").isNull(), 0.0).otherwise(0.6) + F.when(F.col("b").isNull(), 0.0).otherwise(0.4)
    score = F.try_divide(F.coalesce(F.col("a") * 0.6, F.lit(0.0)) + F.coalesce(F.col("b") * 0.4, F.lit(0.0)), seen)
    cover = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "full").when(F.col("a").isNull() & F.col("b").isNull(), "none").otherwise("partial")
    return f.select("c_custkey", F.round(score, 4).alias("score"), cover.alias("coverage"))


@query("agg21_capped_rollup", """
WITH leaf AS (SELECT o_custkey AS k, o_orderpriority AS g, least(CAST(count(*) AS DOUBLE) * 3, 10) AS s FROM orders GROUP BY 1, 2), grp AS (SELECT k, sum(s) FILTER (g < '3') AS base, sum(s) FILTER (g >= '3') AS bonus FROM leaf GROUP BY 1), cap AS (SELECT k, CASE WHEN base > 15 THEN 15 ELSE base END AS base, CASE WHEN bonus > 12 THEN 12 ELSE bonus END AS bonus FROM grp)
SELECT k, base, bonus, CASE WHEN base + bonus > 20 THEN 20 ELSE base + bonus END AS total FROM cap""")
def _(t: Tables) -> DataFrame:
    """AGG-21: leaf scores capped by group, then base and bonus, then the total; null where a part is."""
    leaf = t.orders.groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("g")).agg(F.least(F.count("*").cast("double") * 3, F.lit(10.0)).alias("s"))
    cap = lambda c, n: F.when(c.isNotNull(), F.least(c, F.lit(float(n))))
    grp = leaf.groupBy("k").agg(cap(F.sum(F.when(F.col("g") < "3", F.col("s"))), 15).alias("base"), cap(F.sum(F.when(F.col("g") >= "3", F.col("s"))), 12).alias("bonus"))
    return grp.withColumn("total", cap(F.col("base") + F.col("bonus"), 20))


@query("agg22_usage_queue", "SELECT p, usage, users, CASE WHEN usage > 0 THEN row_number() OVER (ORDER BY usage > 0 DESC, usage DESC, users DESC, p) END AS rank FROM (SELECT user_id % 50 AS p, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS usage, count(DISTINCT user_id) AS users FROM events GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    """AGG-22: a queue by usage; only what is used gets a rank."""
    g = t.events.groupBy((F.col("user_id") % 50).alias("p")).agg(F.count_if(F.col("event_type") == "purchase").alias("usage"), F.count_distinct("user_id").alias("users"))
    rank = F.row_number().over(Window.orderBy((F.col("usage") > 0).desc(), F.desc("usage"), F.desc("users"), "p"))
    return g.withColumn("rank", F.when(F.col("usage") > 0, rank.cast("long")))


@query("agg23_percentiles", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (i = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT)) AS p50, max(value) FILTER (i = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT)) AS p95, round(avg(value), 6) AS mean, max(value) AS max FROM r GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    """AGG-23: nearest-rank percentiles; the values are counted first, so equal ones are one row, and dealt out by range."""
    counts = t.events.filter("value IS NOT NULL").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    rows = R.running_totals(counts, ["event_type"], "value", "n", "upto").withColumnRenamed("upto_all", "all")
    at = lambda f: F.bround((F.col("all") - 1) * f).cast("long")
    pick = lambda f: F.max(F.when((F.col("upto") > at(f)) & (F.col("upto") - F.col("n") <= at(f)), F.col("value")))
    return rows.groupBy("event_type").agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.max("value").alias("max"))


# windows, sorts, sets -----------------------------------------------------------------------------


@query("win1_row_number", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations")
def _(t: Tables) -> DataFrame:
    """WIN-1: place within a pack."""
    return t.conversations.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("seq"))


@query("win2_root_of_pack", "SELECT conv_id, turn, first_value(turn) OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn) AS root FROM conversations")
def _(t: Tables) -> DataFrame:
    """WIN-2: the root of a pack by a ranked kind; an aggregate joined back rather than a sort of each pack."""
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    root = t.conversations.groupBy("conv_id").agg(F.min_by("turn", F.struct(rank, "turn")).alias("root"))
    return t.conversations.select("conv_id", "turn").join(root, "conv_id")


@query("win3_version_links", """
SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next, max(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END) FILTER (WHERE TRUE) OVER (PARTITION BY o_custkey) AS latest
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def _(t: Tables) -> DataFrame:
    """WIN-3: previous, next and the latest that is eligible within a group."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    latest = F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey"))).over(Window.partitionBy("o_custkey"))
    return t.orders.select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("next"), latest.alias("latest"))


@query("win7_adjacent_periods", "WITH y AS (SELECT DISTINCT o_custkey AS k, year(o_orderdate) AS y FROM orders), p AS (SELECT k, y AS from_year, lead(y) OVER (PARTITION BY k ORDER BY y) AS to_year FROM y) SELECT * FROM p WHERE to_year IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """WIN-7: each period with the next one."""
    ys = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_set(year("o_orderdate"))).alias("y"))
    pairs = F.arrays_zip(F.slice("y", F.lit(1), F.size("y") - 1).alias("a"), F.slice("y", F.lit(2), F.size("y")).alias("b"))
    return ys.filter(F.size("y") > 1).select("k", F.explode(pairs).alias("p")).select("k", F.col("p.a").alias("from_year"), F.col("p.b").alias("to_year"))


@query("win9_first_seen", "SELECT event_type, row_number() OVER (ORDER BY f) AS place FROM (SELECT event_type, min(event_id) AS f FROM events GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    """WIN-9: distinct values in the order in which they first occur."""
    f = t.events.groupBy("event_type").agg(F.min("event_id").alias("f"))
    return f.select("event_type", F.row_number().over(Window.orderBy("f")).cast("long").alias("place"))


@query("win10_growth", """
WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), p AS (SELECT k, sum(v) FILTER (y = 1993) AS a, sum(v) FILTER (y = 1994) AS b, sum(v) FILTER (y = 1995) AS c FROM y GROUP BY 1)
SELECT k, round(0.5 * (b / a + c / b) - 1, 4) AS growth FROM p WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    """WIN-10: mean growth over three years, null where a denominator is."""
    v = lambda y: F.sum(F.when(year("o_orderdate") == y, F.col("o_totalprice")))
    p = t.orders.filter(year("o_orderdate").between(1993, 1995)).groupBy(F.col("o_custkey").alias("k")).agg(v(1993).alias("a"), v(1994).alias("b"), v(1995).alias("c"))
    return p.select("k", F.round(F.lit(0.5) * (F.try_divide("b", "a") + F.try_divide("c", "b")) - 1, 4).alias("growth"))


@query("srt1_2_3_ranked_top", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, year(o_orderdate) DESC, o_totalprice DESC, o_orderkey LIMIT 25")
def _(t: Tables) -> DataFrame:
    """SRT-1, SRT-2, SRT-3: several keys, a ranked kind first, the top of them."""
    kind = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.orderBy(kind, year("o_orderdate").desc(), F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("srt4_5_page", "SELECT p_partkey, (SELECT count(*) FROM part WHERE p_size > 5) AS total, (SELECT count(*) FROM part WHERE p_size > 5) > 60 AS has_more, CASE WHEN (SELECT count(*) FROM part WHERE p_size > 5) > 60 THEN 60 END AS next_offset FROM part WHERE p_size > 5 ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def _(t: Tables) -> DataFrame:
    """SRT-4, SRT-5: a page with its envelope."""
    return R.page(t.part.filter("p_size > 5").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], 40, 20).drop("p_retailprice")


@query("srt6_top_per_group", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def _(t: Tables) -> DataFrame:
    """SRT-6."""
    return R.top_per_group(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 5).drop("n_chars").withColumn("rank", F.col("rank").cast("long"))


@query("srt7_confidence_band", "SELECT s_suppkey, CASE WHEN s_acctbal / m >= 0.75 THEN 'high' WHEN s_acctbal / m >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM supplier, (SELECT max(s_acctbal) AS m FROM supplier)")
def _(t: Tables) -> DataFrame:
    """SRT-7: bands relative to the top score."""
    share = F.col("s_acctbal") / F.col("m")
    band = F.when(share >= 0.75, "high").when(share >= 0.4, "medium").otherwise("low")
    return t.supplier.crossJoin(F.broadcast(t.supplier.agg(F.max("s_acctbal").alias("m")))).select("s_suppkey", band.alias("band"))


@query("srt8_first_mention", "SELECT doc_id, term, strpos(lower(text), term) AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY strpos(lower(text), term), term) AS place FROM documents, (VALUES ('the'),('que'),('and'),('der')) v(term) WHERE strpos(lower(text), term) > 0")
def _(t: Tables) -> DataFrame:
    """SRT-8: terms in the order of their first mention."""
    spots = F.array(*[F.struct(F.instr(F.lower("text"), x).alias("pos"), F.lit(x).alias("term")) for x in ("the", "que", "and", "der")])
    there = F.array_sort(F.filter(spots, lambda s: s["pos"] > 0))
    return t.documents.select("doc_id", F.posexplode(there).alias("place", "s")).select("doc_id", "s.term", F.col("s.pos").cast("long").alias("pos"), (F.col("place") + 1).cast("long").alias("place"))


@query("set1_2_candidates", "SELECT k, min(src) AS src FROM (SELECT c_nationkey AS k, 1 AS src FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, 2 FROM supplier UNION ALL SELECT n_nationkey, 3 FROM nation) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """SET-1, SET-2: candidates of several sources, first source wins."""
    rows = t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("src"))
    rows = rows.unionAll(t.supplier.select("s_nationkey", F.lit(2))).unionAll(t.nation.select("n_nationkey", F.lit(3)))
    return rows.groupBy("k").agg(F.min("src").alias("src"))


@query("set3_difference", "SELECT l_partkey AS k, 'new' AS kind FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' EXCEPT SELECT l_partkey, 'new' FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' UNION ALL SELECT k, 'shared' FROM (SELECT l_partkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' INTERSECT SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01')")
def _(t: Tables) -> DataFrame:
    """SET-3: new against a baseline, and shared; one aggregation gives both."""
    late = F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ '1997-01-01'")
    g = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.bool_or(late).alias("late"), F.bool_or(~late).alias("early")).filter("late")
    return g.select("k", F.when(F.col("early"), "shared").otherwise("new").alias("kind"))


@query("set4_overlay", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT 1000000 + n_nationkey, 'NEW' FROM nation")
def _(t: Tables) -> DataFrame:
    """SET-4: rows of a delta replace rows of the base. (The delta is made from the base.)"""
    base = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    delta = base.filter("c_custkey % 5 = 0").withColumn("segment", F.lit("X")).unionAll(t.nation.select((F.col("n_nationkey") + 1000000).cast("long"), F.lit("NEW")))
    return R.keyed_overlay(base, delta, ["c_custkey"])


@query("set5_filled_overlay", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'renamed' ELSE s_name END AS s_name, s_nationkey FROM supplier")
def _(t: Tables) -> DataFrame:
    """SET-5: filled values override, empty ones do not."""
    base = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    delta = base.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "renamed").otherwise("").alias("s_name"), F.lit(None).cast("int").alias("s_nationkey"))
    return R.filled_overlay(base, delta, ["s_suppkey"])


@query("set6_three_way", """
SELECT k, CASE WHEN l = b THEN r ELSE l END AS v, l <> b AND r <> b AND l <> r AS conflict FROM (SELECT n_nationkey AS k, n_name AS b, CASE WHEN n_nationkey % 3 = 0 THEN n_name || 'L' ELSE n_name END AS l, CASE WHEN n_nationkey % 2 = 0 THEN n_name || 'R' ELSE n_name END AS r FROM nation)""")
def _(t: Tables) -> DataFrame:
    """SET-6: three-way merge with conflicts."""
    b = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    changed = lambda n, x: b.withColumn("v", F.when(F.col("k") % n == 0, F.concat("v", F.lit(x))).otherwise(F.col("v")))
    return R.three_way_merge(b, changed(3, "L"), changed(2, "R"), "k", "v")


@query("ups1_upsert_history", """
SELECT k, v, status, CASE status WHEN 'updated' THEN 2 ELSE 1 END AS version FROM (
 SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 1 THEN c_mktsegment || '!' ELSE c_mktsegment END AS v, CASE WHEN c_custkey % 4 = 0 THEN 'inserted' WHEN c_custkey % 4 = 1 THEN 'updated' WHEN c_custkey % 4 = 2 THEN 'unchanged' ELSE 'kept' END AS status FROM customer)""")
def _(t: Tables) -> DataFrame:
    """UPS-1: keyed upsert by content hash. (Both sides are made from one table.)"""
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    old = c.filter("k % 4 <> 0").withColumn("version", F.lit(1))
    new = c.filter("k % 4 <> 3").withColumn("v", F.when(F.col("k") % 4 == 1, F.concat("v", F.lit("!"))).otherwise(F.col("v")))
    return R.upsert_with_history(old, new, ["k"], ["v"])


@query("ups7_latest_per_key", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """UPS-7."""
    return R.latest_per_key(t.events.select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id"))


@query("ups8_ignore_replace", """
WITH c AS (SELECT c_nationkey AS k, arg_min(c_name, c_custkey) AS v FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey % 3 <> 0 GROUP BY 1), i AS (SELECT c_nationkey AS k, arg_min(c_name, c_custkey) AS a, arg_max(c_name, c_custkey) AS b FROM customer WHERE c_custkey % 2 = 1 AND c_nationkey % 5 <> 0 GROUP BY 1)
SELECT coalesce(c.k, i.k) AS k, coalesce(c.v, i.a) AS ignoring, coalesce(i.b, c.v) AS replacing FROM c FULL JOIN i ON c.k = i.k""")
def _(t: Tables) -> DataFrame:
    """UPS-8: rows put into a table with a unique key: the row that is there, or the first, stays; or the last one replaces it."""
    rows = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("v"), F.col("c_custkey").alias("n"))
    there = R.pick_best(rows.filter("n % 2 = 0 AND k % 3 <> 0"), ["k"], [F.col("n")]).select("k", "v", F.lit(-1).cast("long").alias("n"))
    every = there.unionByName(rows.filter("n % 2 = 1 AND k % 5 <> 0"))
    return every.groupBy("k").agg(F.min_by("v", "n").alias("ignoring"), F.max_by("v", "n").alias("replacing"))
