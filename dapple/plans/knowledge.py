"""Routing, applicability, rule extraction, claims and matching on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dapple.functions import claims as C
from dapple.functions import text as T
from dapple.operators import assignment as A
from dapple.operators import dictionary as D
from dapple.operators import evidence as E
from dapple.operators import priorart as P
from dapple.operators import queryplan as Q
from dapple.operators import relational as R
from dapple.operators import rules as U
from dapple.plans.registry import Tables, query


@query("flt14_rule_applicability", """
SELECT c_custkey, n_nationkey, (r_regionkey = 1 OR n_nationkey IN (3, 7)) AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0 AS applies
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(t: Tables) -> DataFrame:
    """FLT-14: by kind, amount and place, a wider place covering those within."""
    places = t.nation.select("n_nationkey", ((F.col("n_regionkey") == 1) | F.col("n_nationkey").isin(3, 7)).alias("covered"))
    c = t.customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", "n_nationkey", (F.col("covered") & F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") >= 0)).alias("applies"))


@query("flt15_list_routing", """
WITH asked(id, list, field, size, start) AS (VALUES (1, 'volume', 'brand', 500, 0), (2, 'compact', 'size', 50, -5), (3, 'offers', 'brand', 0, 10), (4, 'volume', 'colour', 10, 0), (5, 'antiques', 'brand', 10, 0)),
kinds(list, type) AS (VALUES ('volume', 'STANDARD'), ('volume', 'LARGE'), ('compact', 'SMALL'), ('compact', 'MEDIUM'), ('offers', 'ECONOMY'), ('offers', 'PROMO')), n AS (SELECT list, count(*) AS rows FROM part JOIN kinds ON p_type = type GROUP BY 1)
SELECT id, CASE WHEN n.list IS NULL THEN 'unknown list' WHEN field NOT IN ('brand', 'size') THEN 'unsupported filter' ELSE 'accepted' END AS status, CASE WHEN n.list IS NOT NULL AND field IN ('brand', 'size') THEN rows END AS total, least(greatest(size, 1), 200) AS page, greatest(start, 0) AS first FROM asked LEFT JOIN n ON asked.list = n.list""")
def _(t: Tables) -> DataFrame:
    """FLT-15: requests to the list family that answers for them; unknown lists and filters are rejected, pages clamped."""
    asked = t.spark.createDataFrame([(1, "volume", "brand", 500, 0), (2, "compact", "size", 50, -5), (3, "offers", "brand", 0, 10), (4, "volume", "colour", 10, 0), (5, "antiques", "brand", 10, 0)], "id int, list string, field string, size int, start int")
    kinds = t.spark.createDataFrame([("volume", "STANDARD"), ("volume", "LARGE"), ("compact", "SMALL"), ("compact", "MEDIUM"), ("offers", "ECONOMY"), ("offers", "PROMO")], "list string, p_type string")
    n = t.part.join(F.broadcast(kinds), "p_type").groupBy("list").agg(F.count("*").alias("rows"))
    known = F.col("field").isin("brand", "size")
    status = F.when(F.col("rows").isNull(), "unknown list").when(~known, "unsupported filter").otherwise("accepted")
    return asked.join(n, "list", "left").select("id", status.alias("status"), F.when(known, F.col("rows")).alias("total"), F.least(F.greatest("size", F.lit(1)), F.lit(200)).alias("page"), F.greatest("start", F.lit(0)).alias("first"))


@query("jn15_greedy_assignment")
def _(t: Tables) -> DataFrame:
    """JN-15: parts to suppliers one to one, by falling similarity of a score."""
    p = t.part.select(F.col("p_partkey").alias("a"), (F.col("p_size") % 10 + 1).alias("p_size"), "p_retailprice")
    s = t.supplier.select(F.col("s_suppkey").alias("b"), (F.col("s_suppkey") % 10 + 1).cast("int").alias("p_size"), "s_acctbal")
    return A.similar_assignment(p, s, "p_size", F.col("p_retailprice"), F.abs("s_acctbal"), "a", "b")


@query("set7_taxonomy_merge", """
SELECT head, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM (SELECT string_split(p_type, ' ')[1] AS head, string_split(p_type, ' ')[-1] AS term FROM part UNION ALL SELECT string_split(p_type, ' ')[1], p_brand FROM part WHERE p_size > 45) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    """SET-7: term lists of a subject from two sources united."""
    w = F.split("p_type", " ")
    rows = t.part.select(w[0].alias("head"), F.element_at(w, -1).alias("term")).unionAll(t.part.filter("p_size > 45").select(w[0], "p_brand"))
    return rows.groupBy("head").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"))


@query("sim2_hybrid_score")
def _(t: Tables) -> DataFrame:
    """SIM-2: 0.45 of the sequence ratio and 0.55 of the trigram Jaccard, spellings folded, within blocks."""
    name = F.regexp_replace(F.lower("p_name"), r"\bgrey\b", "gray")
    p = t.part.select(F.col("p_partkey").alias("a"), name.alias("x"), "p_brand", "p_size")
    block = ["p_brand", "p_size"]
    names = D.hybrid_names(p, block, "x")
    q = p.select(F.col("a").alias("b"), F.col("x").alias("y"), *block)
    pairs = names.withColumn("score", F.round("score", 4)).join(p, [*block, "x"]).join(q, [*block, "y"]).filter("a < b")
    return pairs.select("a", "b", "score")


@query("str15_claim_structure", r"""
SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?\s*(?:-|to)\s*[0-9]+(?:\.[0-9]+)?')) AS ranges, len(regexp_extract_all(lower(text), '(?:^|[^\p{L}])(?:or|oder|ou)(?:$|[^\p{L}])')) AS alternatives, len(regexp_extract_all(text, '\([0-9]+\)')) AS markers FROM documents""")
def _(t: Tables) -> DataFrame:
    """STR-15: numeric ranges, alternatives and figure markers of a text."""
    n = lambda c, p: F.regexp_count(c, F.lit(p)).cast("long")
    return t.documents.select("doc_id", n(F.col("text"), r"[0-9]+(?:\.[0-9]+)?\s*(?:-|to)\s*[0-9]+(?:\.[0-9]+)?").alias("ranges"), n(F.lower("text"), r"(?:^|[^\p{L}])(?:or|oder|ou)(?:$|[^\p{L}])").alias("alternatives"), n(F.col("text"), r"\([0-9]+\)").alias("markers"))


@query("str17_18_query_plan", r"""
WITH q AS (SELECT conv_id, turn, lower(text) AS x FROM conversations WHERE role = 'user')
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(x, '\b(please|what is|tell me|find)\b', '', 'g'), '\s+', ' ', 'g')) AS rewritten, regexp_extract(x, '\b(20[0-9]{2})\b', 1) AS year, CASE WHEN regexp_matches(x, '\b(not|without|except)\b') THEN 'excluding' ELSE 'plain' END AS kind FROM q""")
def _(t: Tables) -> DataFrame:
    """STR-17, STR-18: a question rewritten and taken apart."""
    q = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.lower("text").alias("x"))
    bare = F.regexp_replace("x", r"\b(please|what is|tell me|find)\b", "")
    return q.select("conv_id", "turn", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("rewritten"), F.regexp_extract("x", r"\b(20[0-9]{2})\b", 1).alias("year"), F.when(F.col("x").rlike(r"\b(not|without|except)\b"), "excluding").otherwise("plain").alias("kind"))


@query("str15_claim_analysis", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'MARKUSH' WHEN p_size % 2 = 0 OR p_size % 5 = 0 THEN 'ALTERNATIVE' ELSE 'CONJUNCTION' END AS logic_type,
  CASE WHEN p_size % 7 = 0 THEN 3 ELSE 1 END AS nesting_depth,
  concat_ws('|', CASE WHEN p_size % 2 = 0 THEN 'selection:' || p_name || ';' || p_type || ';bolts (M3, M4)' END, CASE WHEN p_size % 5 = 0 THEN 'parenthetical_or:dry;very wet' END) AS alternatives,
  CASE WHEN p_size % 3 = 0 THEN 'R1,R2:alkyl;aryl;' || p_type || '|X3:' || p_brand || ';none' ELSE '' END AS markush,
  p_size || '..' || (p_size + 2) || '.5 mm' AS ranges, 'FIG.1,FIG.' || p_size || 'b' AS figures,
  concat_ws(',', CASE WHEN p_size % 3 = 0 THEN 'markush' END, CASE WHEN p_size % 10 = 0 THEN 'several_alternatives' END, CASE WHEN p_size % 7 = 0 THEN 'depth' END) AS reasons FROM part""")
def _(t: Tables) -> DataFrame:
    """STR-15: claims written from the columns of parts, taken apart again."""
    size = F.col("p_size")
    n, up = size.cast("string"), (size + 2).cast("string")
    text = F.concat(
        F.lit("A part as in FIG. 1 and FIG. "), n, F.lit("b, FIG. 1, between "), n, F.lit(" to "), up, F.lit(".5 mm (long)"),
        F.when(size % 2 == 0, F.concat(F.lit("; one or more selected from "), "p_name", F.lit(", "), "p_type", F.lit(" and bolts (M3, M4)"))).otherwise(""),
        F.when(size % 5 == 0, F.lit("; stored (dry or very wet)")).otherwise(""),
        F.when(size % 3 == 0, F.concat(F.lit("; R1 and R2 are each independently alkyl, aryl or "), "p_type", F.lit("; X3 is "), "p_brand", F.lit(", none; R1 is this, that"))).otherwise(""),
        F.when(size % 7 == 0, F.lit("; [a {b (c] d)} e]")).otherwise(""), F.lit("."),
    )
    got = C.claim_structure(t.part.select("p_partkey", text.alias("claim")), "p_partkey", "claim")
    options = lambda g: F.array_join(g["options"], ";")
    joined = lambda c, f, sep="|": F.array_join(F.transform(c, f), sep)
    return got.select(
        "p_partkey", "logic_type", "nesting_depth", joined("alternative_groups", lambda g: F.concat_ws(":", g["group_type"], options(g))).alias("alternatives"),
        joined("markush_groups", lambda g: F.concat_ws(":", F.array_join(g["variables"], ","), options(g))).alias("markush"),
        joined("numeric_ranges", lambda r: F.concat(r["lower"], F.lit(".."), r["upper"], F.lit(" "), r["unit"])).alias("ranges"), F.array_join("figure_markers", ",").alias("figures"), F.array_join("review_reasons", ",").alias("reasons"),
    )


#: Words that exclude what follows; words that only say that something is asked.
_EXCLUDE, _INTENT = ("not", "without", "ne", "pas", "nicht", "kein", "sin", "no"), ("please", "tell me", "what is", "the", "le", "der", "la que")


def question_aliases(t: Tables) -> DataFrame:
    """Aliases from the benchmark: word pairs stand for projects, long words for regions, short ones for subjects."""
    w = T.words(F.col("text"))
    pairs = t.benchmark.select("item_id", F.posexplode(F.transform(F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))).alias("b")), lambda x: F.concat_ws(" ", x["a"], x["b"]))).alias("i", "alias"))
    pairs = pairs.filter(F.contains("alias", F.lit(" "))).groupBy("alias").agg(F.min("item_id").alias("item")).select("alias", F.lit("project").alias("kind"), F.concat(F.lit("project "), F.col("item").cast("string")).alias("canonical"))
    words = t.benchmark.select(F.explode(w).alias("alias")).distinct()
    long_ = words.filter(F.length("alias") >= 6).select("alias", F.lit("region").alias("kind"), T.simple_upper(F.col("alias")).alias("canonical"))
    short = words.filter(F.length("alias").between(4, 5)).select("alias", F.lit("subject").alias("kind"), F.reverse("alias").alias("canonical"))
    fixed = t.spark.createDataFrame([*((a, "exclude", a) for a in _EXCLUDE), *((a, "intent", "") for a in _INTENT)], "alias string, kind string, canonical string")
    return pairs.unionByName(long_).unionByName(short).unionByName(fixed)


_QUESTIONS = rf"""
WITH RECURSIVE bw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark), words AS (SELECT DISTINCT unnest(w) AS alias FROM bw),
al AS (SELECT alias, arg_min(kind, (kind, canonical)) AS kind, arg_min(canonical, (kind, canonical)) AS canonical FROM (
  SELECT alias, 'project' AS kind, 'project ' || min(item_id) AS canonical FROM (SELECT item_id, w[i] || ' ' || w[i + 1] AS alias FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM bw)) GROUP BY 1
  UNION ALL SELECT alias, 'region', upper(alias) FROM words WHERE length(alias) >= 6 UNION ALL SELECT alias, 'subject', reverse(alias) FROM words WHERE length(alias) BETWEEN 4 AND 5
  UNION ALL SELECT unnest({list(_EXCLUDE)!r}), 'exclude', unnest({list(_EXCLUDE)!r}) UNION ALL SELECT unnest({list(_INTENT)!r}), 'intent', '') GROUP BY 1),
q AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM conversations),
pos AS (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM q),
at_ AS (SELECT conv_id, turn, i, coalesce(p.kind, o.kind) AS kind, coalesce(p.canonical, o.canonical) AS canonical, CASE WHEN p.kind IS NOT NULL THEN 2 ELSE 1 END AS n, w[i] AS word FROM pos LEFT JOIN al p ON p.alias = w[i] || ' ' || w[i + 1] LEFT JOIN al o ON o.alias = w[i]),
walk AS (SELECT * FROM at_ WHERE i = 1 UNION ALL SELECT a.* FROM walk k JOIN at_ a ON a.conv_id = k.conv_id AND a.turn = k.turn AND a.i = k.i + k.n),
m AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY conv_id, turn ORDER BY i) = 'exclude', false) AS gone FROM walk),
g AS (SELECT conv_id, turn, trim(regexp_replace(string_agg(coalesce(canonical, word), ' ' ORDER BY i), ' +', ' ', 'g')) AS rewritten,
  list(canonical ORDER BY i) FILTER (kind = 'project' AND NOT gone) AS p, list(canonical ORDER BY i) FILTER (kind = 'region' AND NOT gone) AS r, list(canonical ORDER BY i) FILTER (kind = 'subject' AND NOT gone) AS s, list(canonical ORDER BY i) FILTER (kind IN ('project', 'region', 'subject') AND gone) AS x FROM m GROUP BY 1, 2),
d AS (SELECT conv_id, turn, rewritten, list_filter(coalesce(p, []), lambda v, i: list_position(p, v) = i) AS p, list_filter(coalesce(r, []), lambda v, i: list_position(r, v) = i) AS r, list_filter(coalesce(s, []), lambda v, i: list_position(s, v) = i) AS s, list_filter(coalesce(x, []), lambda v, i: list_position(x, v) = i) AS x FROM g)
SELECT q.conv_id, q.turn, coalesce(rewritten, '') AS rewritten, coalesce(array_to_string(p, ','), '') AS projects, coalesce(array_to_string(r, ','), '') AS regions, coalesce(array_to_string(s, ','), '') AS subjects, coalesce(array_to_string(x, ','), '') AS excluded,
  coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(q.text, '(?:^|[^0-9])(20[0-9]{{2}})(?:$|[^0-9])', 1))), ','), '') AS years,
  CASE WHEN len(p) > 0 THEN array_to_string(list_transform(p, lambda v: array_to_string(list_append(r, v), ' ')), ',') ELSE coalesce(rewritten, '') END AS variants FROM q LEFT JOIN d ON d.conv_id = q.conv_id AND d.turn = q.turn"""


@query("str17_18_alias_plan", _QUESTIONS)
def _(t: Tables) -> DataFrame:
    """STR-17, STR-18: every turn taken apart by a table of thousands of aliases, leftmost and longest first."""
    rows = t.conversations.select(F.struct("conv_id", "turn").alias("key"), "text")
    plan = Q.query_plan(rows, "key", "text", question_aliases(t))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return plan.select("key.*", "rewritten", *[text(c) for c in ("projects", "regions", "subjects", "excluded", "years", "variants")])


#: Field, phrase; operator, phrase. Longer phrases first, so that "not less than" is not "less than".
FIELDS = (("balance", "account balance"), ("balance", "balance"), ("orders", "number of orders"), ("segment", "market segment"))
COMPARES = (("gte", "not less than"), ("gte", "at least"), ("lte", "no more than"), ("lte", "at most"), ("gt", "more than"), ("lt", "less than"))


@query("rul6_rule_candidates", r"""
WITH c AS (SELECT c_custkey AS k, c_acctbal AS b, c_nationkey AS n FROM customer)
SELECT k, CAST(1 AS INTEGER) AS clause, 'balance' AS field, CASE WHEN n % 2 = 0 THEN 'gte' ELSE 'lt' END AS op, CAST(round(abs(b), 1) AS DOUBLE) AS value, 'thousand' AS unit FROM c
UNION ALL SELECT k, 2, 'orders', 'lte', CAST(n AS DOUBLE), '' FROM c""")
def _(t: Tables) -> DataFrame:
    """RUL-6: clauses of a text, each with a field's phrase, an operator's phrase, a number and a unit, as rule candidates."""
    n = F.col("c_nationkey")
    text = F.concat(
        F.lit("The account balance must be "), F.when(n % 2 == 0, "not less than ").otherwise("less than "), F.round(F.abs("c_acctbal"), 1).cast("decimal(18,1)").cast("string"), F.lit(" thousand; the Number of Orders is at most "), n.cast("string"), F.lit("; the market segment is open; nothing else holds.")
    )
    return U.rule_candidates(t.customer.select(F.col("c_custkey").alias("k"), text.alias("text")), "k", "text", FIELDS, COMPARES, ("thousand", "million", "percent"))


@query("rul8_13_transitions", """
WITH v AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderstatus AS s, o_orderdate AS d FROM orders)
SELECT v.k, v.id, CASE WHEN v.s = 'P' THEN 'draft' WHEN n.id IS NULL THEN 'current' ELSE 'superseded' END AS validity, CASE WHEN v.s <> 'P' THEN n.id END AS replaced_by
FROM v LEFT JOIN (SELECT a.id AS old, arg_min(b.id, (b.d, b.id)) AS id FROM v a JOIN v b ON a.k = b.k AND b.s <> 'P' AND (b.d, b.id) > (a.d, a.id) GROUP BY 1) n ON n.old = v.id""")
def _(t: Tables) -> DataFrame:
    """RUL-8, RUL-13: what replaces what; drafts neither replace nor are replaced."""
    v = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_orderdate").alias("d"))
    # seen from the newest on, the last that is no draft before a row is what replaces it
    rows = R.carried(v, ["k"], [-F.unix_micros(F.col("d").cast("timestamp")), -F.col("id")], F.when(F.col("s") != "P", F.col("id")), "next")
    validity = F.when(F.col("s") == "P", "draft").when(F.col("next").isNull(), "current").otherwise("superseded")
    return rows.select("k", "id", validity.alias("validity"), F.when(F.col("s") != "P", F.col("next")).alias("replaced_by"))


_TITLES = ("拟认定名单公示", "认定名单", "撤销资格的通知", "继续支持名单", "重新认定名单", "拟复核名单", "复核通过名单", "复核对象名单", "更名公告", "科技型中小企业评价", "通知")
_RULE_ORDER = [(k, w, i) for i, (k, ws) in enumerate(U.EVENT_TERMS) for w in ws]


@query("rul12_event_kinds", f"""
WITH o AS (SELECT o_orderkey, {list(_TITLES)!r}[o_orderkey % {len(_TITLES)} + 1] || ' ' || CASE WHEN o_orderstatus = 'P' THEN '变更' ELSE '' END AS x, CASE WHEN o_custkey % 10 = 0 THEN '{U.ANNUAL_PROJECT}' ELSE '其他' END AS project FROM orders),
r(kind, term, i) AS (VALUES {', '.join(f"('{k}', '{w}', {i})" for k, w, i in _RULE_ORDER)})
SELECT o_orderkey, coalesce((SELECT arg_min(kind, i) FROM (SELECT kind, i FROM r WHERE contains(x, term) UNION ALL SELECT 'annual_evaluation', {[k for k, _ in U.EVENT_TERMS].index("annual_evaluation")} WHERE project = '{U.ANNUAL_PROJECT}')), 'recognition') AS kind FROM o""")
def _(t: Tables) -> DataFrame:
    """RUL-12: what kind of event a title and a status tell of, by the ordered terms."""
    title = F.element_at(F.array(*[F.lit(x) for x in _TITLES]), (F.col("o_orderkey") % len(_TITLES) + 1).cast("int"))
    project = F.when(F.col("o_custkey") % 10 == 0, U.ANNUAL_PROJECT).otherwise("其他")
    return t.orders.select("o_orderkey", U.event_kind(title, F.when(F.col("o_orderstatus") == "P", "变更"), project).alias("kind"))


_MODES = ("current-assessment", "forecast", "historical-fact", "pre-application")


@query("rul8_transition_routes", f"""
WITH g AS (SELECT p_brand AS family, p_type AS place, 'F' || min(p_partkey) AS formal, {['in_force', 'draft', 'invalid-expired']!r}[min(p_size) % 3 + 1] AS formal_status, CASE WHEN max(p_size) % 4 > 0 THEN 'N' || max(p_partkey) END AS prospective, {['draft', 'active_candidate', 'withdrawn']!r}[max(p_size) % 3 + 1] AS prospective_status, count(*) % 3 > 0 AS verified, max(p_size) % 5 > 0 AS replaces FROM part GROUP BY 1, 2),
q AS (SELECT c_custkey AS id, 'Brand#' || (c_custkey % 28) AS family, CASE c_nationkey % 4 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'PROMO' WHEN 2 THEN 'ECONOMY' ELSE 'NOWHERE' END AS place, {list(_MODES)!r}[c_custkey % 4 + 1] AS mode FROM customer),
j AS (SELECT q.*, g.* EXCLUDE (family, place), g.family IS NOT NULL AS known, mode IN ('forecast', 'pre-application') AND prospective IS NOT NULL AND prospective_status IN ('draft', 'active_candidate') AND verified AND replaces AS draft FROM q LEFT JOIN g ON g.family = q.family AND g.place = q.place)
SELECT id, CASE WHEN known THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN draft THEN prospective ELSE formal END AS primary_policy, CASE WHEN draft THEN prospective_status ELSE formal_status END AS primary_status, coalesce(known AND draft, false) AS draft_used,
  CASE WHEN known THEN CASE WHEN draft THEN 'current-formal-and-historical-only' WHEN mode = 'historical-fact' THEN 'historical-time-point-only' ELSE 'current-formal' END END AS old_policy_role, coalesce(known AND NOT draft AND mode <> 'historical-fact' AND formal_status = 'in_force', false) AS formal_allowed FROM j""")
def _(t: Tables) -> DataFrame:
    """RUL-8: the policy that a place and a purpose lead to, and what it may be used for."""
    pick = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), (c % len(names) + 1).cast("int"))
    low, high = F.min("p_size"), F.max("p_size")
    registry = t.part.groupBy(F.col("p_brand").alias("family"), F.col("p_type").alias("place")).agg(
        F.concat(F.lit("F"), F.min("p_partkey").cast("string")).alias("formal"), pick(("in_force", "draft", "invalid-expired"), low).alias("formal_status"),
        F.when(high % 4 > 0, F.concat(F.lit("N"), F.max("p_partkey").cast("string"))).alias("prospective"), pick(("draft", "active_candidate", "withdrawn"), high).alias("prospective_status"), (F.count("*") % 3 > 0).alias("verified"), (high % 5 > 0).alias("replaces"),
    )
    n = F.col("c_nationkey") % 4
    place = F.when(n == 0, "SMALL").when(n == 1, "PROMO").when(n == 2, "ECONOMY").otherwise("NOWHERE")
    requests = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Brand#"), (F.col("c_custkey") % 28).cast("string")).alias("family"), place.alias("place"), pick(_MODES, F.col("c_custkey")).alias("mode"))
    return U.transition_routes(registry, requests)


@query("rul13_supersession", r"""
WITH r AS (SELECT array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')[1:2], ' ') AS term, item_id % 7 AS priority, 'item ' || item_id AS replacement, CASE WHEN item_id % 2 = 0 THEN 'notice' ELSE 'text' END AS basis FROM benchmark),
u AS (SELECT term, min((priority, replacement, basis)) AS m FROM r GROUP BY 1), d AS (SELECT doc_id, lower(text) AS x, coalesce(lang = 'de', false) AS draft FROM documents),
b AS (SELECT doc_id, arg_min(u.term, (r.priority, r.term, r.replacement, r.basis)) AS term, min((r.priority, r.term, r.replacement, r.basis)) AS k FROM d JOIN r ON NOT draft AND r.term <> '' AND contains(x, r.term) JOIN u USING (term) GROUP BY 1)
SELECT d.doc_id, CASE WHEN draft THEN 'draft' WHEN b.doc_id IS NOT NULL THEN 'superseded' ELSE 'current' END AS validity, k[3] AS replacement, k[4] AS basis FROM d LEFT JOIN b ON b.doc_id = d.doc_id""")
def _(t: Tables) -> DataFrame:
    """RUL-13: which documents a table of term rules says are superseded, by what and on what basis; drafts are exempt."""
    n = F.col("item_id")
    rules = t.benchmark.select(F.array_join(F.slice(T.words(F.col("text")), 1, 2), " ").alias("term"), (n % 7).alias("priority"), F.concat(F.lit("item "), n.cast("string")).alias("replacement"), F.when(n % 2 == 0, "notice").otherwise("text").alias("basis"))
    docs = t.documents.select("doc_id", F.lower("text").alias("x"), "lang")
    return U.supersession(docs, "doc_id", "x", F.col("lang") == "de", rules)


@query("flt15_routing_table", """
WITH asked AS (SELECT c_custkey AS id, ['volume', 'compact', 'offers', 'antiques'][c_custkey % 4 + 1] AS list, ['brand', 'size', 'colour'][c_custkey % 3 + 1] AS field, CASE WHEN c_custkey % 3 = 0 THEN 'Brand#' || (c_custkey % 26) ELSE (c_custkey % 50)::VARCHAR END AS wanted, c_custkey % 700 - 100 AS size, c_nationkey * 7 - 20 AS start FROM customer),
kinds(list, type) AS (VALUES ('volume', 'STANDARD'), ('volume', 'LARGE'), ('compact', 'SMALL'), ('compact', 'MEDIUM'), ('offers', 'ECONOMY'), ('offers', 'PROMO')),
c AS (SELECT list, 'brand' AS field, p_brand AS wanted, count(*) AS total FROM part JOIN kinds ON p_type = type GROUP BY 1, 3 UNION ALL SELECT list, 'size', p_size::VARCHAR, count(*) FROM part JOIN kinds ON p_type = type GROUP BY 1, 3)
SELECT id, CASE WHEN a.list = 'antiques' THEN 'unknown list' WHEN a.field = 'colour' THEN 'unsupported filter' ELSE 'accepted' END AS status, CASE WHEN a.list <> 'antiques' AND a.field <> 'colour' THEN coalesce(total, 0) END AS total, least(greatest(size, 1), 200) AS page_size, greatest(start, 0) AS first,
  CASE WHEN a.list <> 'antiques' AND a.field <> 'colour' THEN coalesce(total, 0) > greatest(start, 0) + least(greatest(size, 1), 200) END AS has_more FROM asked a LEFT JOIN c ON c.list = a.list AND c.field = a.field AND c.wanted = a.wanted""")
def _(t: Tables) -> DataFrame:
    """FLT-15: a table of requests to the list families that answer for them, with the rows each would get."""
    k = F.col("c_custkey")
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    wanted = F.when(k % 3 == 0, F.concat(F.lit("Brand#"), (k % 26).cast("string"))).otherwise((k % 50).cast("string"))
    asked = t.customer.select(k.alias("id"), pick("volume", "compact", "offers", "antiques").alias("list"), pick("brand", "size", "colour").alias("field"), wanted.alias("wanted"), (k % 700 - 100).alias("size"), (F.col("c_nationkey") * 7 - 20).alias("start"))
    kinds = t.spark.createDataFrame([("volume", "STANDARD"), ("volume", "LARGE"), ("compact", "SMALL"), ("compact", "MEDIUM"), ("offers", "ECONOMY"), ("offers", "PROMO")], "list string, p_type string")
    return R.route_requests(asked, t.part.join(F.broadcast(kinds), "p_type"), "list", {"brand": "p_brand", "size": "p_size"})


@query("rul11_lineage_validators", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, l_returnflag, o_orderkey, o_orderdate, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS same FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P')
SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN same > 1 THEN 'duplicate' END, CASE WHEN o_orderkey IS NULL THEN 'no source' END, CASE WHEN l_shipdate < o_orderdate THEN 'before its source' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'enumeration' END, CASE WHEN l_quantity IS NULL OR l_quantity > 49 THEN 'range' END], lambda x: x IS NOT NULL)) AS problem FROM l""")
def _(t: Tables) -> DataFrame:
    """RUL-11: records against what they rest on: duplicates, missing sources, dates before the source's, enumerations, ranges."""
    sources = t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderdate")
    checks = {"before its source": F.col("l_shipdate") < F.col("o_orderdate"), "enumeration": ~F.col("l_returnflag").isin("A", "N"), "range": F.col("l_quantity").isNull() | (F.col("l_quantity") > 49)}
    return E.validate_lineage(t.lineitem, ["l_orderkey", "l_linenumber"], sources, F.col("l_orderkey") == F.col("o_orderkey"), "o_orderkey", checks)


@query("rul10_claim_matrix", r"""
WITH b AS (SELECT item_id AS claim, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark), f AS (SELECT DISTINCT claim, array_to_string(w[i:i + 2], ' ') AS feature FROM (SELECT claim, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS feature FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
m AS (SELECT claim, doc_id, count(*) AS shared FROM f JOIN g USING (feature) GROUP BY 1, 2), n AS (SELECT claim, count(*) AS features FROM f GROUP BY 1)
SELECT claim, doc_id, shared, CASE WHEN shared >= 0.8 * features THEN 'disclosed' WHEN shared >= 0.3 * features THEN 'partial' ELSE 'trace' END AS status FROM m JOIN n USING (claim)""")
def _(t: Tables) -> DataFrame:
    """RUL-10: claims against documents by the features (runs of three words) of a claim that a document holds."""
    w = T.words(F.col("text"))
    f = t.benchmark.select(F.col("item_id").alias("claim"), F.explode(D.grams(w, F.lit(3))).alias("g")).select("claim", F.col("g.gram").alias("feature")).distinct()
    n = f.groupBy("claim").agg(F.count("*").alias("features"))
    held = D.dictionary_matches(t.documents, f.select(F.col("feature").alias("term"))).select("doc_id", F.col("term").alias("feature"))
    m = held.join(f, "feature").groupBy("claim", "doc_id").agg(F.count("*").alias("shared")).join(n, "claim")
    return m.select("claim", "doc_id", "shared", F.when(F.col("shared") >= F.col("features") * 0.8, "disclosed").when(F.col("shared") >= F.col("features") * 0.3, "partial").otherwise("trace").alias("status"))


@query("rul10_prior_art")
def _(t: Tables) -> DataFrame:
    """RUL-10: the sentences of the benchmark as features against the sentences of all documents: terms, likeness, the best passages."""
    sentences = lambda rows, key, name: rows.select(F.col(key).alias(name), F.posexplode(T.clauses(F.coalesce("text", F.lit("")))).alias("locator", "text"))
    f = sentences(t.benchmark, "item_id", "claim")
    terms = F.slice(F.array_distinct(F.filter(T.words(F.col("text")), lambda w: F.length(w) >= 9)), 1, 8)
    features = f.select(F.concat_ws("-", F.col("claim").cast("string"), F.col("locator").cast("string")).alias("feature"), "text", terms.alias("terms"))
    found = P.prior_art_matrix(features, sentences(t.documents, "doc_id", "document"))
    first = F.get("candidates", F.lit(0))
    return found.select("feature", "document", "status", "basis", F.size("candidates").alias("n_candidates"), first["locator"].alias("locator"), F.array_join(first["terms"], ",").alias("terms"), first["score"].alias("score"))


@query("rul11_15_validators", """
WITH d AS (SELECT doc_id, text, lang, n_chars, count(*) OVER (PARTITION BY doc_id) AS same FROM documents)
SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' END, CASE WHEN n_chars <> length(text) THEN 'length' END, CASE WHEN same > 1 THEN 'duplicate' END], lambda x: x IS NOT NULL)) AS problem FROM d) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    """RUL-11: required fields, enumerations, lengths, duplicate ids."""
    twice = t.documents.groupBy("doc_id").agg(F.count("*").alias("same")).filter("same > 1")
    d = t.documents.select("doc_id", "text", "lang", "n_chars").join(twice, "doc_id", "left")
    checks = {
        "empty": F.col("text").isNull() | (F.trim("text") == ""),
        "language": ~F.col("lang").isin("en", "de", "fr"),
        "length": F.col("n_chars") != F.length("text"),
        "duplicate": F.col("same") > 1,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return d.select(F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("srt9_review_queue", "SELECT p_partkey, p_size * 2 + CASE WHEN p_retailprice > 1500 THEN 30 ELSE 0 END AS priority FROM part ORDER BY priority DESC, p_partkey LIMIT 50")
def _(t: Tables) -> DataFrame:
    """SRT-9: the head of a review queue by impact."""
    priority = F.col("p_size") * 2 + F.when(F.col("p_retailprice") > 1500, 30).otherwise(0)
    return t.part.select("p_partkey", priority.alias("priority")).orderBy(F.desc("priority"), "p_partkey").limit(50)


@query("ups2_composite_identity", """
WITH o AS (SELECT l_orderkey || ':' || l_linenumber AS k, min(l_linestatus) AS content FROM lineitem GROUP BY 1), n AS (SELECT l_orderkey || ':' || l_linenumber AS k, min(l_returnflag) AS content FROM lineitem WHERE l_quantity < 5 GROUP BY 1)
SELECT o.k, coalesce(n.content, o.content) AS content, CASE WHEN n.content <> o.content THEN 2 ELSE 1 END AS version FROM o LEFT JOIN n ON o.k = n.k""")
def _(t: Tables) -> DataFrame:
    """UPS-2: identity from several parts, a new version where the content differs."""
    k = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("k")
    old = t.lineitem.groupBy(k).agg(F.min("l_linestatus").alias("content"), F.lit(1).alias("version"))
    new = t.lineitem.filter("l_quantity < 5").groupBy(k).agg(F.min("l_returnflag").alias("content"))
    return R.upsert_with_history(old, new, ["k"], ["content"]).drop("status")
