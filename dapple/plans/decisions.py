"""Rules, scores, lifecycles, graphs and incremental maintenance on the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dapple.operators import evidence as E
from dapple.operators import formula as M
from dapple.operators import graph as G
from dapple.operators import identity as I
from dapple.operators import lifecycle as L
from dapple.operators import relational as R
from dapple.operators import rules as U
from dapple.operators.ledger import RunLedger
from dapple.operators.storage import fresh_path
from dapple.plans.registry import Tables, query

RULE = {
    "all": [
        {"field": "balance", "op": "gte", "value": 0},
        {"any": [{"field": "n", "op": "gt", "value": 12}, {"field": "segment", "op": "in", "value": ["BUILDING", "MACHINERY"]}]},
        {"field": "spent", "op": "lt", "value": 2_000_000},
    ]
}
_FACTS = """
WITH o AS (SELECT o_custkey AS k, count(*) AS n, sum(CAST(round(o_totalprice) AS BIGINT)) AS spent FROM orders GROUP BY 1),
facts AS (SELECT c_custkey AS k, c_acctbal AS balance, c_mktsegment AS segment, c_nationkey AS nation, o.n, o.spent FROM customer LEFT JOIN o ON o.k = c_custkey)"""


def facts(t: Tables) -> DataFrame:
    """Facts of each customer; what was never seen is null."""
    o = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.sum(F.round("o_totalprice").cast("long")).alias("spent"))
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return c.join(o, "k", "left")


@query("rul1_2_three_valued", f"""{_FACTS}, p AS (SELECT k, balance >= 0 AND (n > 12 OR segment IN ('BUILDING', 'MACHINERY')) AND spent < 2000000 AS ok FROM facts)
SELECT k, CASE WHEN ok THEN 'passed' WHEN NOT ok THEN 'failed' ELSE 'pending' END AS status FROM p""")
def _(t: Tables) -> DataFrame:
    """RUL-1, RUL-2: a rule tree as one expression."""
    return facts(t).select("k", U.status_of(U.three_valued(RULE)).alias("status"))


@query("rul3_five_valued", f"""{_FACTS}, s AS (SELECT k,
 CASE WHEN balance IS NULL THEN 'unknown' WHEN nation % 4 = 0 THEN 'pending' WHEN balance >= 0 THEN 'passed' ELSE 'failed' END AS a,
 CASE WHEN segment = 'BUILDING' THEN CASE WHEN n IS NULL THEN 'unknown' WHEN n > 15 THEN 'failed' ELSE 'passed' END ELSE 'not_applicable' END AS b FROM facts)
SELECT k, CASE WHEN 'failed' IN (a, b) THEN 'failed' WHEN 'pending' IN (a, b) THEN 'pending' WHEN 'unknown' IN (a, b) THEN 'unknown' WHEN 'passed' IN (a, b) THEN 'passed' ELSE 'not_applicable' END AS status FROM s""")
def _(t: Tables) -> DataFrame:
    """RUL-3: five statuses with evidence, an exclusion and a part that applies to some only."""
    tree = {
        "all": [
            {"field": "balance", "op": "gte", "value": 0, "evidence": "state"},
            {"field": "n", "op": "gt", "value": 15, "exclusion": True, "when": {"field": "segment", "op": "eq", "value": "BUILDING"}},
        ]
    }
    rows = facts(t).withColumn("state", F.when(F.col("nation") % 4 == 0, "candidate").otherwise("verified"))
    return rows.select("k", U.five_valued(tree).alias("status"))


@query("rul4_conclusion", f"""{_FACTS}, s AS (SELECT k, [CASE WHEN balance < -900 THEN 'blocked' ELSE 'passed' END, CASE WHEN n IS NULL THEN 'unknown' WHEN n < 3 THEN 'failed' ELSE 'passed' END, CASE WHEN nation % 4 = 0 THEN 'pending' ELSE 'passed' END] AS s FROM facts)
SELECT k, CASE WHEN list_contains(s, 'blocked') THEN 'blocked' WHEN list_contains(s, 'failed') THEN 'ineligible' WHEN list_contains(s, 'unknown') THEN 'undetermined' WHEN list_contains(s, 'pending') THEN 'conditional' ELSE 'eligible' END AS conclusion FROM s""")
def _(t: Tables) -> DataFrame:
    """RUL-4."""
    n = F.col("n")
    s = F.array(F.when(F.col("balance") < -900, "blocked").otherwise("passed"), F.when(n.isNull(), "unknown").when(n < 3, "failed").otherwise("passed"), F.when(F.col("nation") % 4 == 0, "pending").otherwise("passed"))
    return facts(t).select("k", U.conclusion(s).alias("conclusion"))


@query("rul5_growth_stage", f"{_FACTS} SELECT k, CASE WHEN n IS NULL THEN 'start' WHEN n >= 15 AND spent > 2000000 THEN 'leading' WHEN n >= 10 THEN 'growing' ELSE 'early' END AS stage FROM facts")
def _(t: Tables) -> DataFrame:
    """RUL-5."""
    stage = F.when(F.col("n").isNull(), "start").when((F.col("n") >= 15) & (F.col("spent") > 2000000), "leading").when(F.col("n") >= 10, "growing").otherwise("early")
    return facts(t).select("k", stage.alias("stage"))


@query("rul14_dependency_checks", """
WITH c AS (SELECT o_orderkey AS k, o_totalprice > 1000 AS a, o_orderstatus <> 'P' AS b, year(o_orderdate) > 1993 AS d FROM orders)
SELECT k, CASE WHEN a THEN 'passed' ELSE 'failed' END AS first, CASE WHEN NOT a THEN 'blocked' WHEN b THEN 'passed' ELSE 'failed' END AS second, CASE WHEN NOT a OR NOT b THEN 'blocked' WHEN d THEN 'passed' ELSE 'failed' END AS third FROM c""")
def _(t: Tables) -> DataFrame:
    """RUL-14: a check is blocked if one it depends on did not pass."""
    checks = {"first": F.col("o_totalprice") > 1000, "second": F.col("o_orderstatus") != "P", "third": F.year("o_orderdate") > 1993}
    out, fine, cols = t.orders, F.lit(True), []
    for name, ok in checks.items():
        cols.append(F.when(~fine, "blocked").when(ok, "passed").otherwise("failed").alias(name))
        fine = fine & ok
    return out.select(F.col("o_orderkey").alias("k"), *cols)


@query("agg13_fact_ledger", """
WITH v AS (SELECT user_id, event_type, count(DISTINCT round(value, 0)) FILTER (value >= 5) AS kinds, bool_or(CAST(json_extract_string(props, '$.k') AS BIGINT) = 13) AS explicit, arg_max(round(value, 0), event_id) FILTER (value >= 5) AS last, arg_max(round(value, 0), event_id) FILTER (value IS NOT NULL) AS other FROM events GROUP BY 1, 2)
SELECT user_id, event_type, CASE WHEN explicit OR kinds > 1 THEN 'conflict' WHEN kinds = 1 THEN 'resolved' WHEN other IS NOT NULL THEN 'fallback' ELSE 'missing' END AS state, CASE WHEN explicit OR kinds > 1 THEN NULL WHEN kinds = 1 THEN last ELSE other END AS value FROM v""")
def _(t: Tables) -> DataFrame:
    """AGG-13: a stated conflict or different supporting values conflict; else the last supporting value holds, or the last other one."""
    v, supports = F.round("value", 0), F.col("value") >= 5
    stated = F.coalesce(F.get_json_object("props", "$.k").cast("long") == 13, F.lit(False))
    g = t.events.groupBy("user_id", "event_type").agg(
        F.count_distinct(F.when(supports, v)).alias("kinds"), F.max(stated).alias("explicit"), F.max_by(v, F.when(supports, F.col("event_id"))).alias("last"), F.max_by(v, F.when(F.col("value").isNotNull(), F.col("event_id"))).alias("other")
    )
    conflict, one = F.col("explicit") | (F.col("kinds") > 1), F.col("kinds") == 1
    state = F.when(conflict, "conflict").when(one, "resolved").when(F.col("other").isNotNull(), "fallback").otherwise("missing")
    return g.select("user_id", "event_type", state.alias("state"), F.when(~conflict, F.when(one, F.col("last")).otherwise(F.col("other"))).alias("value"))


@query("rul7_evidence", """
WITH c AS (SELECT o_custkey AS subject, o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'original' WHEN 'P' THEN 'citation' ELSE 'basis' END AS role, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS channel, year(o_orderdate) AS y, o_totalprice > 100000 AS official, o_orderkey % 4 <> 0 AS in_force, CASE WHEN o_orderkey % 3 = 0 THEN ['deadline', 'bonus'] END AS quoted FROM orders),
a AS (SELECT subject, arg_min({'id': id, 'role': role, 'quoted': quoted}, (CASE role WHEN 'original' THEN 0 ELSE 1 END, channel, id)) FILTER (official AND role IN ('original', 'citation') AND y = 1996) AS a, arg_min(id, (-y, channel, id)) FILTER (official AND role = 'basis' AND in_force) AS s FROM c GROUP BY 1),
w AS (SELECT *, list_concat(CASE WHEN s IS NULL THEN [] ELSE ['threshold'] END, CASE WHEN a IS NULL THEN [] ELSE ['batch', 'deadline'] END) AS wide FROM a),
l AS (SELECT *, CASE WHEN a IS NULL OR a.quoted IS NULL THEN wide WHEN a.role = 'citation' THEN list_filter(wide, lambda x: x = 'threshold' OR list_contains(a.quoted, x)) ELSE list_distinct(list_concat(wide, a.quoted)) END AS allowed FROM w)
SELECT subject, CASE WHEN a.role = 'original' THEN 'original' WHEN a IS NOT NULL THEN 'citation_fallback' WHEN s IS NOT NULL THEN 'baseline_only' ELSE 'not_found' END AS status, a.id AS annual_id, s AS stable_id, array_to_string(list_sort(allowed), ',') AS allowed,
 array_to_string(list_filter(['batch', 'bonus', 'deadline', 'threshold'], lambda x: NOT list_contains(allowed, x)), ',') AS prohibited, a IS NOT NULL AND list_contains(allowed, 'batch') AND list_contains(allowed, 'deadline') AS conclusive FROM l""")
def _(t: Tables) -> DataFrame:
    """RUL-7: the best source of a year with fallback, the stable one beside it, what may be claimed and what not."""
    k = F.col("o_orderkey")
    c = t.orders.select(
        F.col("o_custkey").alias("subject"), k.alias("id"), F.when(F.col("o_orderstatus") == "O", "original").when(F.col("o_orderstatus") == "P", "citation").otherwise("basis").alias("role"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("channel"), F.year("o_orderdate").alias("year"), (F.col("o_totalprice") > 100000).alias("official"), (k % 4 != 0).alias("in_force"),
        F.when(k % 3 == 0, F.array(F.lit("deadline"), F.lit("bonus"))).alias("quoted"),
    )
    got = E.select_evidence(c, "subject", 1996, ["deadline", "batch", "threshold", "bonus"], ["batch", "deadline"], ["threshold"])
    return got.withColumns({n: F.array_join(n, ",") for n in ("allowed", "prohibited")})


#: What the positions of a statement stand for here.
_POSITIONS = {
    "revenue": "spent", "cost": "spent * 0.6", "net_profit": "balance", "profit_before_tax": "balance * 1.25", "interest": "n * 11", "assets": "spent * 2", "assets_open": "spent * 1.5", "equity": "spent + balance", "equity_open": "spent",
    "liabilities": "spent - balance", "current_assets": "spent * 0.8", "current_liabilities": "n * 1013", "inventory": "spent * 0.1", "inventory_open": "spent * 0.2", "cash": "balance", "receivables": "n * 500", "receivables_open": "n * 400",
    "other_receivables": "n * 7", "advances": "n * 3", "research": "spent * 0.05", "taxes_paid": "spent * 0.03", "sales_cash": "spent * 0.9", "operating_cash": "balance * 2", "capex": "n * 50",
}
_RATIO_SQL = {
    "gross_margin": "(revenue - cost) / nullif(revenue, 0)", "net_margin": "net_profit / nullif(revenue, 0)", "debt_ratio": "liabilities / nullif(assets, 0)", "current_ratio": "current_assets / nullif(current_liabilities, 0)",
    "quick_ratio": "(current_assets - inventory) / nullif(current_liabilities, 0)", "cash_ratio": "cash / nullif(current_liabilities, 0)", "roe": "net_profit / nullif((equity + equity_open) / 2, 0)", "roa": "net_profit / nullif((assets + assets_open) / 2, 0)",
    "ar_days": "(receivables + receivables_open) / 2 / nullif(revenue, 0) * 365", "inventory_days": "(inventory + inventory_open) / 2 / nullif(cost, 0) * 365", "other_ar_to_assets": "other_receivables / nullif(assets, 0)",
    "other_ar_to_revenue": "other_receivables / nullif(revenue, 0)", "advance_to_revenue": "advances / nullif(revenue, 0)", "research_to_revenue": "research / nullif(revenue, 0)", "cash_tax_payment_rate": "taxes_paid / nullif(revenue, 0)",
    "sales_cash_to_revenue": "sales_cash / nullif(revenue, 0)", "ocf_to_profit": "operating_cash / nullif(net_profit, 0)", "free_cash_flow": "operating_cash - capex", "interest_coverage": "(profit_before_tax + interest) / nullif(interest, 0)", "working_capital": "current_assets - current_liabilities",
}


@query("mth1_ratios", f"{_FACTS}, p AS (SELECT k, {', '.join(f'CAST({x} AS DOUBLE) AS {n}' for n, x in _POSITIONS.items())} FROM facts) SELECT k, {', '.join(f'round({x}, 4) + 0.0 AS {n}' for n, x in _RATIO_SQL.items())} FROM p")
def _(t: Tables) -> DataFrame:
    """MTH-1: the twenty ratios; null where a part is missing or a divisor is 0. The positions are formulas over the facts (MTH-8)."""
    inputs = {c: F.col(c) for c in ("spent", "balance", "n")}
    rows = facts(t).select("k", *[M.formula(x, inputs).alias(n) for n, x in _POSITIONS.items()])
    return rows.select("k", *[F.round(c, 4).alias(n) for n, c in M.ratios({n: F.col(n) for n in _POSITIONS}).items()])


@query("mth2_share", """
WITH n AS (SELECT c_nationkey AS n, sum(CAST(round(o_totalprice) AS BIGINT)) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), s AS (SELECT n, v, round(v / (SELECT sum(v) FROM n) * 100, 4) AS share FROM n)
SELECT n, share, CASE WHEN share >= 5 THEN 'A' WHEN share >= 4 THEN 'B' WHEN share >= 3.5 THEN 'C' ELSE 'D' END AS grade FROM s""")
def _(t: Tables) -> DataFrame:
    """MTH-2: market share with grades."""
    n = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n")).agg(F.sum(F.round("o_totalprice").cast("long")).alias("v"))
    s = n.crossJoin(F.broadcast(n.agg(F.sum("v").alias("all")))).select("n", F.round(F.col("v") / F.col("all") * 100, 4).alias("share"))
    return s.withColumn("grade", F.when(F.col("share") >= 5, "A").when(F.col("share") >= 4, "B").when(F.col("share") >= 3.5, "C").otherwise("D"))


@query("mth3_to_6_scores", f"""{_FACTS} SELECT k, CAST(CASE WHEN balance IS NULL THEN NULL WHEN balance >= 8000 THEN 10.0 WHEN balance >= 4000 THEN 6.0 WHEN balance >= 0 THEN 3.0 ELSE 0.0 END AS DOUBLE) AS band,
 CASE WHEN n IS NULL THEN NULL WHEN n < 5 THEN 0.0 WHEN 2 + floor((n - 5) / 3.0) * 1.5 > 8 THEN 8.0 ELSE 2 + floor((n - 5) / 3.0) * 1.5 END AS steps,
 CAST(greatest(coalesce(n, 0) * 0.5, CASE WHEN segment = 'BUILDING' THEN 4.0 ELSE 1.0 END) AS DOUBLE) AS route, CASE WHEN balance BETWEEN 0 AND 5000 THEN round(balance / 1000, 6) END AS reviewed FROM facts""")
def _(t: Tables) -> DataFrame:
    """MTH-3 to MTH-6: banded, stepped, best of alternative routes, range-checked."""
    b = F.col("balance")
    route = F.greatest(F.coalesce("n", F.lit(0)) * 0.5, F.when(F.col("segment") == "BUILDING", 4.0).otherwise(1.0))
    return facts(t).select("k", U.banded(b, [(0, 3), (4000, 6), (8000, 10)]).alias("band"), U.stepped(F.col("n"), 5, 2, 3.0, 1.5, 8).alias("steps"), route.alias("route"), F.when(b.between(0, 5000), F.round(b / 1000, 6)).alias("reviewed"))


@query("mth7_scenarios", f"""{_FACTS}, y AS (SELECT o_custkey AS k, sum(CASE WHEN year(o_orderdate) = 1996 THEN CAST(round(o_totalprice) AS BIGINT) END) AS old, sum(CASE WHEN year(o_orderdate) = 1997 THEN CAST(round(o_totalprice) AS BIGINT) END) AS new FROM orders GROUP BY 1),
r AS (SELECT facts.k, n, (new - old) / nullif(CAST(old AS DOUBLE), 0) AS rate FROM facts LEFT JOIN y ON y.k = facts.k),
s AS (SELECT k, n, rate, CASE WHEN rate IS NULL OR rate <= 0 THEN 0 WHEN rate >= 0.35 THEN 9 WHEN rate >= 0.25 THEN 7 WHEN rate >= 0.15 THEN 5 WHEN rate >= 0.05 THEN 3 ELSE 1 END AS low, CASE WHEN rate IS NULL OR rate <= 0 THEN 0 WHEN rate >= 0.35 THEN 10 WHEN rate >= 0.25 THEN 8 WHEN rate >= 0.15 THEN 6 WHEN rate >= 0.05 THEN 4 ELSE 2 END AS high FROM r)
SELECT k, coalesce(n, 0) * 4 + high AS target, coalesce(n, 0) * 3 + low AS conservative, coalesce(n, 0) * 2 + low AS stress, CASE WHEN rate IS NULL THEN 'review' WHEN coalesce(n, 0) * 3 + low >= 45 THEN 'ready' WHEN coalesce(n, 0) * 3 + low >= 36 THEN 'borderline' ELSE 'not_ready' END AS readiness FROM s""")
def _(t: Tables) -> DataFrame:
    """MTH-7: growth bands, scenario totals, readiness by the conservative one."""
    o = t.orders.select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), F.round("o_totalprice").cast("long").alias("v"))
    o = o.groupBy("k").agg(F.sum(F.when(F.col("y") == 1996, F.col("v"))).alias("old"), F.sum(F.when(F.col("y") == 1997, F.col("v"))).alias("new"))
    rate = F.try_divide(F.col("new") - F.col("old"), F.col("old"))
    low, high = M.growth_scores(F.col("rate"))
    n = F.coalesce("n", F.lit(0))
    rows = facts(t).join(o, "k", "left").select("k", n.alias("n"), rate.alias("rate"))
    rows = rows.select("k", "rate", (F.col("n") * 4 + high).alias("target"), (F.col("n") * 3 + low).alias("conservative"), (F.col("n") * 2 + low).alias("stress"))
    ready = F.when(F.col("rate").isNull(), "review").when(F.col("conservative") >= 45, "ready").when(F.col("conservative") >= 36, "borderline").otherwise("not_ready")
    return rows.select("k", "target", "conservative", "stress", ready.alias("readiness"))


@query("mth8_formula", f"{_FACTS} SELECT k, round((spent - balance * 2) / nullif(CAST(n AS DOUBLE), 0) * 0.05 + -3, 4) AS result FROM facts")
def _(t: Tables) -> DataFrame:
    """MTH-8: a formula in text over declared inputs, checked against its grammar."""
    result = M.formula("(spent − balance × 2) ÷ n × 5% + -3 = 12".replace("−", "-"), {c: F.col(c) for c in ("spent", "balance", "n")})
    return facts(t).select("k", F.round(result, 4).alias("result"))


@query("mth9_units", """
WITH u AS (SELECT p_partkey, p_retailprice AS v, CASE p_size % 3 WHEN 0 THEN 'unit' WHEN 1 THEN 'thousand' ELSE 'dozen' END AS unit FROM part)
SELECT p_partkey, round(CASE unit WHEN 'unit' THEN v WHEN 'thousand' THEN v * 1000 END, 4) AS units FROM u""")
def _(t: Tables) -> DataFrame:
    """MTH-9: values in one unit by a table of factors; a unit that the table lacks gives null."""
    factors = t.spark.createDataFrame([("unit", 1.0), ("thousand", 1e3), ("million", 1e6)], "unit string, factor double")
    unit = F.when(F.col("p_size") % 3 == 0, "unit").when(F.col("p_size") % 3 == 1, "thousand").otherwise("dozen")
    return t.part.select("p_partkey", "p_retailprice", unit.alias("unit")).join(factors, "unit", "left").select("p_partkey", F.round(F.col("p_retailprice") * F.col("factor"), 4).alias("units"))


# lifecycle ----------------------------------------------------------------------------------------

_KIND = "CASE event_type WHEN 'signup' THEN 'published' WHEN 'purchase' THEN 'recognised' WHEN 'error' THEN 'revoked' ELSE 'other' END"
_AT = "date_diff('day', TIMESTAMP '2024-01-01', ts)"


def log(t: Tables) -> DataFrame:
    """The event log as lifecycle events, by day."""
    kind = F.when(F.col("event_type") == "signup", "published").when(F.col("event_type") == "purchase", "recognised").when(F.col("event_type") == "error", "revoked").otherwise("other")
    at = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    order = F.when(kind == "published", 0).when(kind == "recognised", 1).when(kind == "revoked", 2).otherwise(3)
    return L.replay(t.events.select("user_id", kind.alias("kind"), at.alias("at"), order.alias("o")), "user_id", F.col("at"), F.col("o"), F.col("kind"), 10)


_REPLAY = f"""
WITH e AS (SELECT user_id, {_AT} AS d, {_KIND} AS kind FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, CASE kind WHEN 'published' THEN 0 WHEN 'recognised' THEN 1 WHEN 'revoked' THEN 2 ELSE 3 END, kind) AS i FROM e),
s AS (SELECT *, max(CASE WHEN kind IN ('recognised', 'revoked') THEN i END) OVER w AS m, max(CASE WHEN kind = 'published' THEN i END) OVER w AS p FROM n WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT s.user_id, CAST(s.i AS INTEGER) AS step, s.kind, CASE WHEN s.m IS NOT NULL THEN CASE m.kind WHEN 'recognised' THEN 'active' ELSE 'revoked' END WHEN s.p IS NOT NULL THEN 'published' ELSE 'none' END AS state,
 CASE m.kind WHEN 'recognised' THEN m.d + 10 WHEN 'revoked' THEN m.d END AS valid_until FROM s LEFT JOIN n m ON m.user_id = s.user_id AND m.i = s.m"""


@query("win4_5_replay", _REPLAY)
def _(t: Tables) -> DataFrame:
    """WIN-4: the state after each event."""
    return log(t).select("user_id", "step", "kind", "state", "valid_until")


@query("win5_verify_replay", f"""
WITH r AS ({_REPLAY}) SELECT user_id, step, CASE WHEN step % 50 = 49 THEN 'missing' ELSE CASE WHEN state <> 'none' AND step % 50 = 7 THEN CASE WHEN step % 100 = 7 THEN 'state,valid_until' ELSE 'state' END ELSE 'valid_until' END END AS problem
FROM r WHERE step % 50 = 49 OR (state <> 'none' AND step % 50 = 7) OR step % 100 = 7""")
def _(t: Tables) -> DataFrame:
    """WIN-5: stored steps replayed and compared. (Here some stored ones are missing or spoilt.)"""
    replayed = log(t)
    spoilt = replayed.filter("step % 50 <> 49").withColumns({"state": F.when(F.col("step") % 50 == 7, "none").otherwise(F.col("state")), "valid_until": F.when(F.col("step") % 100 == 7, -1).otherwise(F.col("valid_until"))})
    return E.verify_replay(spoilt, replayed, ["user_id", "step"], ["state", "valid_until"])


@query("win6_as_of", f"""
WITH e AS (SELECT user_id, {_AT} AS d, {_KIND} AS kind FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, CASE kind WHEN 'published' THEN 0 WHEN 'recognised' THEN 1 WHEN 'revoked' THEN 2 ELSE 3 END, kind) AS i FROM e),
l AS (SELECT user_id, arg_max(kind, i) FILTER (d <= 15 AND kind IN ('recognised', 'revoked')) AS kind, arg_max(d, i) FILTER (d <= 15 AND kind IN ('recognised', 'revoked')) AS d, bool_or(d <= 15 AND kind = 'published') AS p FROM n GROUP BY 1)
SELECT user_id, CASE WHEN kind = 'recognised' THEN CASE WHEN d + 10 < 15 THEN 'expired' ELSE 'active' END WHEN kind = 'revoked' THEN 'revoked' WHEN p THEN 'published' ELSE 'none' END AS state, CASE kind WHEN 'recognised' THEN d + 10 WHEN 'revoked' THEN d END AS valid_until FROM l""")
def _(t: Tables) -> DataFrame:
    """WIN-6: the state of each subject on day 15."""
    return L.as_of(log(t), "user_id", F.lit(15).cast("long"))


_KINDS = ("recognition_publicity", "recognition", "review_due", "review_publicity", "continued_support", "annual_evaluation", "review_passed", "re_recognition", "changed", "revoked", "unheard_of")


def lifecycle(t: Tables) -> DataFrame:
    """The event log as events of all kinds: a day is a year, some have none; a third of the subjects have open validity."""
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.pmod(F.col("event_id") * 7 + F.length("event_type"), F.lit(len(_KINDS))) + 1).cast("int"))
    year = F.when(F.col("event_id") % 37 != 0, 1995 + F.dayofmonth("ts"))
    return L.lifecycle_steps(t.events, "user_id", year, kind, F.col("event_type"), F.when(F.col("user_id") % 3 != 0, 3))


_LIFECYCLE = f"""
WITH e AS (SELECT user_id, CASE WHEN event_id % 37 <> 0 THEN 1995 + day(ts) END::INTEGER AS year, {list(_KINDS)!r}[(event_id * 7 + length(event_type)) % {len(_KINDS)} + 1] AS kind, event_type AS status FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(year, 0), list_position({list(L.PRECEDENCE)!r}, kind) NULLS FIRST, status, kind) AS step FROM e),
f AS (SELECT user_id, step, year, kind, 'not_recorded' AS previous_state,
  CASE kind WHEN 'recognition_publicity' THEN 'publicity_pending' WHEN 'review_due' THEN 'review_due' WHEN 'review_publicity' THEN 'review_pending' WHEN 'revoked' THEN 'revoked' WHEN 'changed' THEN 'not_recorded' WHEN 'continued_support' THEN 'not_recorded' WHEN 'unheard_of' THEN 'not_recorded' ELSE 'active' END AS state,
  CASE WHEN kind IN {L.ACTIVATING!r} AND user_id % 3 <> 0 THEN year + 3 WHEN kind = 'revoked' THEN year END AS valid_through FROM o WHERE step = 1
  UNION ALL SELECT o.user_id, o.step, o.year, o.kind, f.state,
  CASE o.kind WHEN 'recognition_publicity' THEN CASE f.state WHEN 'not_recorded' THEN 'publicity_pending' ELSE f.state END WHEN 'review_due' THEN 'review_due' WHEN 'review_publicity' THEN 'review_pending' WHEN 'revoked' THEN 'revoked' WHEN 'changed' THEN f.state WHEN 'continued_support' THEN f.state WHEN 'unheard_of' THEN f.state ELSE 'active' END,
  CASE WHEN o.kind IN {L.ACTIVATING!r} AND o.year IS NOT NULL THEN CASE WHEN o.user_id % 3 <> 0 THEN o.year + 3 END WHEN o.kind = 'revoked' THEN o.year ELSE f.valid_through END
  FROM f JOIN o ON o.user_id = f.user_id AND o.step = f.step + 1)"""
_LIFECYCLE = _LIFECYCLE.replace("WITH e AS", "WITH RECURSIVE e AS", 1)


@query("win4_lifecycle", f"{_LIFECYCLE} SELECT * FROM f")
def _(t: Tables) -> DataFrame:
    """WIN-4: all kinds of events, the state before and after each, open validity."""
    return lifecycle(t)


@query("win6_lifecycle_as_of", f"""{_LIFECYCLE}, l AS (SELECT user_id, arg_max(state, step) FILTER (year IS NULL OR year <= 2010) AS state, max(step) FILTER (year IS NULL OR year <= 2010) AS last_step FROM f GROUP BY 1)
SELECT l.user_id, CASE WHEN l.state = 'active' AND f.valid_through < 2010 THEN 'expired_pending_review' ELSE coalesce(l.state, 'not_recorded') END AS state, f.valid_through, l.last_step FROM l LEFT JOIN f ON f.user_id = l.user_id AND f.step = l.last_step""")
def _(t: Tables) -> DataFrame:
    """WIN-6: where each subject stands at the end of a year."""
    return L.lifecycle_as_of(lifecycle(t), "user_id", 2010)


# graphs -------------------------------------------------------------------------------------------


def trade(t: Tables) -> DataFrame:
    """Suppliers of an order as a star around the smallest of them: edges that connect what delivered together."""
    orders = t.lineitem.filter("l_orderkey IS NOT NULL").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("own"))
    return orders.select(F.array_min("own").alias("src"), F.explode("own").alias("dst")).filter("src < dst").distinct()


_TRADE = """
edges AS (SELECT DISTINCT a.src, l.l_suppkey AS dst FROM lineitem l JOIN (SELECT l_orderkey, min(l_suppkey) AS src FROM lineitem GROUP BY 1) a ON a.l_orderkey = l.l_orderkey WHERE a.src < l.l_suppkey)"""


@query("grf1_components", f"""
WITH RECURSIVE {_TRADE}, both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), walk AS (SELECT src AS node, src AS seen FROM both_ UNION SELECT w.node, b.dst FROM walk w JOIN both_ b ON b.src = w.seen)
SELECT node, min(seen) AS component FROM walk GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    """GRF-1."""
    return G.connected_components(trade(t))


@query("grf2_3_reachable", f"""
WITH RECURSIVE {_TRADE}, walk AS (SELECT DISTINCT src AS start, src AS node, 0 AS distance FROM edges UNION SELECT w.start, e.dst, w.distance + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.distance < 3),
near AS (SELECT start, node, min(distance) AS distance FROM walk GROUP BY 1, 2)
SELECT n.start, n.node, n.distance, min(p.node) AS via FROM near n LEFT JOIN (near p JOIN edges e ON e.src = p.node) ON p.start = n.start AND e.dst = n.node AND p.distance = n.distance - 1 GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    """GRF-2, GRF-3: reached within three steps from every start, by the first discovery, with the edge that led there."""
    e = trade(t)
    return G.reachable(e, e.select(F.col("src").alias("node")).distinct(), 3)


@query("grf4_5_paths", """
WITH o AS (SELECT 'o' || o_orderkey AS o, 'c' || o_custkey AS c FROM orders), c AS (SELECT 'c' || c_custkey AS c, 'n' || c_nationkey AS n FROM customer), n AS (SELECT 'n' || n_nationkey AS n, 'r' || n_regionkey AS r FROM nation)
SELECT o || '>' || o.c || '>' || c.n || '>' || r AS path, 3 AS steps FROM o JOIN c ON o.c = c.c JOIN n ON c.n = n.n""")
def _(t: Tables) -> DataFrame:
    """GRF-4, GRF-5: all paths of every order's lineage to its roots, cycles cut."""
    mark = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    up = lambda d, a, x, b, y: d.select(mark(a, x).alias("src"), mark(b, y).alias("dst"))
    e = up(t.orders, "o", "o_orderkey", "c", "o_custkey").unionAll(up(t.customer, "c", "c_custkey", "n", "c_nationkey")).unionAll(up(t.nation, "n", "n_nationkey", "r", "n_regionkey"))
    got = G.paths(e, t.orders.select(mark("o", "o_orderkey").alias("node")), 3)
    roots = got.filter(F.element_at("path", -1).startswith("r"))
    return roots.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("steps"))


@query("grf6_9_property_graph", """
SELECT 'nation' AS kind, 'n' || n_nationkey AS id, 'r' || n_regionkey AS target FROM nation UNION ALL SELECT 'supplier', 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'customer', 'c' || c_custkey, 'n' || c_nationkey FROM customer""")
def _(t: Tables) -> DataFrame:
    """GRF-6: nodes of several kinds with their edges."""

    def kind(rows: DataFrame, name: str, key: str, to: str, mark: str) -> DataFrame:
        return rows.select(F.lit(name).alias("kind"), F.concat(F.lit(name[0]), F.col(key).cast("string")).alias("id"), F.concat(F.lit(mark), F.col(to).cast("string")).alias("target"))

    out = kind(t.nation, "nation", "n_nationkey", "n_regionkey", "r")
    return out.unionAll(kind(t.supplier, "supplier", "s_suppkey", "s_nationkey", "n")).unionAll(kind(t.customer, "customer", "c_custkey", "c_nationkey", "n"))


@query("grf7_8_identity", """
WITH a AS (SELECT p_name AS alias, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types, count(*) AS n, min(p_partkey) AS k, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS paths FROM part WHERE p_size > 25 GROUP BY 1)
SELECT alias, CASE WHEN brands > 1 AND types > 1 THEN 'conflict_both' WHEN brands > 1 THEN 'conflict_brand' WHEN types > 1 THEN 'conflict_type' WHEN n > 1 THEN 'merged' ELSE 'unique' END AS status, CASE WHEN brands = 1 AND types = 1 THEN k END AS identity, CASE WHEN brands > 1 THEN paths END AS conflict_paths FROM a""")
def _(t: Tables) -> DataFrame:
    """GRF-7, GRF-8: what an alias stands for, and by which paths it conflicts."""
    a = t.part.filter("p_size > 25").groupBy(F.col("p_name").alias("alias")).agg(F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("types"), F.count("*").alias("n"), F.min("p_partkey").alias("k"), F.array_join(F.array_sort(F.collect_set("p_brand")), "|").alias("paths"))
    b, y = F.col("brands") > 1, F.col("types") > 1
    status = F.when(b & y, "conflict_both").when(b, "conflict_brand").when(y, "conflict_type").when(F.col("n") > 1, "merged").otherwise("unique")
    return a.select("alias", status.alias("status"), F.when(~b & ~y, F.col("k")).alias("identity"), F.when(b, F.col("paths")).alias("conflict_paths"))


_CODE = "upper(substr(sha256(p_name || '/' || p_size), 1, 18))"


def part_code() -> Column:
    return F.upper(F.substring(F.sha2(F.concat_ws("/", "p_name", F.col("p_size").cast("string")), 256), 1, 18))


def part_nodes(t: Tables) -> DataFrame:
    """Names of a brand as subjects: its parts' types make former names, their sizes codes, the large ones were merged into it."""
    name = F.concat_ws(" ", "p_name", "p_brand")
    code, merged = F.when(F.col("p_size") % 10 != 0, part_code()), F.when(F.col("p_size") > 45, F.concat(F.lit("part:"), F.col("p_partkey").cast("string")))
    return I.columns_of_nodes(t.part, name, current_name=name, former_name=F.concat_ws(" ", "p_name", "p_type"), unified_social_credit_code=code, merged_subject=merged)


_NODES = f"""
nodes AS (SELECT DISTINCT p_name || ' ' || p_brand AS subject, unnest(['current_name', 'former_name', 'unified_social_credit_code', 'merged_subject']) AS node_type,
  unnest([p_name || ' ' || p_brand, p_name || ' ' || p_type, CASE WHEN p_size % 10 <> 0 THEN {_CODE} END, CASE WHEN p_size > 45 THEN 'part:' || p_partkey END]) AS value FROM part),
n AS (SELECT *, CASE WHEN node_type = 'unified_social_credit_code' THEN lower(value) ELSE lower(regexp_replace(value, '[^a-zA-Z0-9]+', '', 'g')) END AS v FROM nodes WHERE value IS NOT NULL),
names AS (SELECT DISTINCT subject, v FROM n WHERE node_type IN ('current_name', 'former_name')), codes AS (SELECT DISTINCT subject, value, v FROM n WHERE node_type = 'unified_social_credit_code'),
conflicts AS (
  SELECT 'same_name_multiple_subjects' AS kind, subject, v AS by, min(subject) OVER (PARTITION BY v) AS other FROM names QUALIFY count(*) OVER (PARTITION BY v) > 1
  UNION ALL SELECT 'code_multiple_subjects', subject, v, min(subject) OVER (PARTITION BY v) FROM codes QUALIFY count(*) OVER (PARTITION BY v) > 1
  UNION ALL SELECT 'subject_multiple_codes', subject, min(value) OVER (PARTITION BY subject), value FROM codes QUALIFY count(*) OVER (PARTITION BY subject) > 1
  UNION ALL SELECT 'missing_unified_social_credit_code', subject, NULL, value FROM n WHERE node_type = 'current_name' AND subject NOT IN (SELECT subject FROM codes)
  UNION ALL SELECT 'merged_subject', subject, NULL, value FROM n WHERE node_type = 'merged_subject')"""


@query("grf7_conflict_paths", f"WITH {_NODES} SELECT * FROM conflicts")
def _(t: Tables) -> DataFrame:
    """GRF-7: the five kinds of conflicts of the whole identity graph, each with the path to what it conflicts with."""
    return I.identity_conflicts(I.with_normal(part_nodes(t)))


@query("grf7_identity_lookup", f"""
WITH {_NODES}, q AS (SELECT p_partkey AS query_id, CASE p_partkey % 100 WHEN 0 THEN {_CODE} WHEN 1 THEN p_name || '-' || p_brand WHEN 2 THEN p_name || ' ' || p_type ELSE substr(p_name, 3) || ' ' || substr(p_brand, 1, 6) END AS query FROM part WHERE p_partkey % 100 < 4),
k AS (SELECT query_id, p_code, CASE WHEN p_code THEN lower(query) ELSE lower(regexp_replace(query, '[^a-zA-Z0-9]+', '', 'g')) END AS v FROM (SELECT *, regexp_matches(query, '^[0-9A-HJ-NPQRTUWXY]{{18}}$') AS p_code FROM q)),
hit AS (
  SELECT query_id, subject, node_type, value, 'code' AS mode, k.v, 0 AS first FROM k JOIN n ON k.p_code AND node_type = 'unified_social_credit_code' AND n.v = k.v
  UNION ALL SELECT query_id, subject, node_type, value, 'exact', k.v, 0 FROM k JOIN n ON NOT k.p_code AND node_type IN ('current_name', 'former_name') AND n.v = k.v
  UNION ALL SELECT query_id, subject, node_type, value, 'within', k.v, CASE node_type WHEN 'current_name' THEN 0 ELSE 1 END FROM k JOIN n ON NOT k.p_code AND node_type IN ('current_name', 'former_name') AND contains(n.v, k.v) WHERE k.v NOT IN (SELECT v FROM names)),
best AS (SELECT query_id, subject, node_type AS matched_by, arg_min(value, place) AS value, any_value(mode) AS mode, any_value(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, subject, node_type, value) AS place FROM hit) WHERE place <= 20 GROUP BY 1, 2, 3)
SELECT b.query_id, b.subject, b.matched_by, b.value, coalesce(string_agg(DISTINCT c.kind, ',' ORDER BY c.kind) FILTER (CASE c.kind WHEN 'same_name_multiple_subjects' THEN c.by = b.v AND b.mode <> 'code' WHEN 'code_multiple_subjects' THEN c.by = b.v AND b.mode = 'code' ELSE true END), '') AS conflicts
FROM best b LEFT JOIN conflicts c ON c.subject = b.subject GROUP BY 1, 2, 3, 4""")
def _(t: Tables) -> DataFrame:
    """GRF-7: codes, names and parts of names (a set of queries from the table) looked up in the whole graph."""
    m = F.col("p_partkey") % 100
    text = F.when(m == 0, part_code()).when(m == 1, F.concat_ws("-", "p_name", "p_brand")).when(m == 2, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.concat_ws(" ", F.expr("substr(p_name, 3)"), F.substring("p_brand", 1, 6)))
    return I.lookup_identities(part_nodes(t), t.part.filter(m < 4).select(F.col("p_partkey").alias("query_id"), text.alias("query")))


def part_identities(t: Tables) -> I.Identities:
    """All parts as masters; a registry of their names with codes, some of which are invalid."""
    name, other = F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))
    masters = t.part.select(F.col("p_partkey").alias("master"), name.alias("name"), F.array(other).alias("former"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("e"), F.col("p_partkey").cast("string"))).alias("platform_id"))
    code = F.when(F.col("p_size") % 3 == 0, F.lit("unknown")).otherwise(part_code())
    return I.resolve_identities(masters, t.part.filter("p_size > 5").select(name.alias("name"), F.when(F.col("p_size") % 4 == 0, other).alias("former_name"), code.alias("code")))


_RESOLVED = f"""
r AS (SELECT p_name || ' ' || p_brand AS a, CASE WHEN p_size % 4 = 0 THEN p_name || ' ' || p_type || ' ' || p_size END AS b, {_CODE} AS code FROM part WHERE p_size > 5 AND p_size % 3 <> 0),
known AS (SELECT DISTINCT lower(regexp_replace(x, '[^a-zA-Z0-9]+', '', 'g')) AS v, code FROM (SELECT a AS x, code FROM r UNION ALL SELECT b, code FROM r) WHERE x IS NOT NULL),
m AS (SELECT p_partkey AS master, p_name || ' ' || p_brand AS name, CASE WHEN p_size % 2 = 0 THEN 'e' || p_partkey END AS platform, [p_name || ' ' || p_brand, p_name || ' ' || p_type || ' ' || p_size] AS every FROM part),
al AS (SELECT DISTINCT master, lower(regexp_replace(unnest(every), '[^a-zA-Z0-9]+', '', 'g')) AS v FROM m),
met AS (SELECT master, v, code FROM al JOIN known USING (v)), cand AS (SELECT master, code, min(v) AS by FROM met GROUP BY 1, 2), cnt AS (SELECT master, count(*) AS k, min(code) AS code FROM cand GROUP BY 1),
res AS (SELECT m.master, m.name, CASE WHEN k = 1 THEN code WHEN k > 1 THEN 'pending:' || coalesce(platform, lower(regexp_replace(name, '[^a-zA-Z0-9]+', '', 'g'))) ELSE coalesce('platform:' || platform, 'name:' || lower(regexp_replace(name, '[^a-zA-Z0-9]+', '', 'g'))) END AS identity_key,
  CASE WHEN k = 1 THEN 'authoritative_code' WHEN k > 1 THEN 'conflict_pending_manual_review' ELSE 'platform_or_name_pending_code' END AS confidence, CASE WHEN k = 1 THEN code END AS code FROM m LEFT JOIN cnt USING (master))"""


@query("grf8_identities", f"WITH {_RESOLVED} SELECT identity_key, max(code) AS code, arg_min(name, master) AS current_name, arg_min(confidence, master) AS confidence, count(*) AS n_masters FROM res GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """GRF-8: an identity for every part: by its one code, pending where codes conflict, by platform or name else."""
    return part_identities(t).identities


@query("grf8_code_conflicts", f"""
WITH {_RESOLVED}, o AS (SELECT c.master, c.code, c.by, cnt.code AS anchor FROM cand c JOIN cnt USING (master) WHERE k > 1),
sh AS (SELECT o.master, o.code, min(x.v) AS shared FROM o JOIN met x ON x.master = o.master AND x.code = o.code JOIN met y ON y.master = o.master AND y.code = o.anchor AND y.v = x.v WHERE o.code <> o.anchor GROUP BY 1, 2)
SELECT o.master, o.code, CASE WHEN shared IS NOT NULL THEN o.anchor || ' > ' || shared || ' > ' || o.code ELSE o.anchor || ' > ' || a.by || ' > master:' || o.master || ' > ' || o.by || ' > ' || o.code END AS path
FROM o JOIN o a ON a.master = o.master AND a.code = o.anchor LEFT JOIN sh ON sh.master = o.master AND sh.code = o.code WHERE o.code <> o.anchor""")
def _(t: Tables) -> DataFrame:
    """GRF-8: the codes that conflict for a part, each with its shortest path to the smallest."""
    return part_identities(t).conflicts


@query("grf8_components", f"""
WITH RECURSIVE {_NODES}, k AS (SELECT subject, 'n' || v AS key FROM names UNION ALL SELECT subject, 'c' || v FROM codes), f AS (SELECT key, min(subject) AS src FROM k GROUP BY 1),
e AS (SELECT DISTINCT src, subject AS dst FROM k JOIN f USING (key) WHERE src <> subject), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), walk AS (SELECT DISTINCT subject AS a, subject AS b FROM n UNION SELECT w.a, b.dst FROM walk w JOIN b ON b.src = w.b)
SELECT a AS subject, min(b) AS component FROM walk GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    """GRF-8, GRF-1: subjects that names and codes connect."""
    return I.identity_components(I.with_normal(part_nodes(t)))


_POLICIES = "p AS (SELECT c_nationkey AS project, o_orderkey AS document, year(o_orderdate) AS y, o_orderstatus = 'F' AND o_orderkey % 50 = 0 AS in_force, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey), x AS (SELECT document, lag(document) OVER (PARTITION BY o_custkey ORDER BY document) AS cited FROM p)"


def policies(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: nations as projects, orders as the policies that govern them and cite the one before."""
    docs = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    docs = docs.select(F.col("c_nationkey").alias("project"), F.col("o_orderkey").alias("document"), F.year("o_orderdate").alias("year"), ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 50 == 0)).alias("in_force"), F.lit(None).cast("string").alias("relation"))
    cited = t.orders.select(F.col("o_orderkey").alias("document"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("cited")).filter("cited IS NOT NULL")
    return E.dependency_graph(t.nation.select(F.col("n_nationkey").alias("project")), docs, cited, 1998, 3)


@query("grf9_policy_nodes", f"WITH {_POLICIES} SELECT 'project:' || n_nationkey AS id, 'project' AS kind, NULL::VARCHAR AS bucket FROM nation UNION ALL SELECT 'policy:' || document, 'policy', CASE WHEN bool_or(in_force OR y BETWEEN 1996 AND 1998) THEN 'execution' ELSE 'archive' END FROM p GROUP BY document")
def _(t: Tables) -> DataFrame:
    """GRF-9: projects and policies, for execution or in the archive."""
    return policies(t)[0]


@query("grf9_policy_edges", f"WITH {_POLICIES} SELECT 'project:' || project AS src, 'policy:' || document AS dst, 'governed-by' AS relation FROM p UNION SELECT 'policy:' || document, 'policy:' || cited, 'cites' FROM x WHERE cited IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """GRF-9: what governs a project, and what cites what."""
    return policies(t)[1]


@query("rul9_structure_audit", """
SELECT p_partkey, 'all[0]' AS path, lower(p_type) || '_met' AS field, CASE WHEN p_size > 25 THEN 'composite' ELSE 'undeclared' END AS problem FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, 'all[1].any[1]', 'size_met', 'composite' FROM part WHERE p_size % 5 <> 0""")
def _(t: Tables) -> DataFrame:
    """RUL-9: rule trees whose leaves still rest on one truth value for several conditions."""
    none, size = F.lit(None).cast("string"), F.col("p_size")
    leaf = lambda f, s, q: F.struct(f.alias("field"), s.alias("semantics"), q.alias("quote"))
    one = leaf(F.concat(F.lower("p_type"), F.when(size % 2 == 0, "_met").otherwise("_size")), none, F.when(size > 25, "large and heavy").otherwise("large"))
    other = F.array(leaf(F.lit("brand"), none, none), leaf(F.lit("size_met"), F.when(size % 5 == 0, "certificate"), F.lit("either of them")))
    # members of a list may be of several kinds: the texts of both stand in it as they are
    joined = F.concat(F.lit('{"all":['), F.to_json(one), F.lit(","), F.to_json(F.struct(other.alias("any"))), F.lit("]}"))
    return E.composite_leaves(t.part.select("p_partkey", joined.alias("json")), "p_partkey", "json")


# incremental maintenance --------------------------------------------------------------------------


_CHANGED = "o AS (SELECT o_orderkey, o_custkey AS k, CAST(round(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 40 = 3 THEN 1000 ELSE 0 END AS v FROM orders WHERE o_orderkey % 40 <> 7)"


@query("ups5_delta_apply", f"WITH {_CHANGED} SELECT k, count(*) AS n, sum(v)::BIGINT AS spent FROM o GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """UPS-5: changed and deleted rows; only the groups they belong to are summed again."""
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.round("o_totalprice").cast("long").alias("v"))
    sums = lambda d: d.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("spent"))
    m = F.col("o_orderkey") % 40
    delta = rows.filter(m.isin(3, 7)).select("o_orderkey", "k", (F.col("v") + 1000).alias("v"), (m == 7).alias("deleted"))
    return E.apply_delta(rows, delta, sums(rows), "o_orderkey", "k", sums)[1]


@query("ups6_reuse", """
SELECT p_partkey, p_name || '/' || p_brand || CASE WHEN p_partkey % 9 = 4 THEN '/new' ELSE '' END AS result, CASE WHEN p_partkey % 9 = 4 OR p_partkey % 5 = 0 THEN 'computed' ELSE 'reused' END AS origin FROM part WHERE p_partkey % 31 <> 0""")
def _(t: Tables) -> DataFrame:
    """UPS-6: what was computed before stands where its input is the same; changed and new inputs alone are computed."""
    p = t.part.select("p_partkey", "p_name", "p_brand")
    done = lambda d: d.withColumn("result", F.concat_ws("/", "p_name", "p_brand"))
    before = done(p.filter("p_partkey % 5 <> 0").withColumn("input_hash", R.row_hash(["p_name", "p_brand"]))).select("p_partkey", "input_hash", "result")
    now = p.filter("p_partkey % 31 <> 0").withColumn("p_brand", F.when(F.col("p_partkey") % 9 == 4, F.concat("p_brand", F.lit("/new"))).otherwise(F.col("p_brand")))
    return E.reuse_or_compute(now, before, ["p_partkey"], ["p_name", "p_brand"], done).drop("input_hash")


@query("ups3_jsonl_upsert", """
WITH r AS (SELECT event_id, user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts >= TIMESTAMP '2024-01-15' AS late FROM events),
o AS (SELECT user_id, arg_max(k, event_id) AS k FROM r WHERE NOT late AND k IS NOT NULL GROUP BY 1), n AS (SELECT user_id, arg_max(k, event_id) AS k FROM r WHERE late AND k >= 10 GROUP BY 1)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.k, o.k) AS k, CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' WHEN n.k = o.k THEN 'unchanged' ELSE 'updated' END AS status, (SELECT count(*) FROM r WHERE late AND (k < 10 OR k IS NULL)) AS rejected FROM o FULL JOIN n ON o.user_id = n.user_id""")
def _(t: Tables) -> DataFrame:
    """UPS-3: JSON records by key, the last of a key wins, bad ones are counted and left out."""
    r = t.events.select("event_id", "user_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), (F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-15'")).alias("late"))
    good = F.coalesce(F.col("k") >= 10, F.lit(False))
    last = lambda d: d.groupBy("user_id").agg(F.max_by("k", "event_id").alias("k"))
    old = last(r.filter("NOT late AND k IS NOT NULL")).withColumn("version", F.lit(1))
    bad = r.filter(F.col("late") & ~good).agg(F.count("*").alias("rejected"))
    return R.upsert_with_history(old, last(r.filter(F.col("late") & good)), ["user_id"], ["k"]).drop("version").crossJoin(F.broadcast(bad))


@query("ups4_stm4_run_ledger", """
WITH r AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (k IS NULL OR value < 1) AS rejected, CASE WHEN count(*) FILTER (k IS NULL OR value < 1) = 0 THEN 'success' WHEN count(*) FILTER (k IS NULL OR value < 1) = count(*) THEN 'failed' ELSE 'partial' END AS status FROM r GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    """UPS-4, STM-4: bad rows are set aside and counted, the run goes on."""
    bad = F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").isNull() | (F.col("value") < 1), F.lit(False))
    g = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(bad).alias("rejected"))
    return g.withColumn("status", F.when(F.col("rejected") == 0, "success").when(F.col("rejected") == F.col("n"), "failed").otherwise("partial"))


@query("ups4_run_ledger", """
WITH r AS (SELECT event_type, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN 'no number' WHEN value < 1 OR event_type = 'error' THEN 'value' END AS problem FROM events)
SELECT 'first' AS run, event_type AS input, CASE count(problem) WHEN 0 THEN 'success' WHEN count(*) THEN 'failed' ELSE 'partial' END AS status, count(*) AS rows, count(problem) AS rejected FROM r GROUP BY 2""")
def _(t: Tables) -> DataFrame:
    """UPS-4: a run over the event types as inputs, broken off after two and started again; its ledger."""
    ledger = RunLedger(t.spark, fresh_path(t.spark, "ledger"))
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    problem = F.when(k.isNull(), "no number").when((F.col("value") < 1) | (F.col("event_type") == "error"), "value")
    kinds = [r.event_type for r in t.events.select("event_type").distinct().orderBy("event_type").collect()]
    inputs = {kind: lambda kind=kind: t.events.filter(F.col("event_type") == kind) for kind in kinds}
    ledger.run("first", dict(list(inputs.items())[:2]), problem)
    ledger.run("first", inputs, problem)
    return ledger.entries().select("run", "input", "status", "rows", "rejected")


@query("ups9_override_replay", "SELECT p_partkey, CASE WHEN p_partkey % 97 = 0 THEN 'manual' ELSE p_brand END AS cluster FROM part")
def _(t: Tables) -> DataFrame:
    """UPS-9: assignments made by hand survive a rebuild. (Those are made up here.)"""
    hand = t.part.filter("p_partkey % 97 = 0").select("p_partkey", F.lit("manual").alias("hand"))
    return t.part.select("p_partkey", "p_brand").join(hand, "p_partkey", "left").select("p_partkey", F.coalesce("hand", "p_brand").alias("cluster"))


@query("stm1_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    """STM-1 (beyond the reference): tumbling windows over event time."""
    return t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("start"), "event_type", "n")
