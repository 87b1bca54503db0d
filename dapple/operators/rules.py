"""Rules compiled to column expressions: a tree of comparisons becomes one Column that Catalyst optimises."""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dapple.operators.dictionary import term_hits


def leaf(rule: dict[str, Any]) -> Column:
    """A comparison of a field: true, false, or null where the fact is missing or does not compare."""
    c, op, want = F.col(rule["field"]), rule["op"], rule.get("value")
    simple = {
        "eq": lambda: c == want, "ne": lambda: c != want, "gt": lambda: c > want, "gte": lambda: c >= want, "lt": lambda: c < want, "lte": lambda: c <= want,
        "in": lambda: c.isin(*want), "not_in": lambda: ~c.isin(*want), "contains": lambda: F.contains(c.cast("string"), F.lit(want)),
        "exists": lambda: c.isNotNull(), "truthy": lambda: c.cast("string").isNotNull() & ~c.cast("string").isin("", "0", "false"),
    }
    if op not in simple:
        raise ValueError(f"unknown operator {op!r}")
    return simple[op]()


def three_valued(tree: dict[str, Any]) -> Column:
    """all/any trees by Kleene's logic: a failed part fails all, a passed part passes any, else null."""
    if "all" in tree:
        out = F.lit(True)
        for part in tree["all"]:
            out = out & three_valued(part)
        return out
    if "any" in tree:
        out = F.lit(False)
        for part in tree["any"]:
            out = out | three_valued(part)
        return out
    return leaf(tree)


def status_of(passed: Column) -> Column:
    return F.when(passed, "passed").when(~passed, "failed").otherwise("pending")


#: Ranks of the five statuses; within all the greatest decides, within any the least.


def five_valued(tree: dict[str, Any]) -> Column:
    """all/any trees with evidence: parts that do not apply are left out, pending outranks unknown,
    an exclusion turns passed and failed round."""
    if "all" in tree or "any" in tree:
        parts = [five_valued(p) for p in tree.get("all") or tree["any"]]
        applies = lambda name: F.exists(F.array(*parts), lambda s: s == name)
        order = ("failed", "pending", "unknown", "passed") if "all" in tree else ("passed", "pending", "unknown", "failed")
        out = F.lit("not_applicable")
        for name in reversed(order):
            out = F.when(applies(name), name).otherwise(out)
        return out
    got = leaf(tree)
    state = F.col(tree["evidence"]) if "evidence" in tree else F.lit("verified")
    good, bad = ("failed", "passed") if tree.get("exclusion") else ("passed", "failed")
    out = F.when(got.isNull(), "unknown").when(state != "verified", "pending").when(got, good).otherwise(bad)
    return F.when(three_valued(tree["when"]), out).otherwise("not_applicable") if "when" in tree else out


def banded(value: Column, bands: list[tuple[float, float]]) -> Column:
    """The score of the highest band whose minimum the value reaches; 0 below all, null for null."""
    out = F.lit(0.0)
    for least, score in sorted(bands):
        out = F.when(value >= least, float(score)).otherwise(out)
    return F.when(value.isNotNull(), out)


def stepped(value: Column, least: float, base: float, every: float, gain: float, cap: float) -> Column:
    """base from ``least`` on, plus ``gain`` for each ``every`` more, up to ``cap``."""
    more = F.lit(base) + F.floor((value - least) / every) * gain
    return F.when(value.isNull(), F.lit(None)).when(value < least, 0.0).otherwise(F.least(more, F.lit(float(cap))))


def conclusion(statuses: Column) -> Column:
    """What an array of requirement statuses amounts to."""
    has = lambda s: F.array_contains(statuses, s)
    return F.when(has("blocked"), "blocked").when(has("failed"), "ineligible").when(has("unknown"), "undetermined").when(has("pending"), "conditional").otherwise("eligible")


def first_of(text: Column, named: Sequence[tuple[str, str]]) -> Column:
    """The name of the first phrase, in the order given, that a lower-case text holds as whole words."""
    return F.coalesce(*[F.when(text.rlike(rf"\b{re.escape(phrase)}\b"), F.lit(name)) for name, phrase in named])


def rule_candidates(rows: DataFrame, key: str, text: str, fields: Sequence[tuple[str, str]], compares: Sequence[tuple[str, str]], units: Sequence[str]) -> DataFrame:
    """RUL-6: (key, clause, field, op, value, unit) of each clause that has a field, an operator and a number after it.

    Clauses end with a semicolon, line break or full stop; they are numbered from 1. The number is the first
    after the operator's phrase, the unit the known word after it, or ''. The results are leaves for
    ``three_valued``, to be reviewed first.
    """
    ends = r"[;\n]|\.(?![0-9])"
    clauses = rows.select(key, F.posexplode(F.split(F.lower(text), ends)).alias("i", "c"))
    phrases = "|".join(re.escape(p) for _, p in compares)
    after = F.regexp_extract("c", rf"\b(?:{phrases})\b\D*([0-9]+(?:\.[0-9]+)?)\s*({'|'.join(map(re.escape, units))})?", 1)
    unit = F.regexp_extract("c", rf"\b(?:{phrases})\b\D*([0-9]+(?:\.[0-9]+)?)\s*({'|'.join(map(re.escape, units))})?", 2)
    found = clauses.select(key, (F.col("i") + 1).alias("clause"), first_of(F.col("c"), fields).alias("field"), first_of(F.col("c"), compares).alias("op"), F.nullif(after, F.lit("")).cast("double").alias("value"), unit.alias("unit"))
    return found.filter("field IS NOT NULL AND op IS NOT NULL AND value IS NOT NULL")


# What a title and status say about an event, the first that holds. (kind, any of these terms)
EVENT_TERMS = (
    ("revoked", ("撤销", "取消资格", "复核不通过", "未通过复核")),
    ("continued_support", ("建议继续支持", "继续支持")),
    ("re_recognition", ("重新认定",)),
    ("review_publicity", ("拟复核", "复核拟推荐")),
    ("review_passed", ("复核通过",)),
    ("review_due", ("复核对象", "到期复核", "有效期满")),
    ("changed", ("更名", "迁移", "合并", "重组", "变更")),
    ("annual_evaluation", ("科技型中小企业评价",)),
    ("recognition_publicity", ("拟认定", "公示", "拟推荐", "推荐名单")),
)
ANNUAL_PROJECT = "国家科技型中小企业"
PREPARATION_MODES = ("forecast", "future-preparation", "prediction", "current-year-preparation", "current-pre-application", "pre-application")


def first_kind(text: Column, terms: Sequence[tuple[str, Sequence[str]]], otherwise: str | None = None, also: dict[str, Column] | None = None) -> Column:
    """The first kind of which the text holds a term, or for which its condition in ``also`` holds; null texts hold nothing."""
    out, also = None, also or {}
    for kind, words in terms:
        holds = reduce(operator.or_, [F.contains(F.coalesce(text, F.lit("")), F.lit(w)) for w in words])
        if kind in also:
            holds = holds | F.coalesce(also[kind], F.lit(False))
        out = F.when(holds, kind) if out is None else out.when(holds, kind)
    return out.otherwise(otherwise)


def event_kind(title: Column, status: Column, project: Column | None = None) -> Column:
    """RUL-12: the kind of a lifecycle event, recognition where nothing else is said."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(status, F.lit("")))
    return first_kind(text, EVENT_TERMS, "recognition", {} if project is None else {"annual_evaluation": project == ANNUAL_PROJECT})


def transition_routes(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """RUL-8: (id, status, primary_policy, primary_status, draft_used, old_policy_role, formal_allowed) of requests (id, family, place, mode).

    The registry has a row for each family and place: formal, formal_status, prospective, prospective_status,
    verified, replaces. A draft is the base of a preparation if its source is verified, it says that it replaces
    the formal policy and it is a draft or active candidate; never of a formal conclusion. A formal policy allows
    one unless its status is a draft or invalid, or what is asked is a historical fact. A family or place that is
    not in the registry, null ones among them, is unresolved.
    """
    held = registry.select("family", "place", "formal", F.coalesce("formal_status", F.lit("")).alias("formal_status"), F.nullif(F.trim("prospective"), F.lit("")).alias("prospective"), "prospective_status", "verified", "replaces", F.lit(True).alias("_known"))
    both = requests.join(held, ["family", "place"], "left")
    ready = F.coalesce(F.col("prospective").isNotNull() & F.col("prospective_status").isin("draft", "active_candidate") & F.col("verified") & F.col("replaces"), F.lit(False))
    draft = ready & F.coalesce(F.col("mode").isin(*PREPARATION_MODES), F.lit(False))
    past = F.coalesce(F.col("mode") == "historical-fact", F.lit(False))
    known = F.coalesce("_known", F.lit(False))
    formal = ~draft & ~past & ~F.col("formal_status").rlike("^(draft|invalid)")
    return both.select(
        "id",
        F.when(known, "resolved").otherwise("unresolved").alias("status"),
        F.when(draft, F.col("prospective")).otherwise(F.col("formal")).alias("primary_policy"),
        F.when(draft, F.col("prospective_status")).otherwise(F.col("formal_status")).alias("primary_status"),
        (known & draft).alias("draft_used"),
        F.when(known, F.when(draft, "current-formal-and-historical-only").when(past, "historical-time-point-only").otherwise("current-formal")).alias("old_policy_role"),
        (known & F.coalesce(formal, F.lit(False))).alias("formal_allowed"),
    )


def supersession(docs: DataFrame, key: str, text: str, draft: Column, rules: DataFrame) -> DataFrame:
    """RUL-13: (key, validity, replacement, basis) of documents by a table of term rules (term, priority, replacement, basis).

    A document that holds the term of a rule is superseded by that rule's replacement, on its basis; of several
    rules the smallest priority counts, then the smallest term. Drafts are exempt, and a document is not superseded
    by itself. The rules may be any number: one pass with an automaton over their terms. Keys are unique.
    """
    open_ = docs.filter(~F.coalesce(draft, F.lit(False))).select(key, text)
    hits = term_hits(open_, key, text, rules).select(key, "term").join(rules, "term").filter(F.col("replacement").cast("string") != F.col(key).cast("string"))
    best = hits.groupBy(key).agg(F.min(F.struct("priority", "term", "replacement", "basis")).alias("r"))
    all_ = docs.select(key, F.coalesce(draft, F.lit(False)).alias("_draft")).join(best, key, "left")
    validity = F.when(F.col("_draft"), "draft").when(F.col("r").isNotNull(), "superseded").otherwise("current")
    return all_.select(key, validity.alias("validity"), F.col("r.replacement").alias("replacement"), F.col("r.basis").alias("basis"))
