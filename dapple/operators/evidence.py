"""Choice and re-verification: evidence with fallback, stored results that are used again, replays that are checked."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dapple.operators.relational import row_hash
from dapple.operators.storage import cut


def select_evidence(candidates: DataFrame, subject: str, year: int, requested: Sequence[str], annual_claims: Sequence[str], stable_claims: Sequence[str]) -> DataFrame:
    """RUL-7: for each subject the best annual and the best stable source and what may be claimed from them.

    ``candidates`` has subject, id, role (original, citation, basis), channel (a rank), year, official,
    in_force and quoted (the claims that a source states itself, or null). An official original or citation
    of ``year`` counts as annual, originals first, then the better channel, then the smaller id; an official
    basis in force is stable, the newest first. A basis allows stable claims. An annual source allows annual
    claims and, if it is an original, what it quotes; a citation that quotes allows stable claims and what
    it quotes only. Requested claims beyond that are prohibited. Subjects without a source stay, as not_found.
    """
    c = candidates
    rank = F.when(F.col("role") == "original", 0).otherwise(1)
    source = F.struct("id", "role", "quoted")
    annual = F.col("official") & F.col("role").isin("original", "citation") & (F.col("year") == year)
    stable = F.col("official") & (F.col("role") == "basis") & F.col("in_force")
    best = c.groupBy(subject).agg(
        F.min_by(F.when(annual, source), F.when(annual, F.struct(rank, "channel", "id"))).alias("annual"),
        F.min_by(F.when(stable, source), F.when(stable, F.struct(-F.col("year"), F.col("channel"), F.col("id")))).alias("stable"),
    )
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    has_annual, has_stable = F.col("annual").isNotNull(), F.col("stable").isNotNull()
    quoted = F.col("annual.quoted")
    base = F.when(has_stable, texts(stable_claims)).otherwise(texts(()))
    wide = F.when(has_annual, F.array_union(base, texts(annual_claims))).otherwise(base)
    allowed = (
        F.when(~has_annual | quoted.isNull(), wide)
        .when(F.col("annual.role") == "citation", F.array_intersect(wide, F.array_union(texts(stable_claims), quoted)))
        .otherwise(F.array_union(wide, quoted))
    )
    status = F.when(F.col("annual.role") == "original", "original").when(has_annual, "citation_fallback").when(has_stable, "baseline_only").otherwise("not_found")
    out = best.select(subject, status.alias("status"), F.col("annual.id").alias("annual_id"), F.col("stable.id").alias("stable_id"), F.array_sort(allowed).alias("allowed"))
    prohibited = F.array_sort(F.array_except(texts(sorted(set(requested))), F.col("allowed")))
    missing_annual = F.size(F.array_intersect(prohibited, texts(annual_claims))) > 0
    return out.withColumn("prohibited", prohibited).withColumn("conclusive", F.col("annual_id").isNotNull() & ~missing_annual)


def reuse_or_compute(inputs: DataFrame, previous: DataFrame, keys: Sequence[str], content: Sequence[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """UPS-6: results of ``previous`` (keys, input_hash, result columns) where the input is the same, else computed anew.

    ``compute`` gets only the inputs whose key or hash is not there and adds the result columns. The rows
    say where they come from, in ``origin``; keys that left the inputs leave the result.
    """
    hashed = inputs.withColumn("input_hash", row_hash(content))
    results = [c for c in previous.columns if c not in (*keys, "input_hash")]
    on = [*keys, "input_hash"]
    kept = previous.join(hashed.select(*on), on, "left_semi").select(*on, *results, F.lit("reused").alias("origin"))
    new = compute(hashed.join(previous.select(*on), on, "left_anti")).select(*on, *results, F.lit("computed").alias("origin"))
    return kept.unionByName(new)


def verify_replay(stored: DataFrame, replayed: DataFrame, keys: Sequence[str], checked: Sequence[str]) -> DataFrame:
    """WIN-5: keys, problem of the steps whose stored form is not what the replay gives: missing, surplus or the columns that differ."""
    s = stored.select(*[F.col(k).alias(f"s_{k}") for k in keys], *[F.col(c).alias(f"s_{c}") for c in checked], F.lit(True).alias("_s"))
    r = replayed.select(*keys, *checked, F.lit(True).alias("_r"))
    both = r.join(s, [F.col(k) == F.col(f"s_{k}") for k in keys], "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"s_{c}")), F.lit(c)) for c in checked]))
    problem = F.when(F.col("_s").isNull(), "missing").when(F.col("_r").isNull(), "surplus").when(F.size(differ) > 0, F.array_join(differ, ","))
    return both.select(*[F.coalesce(F.col(k), F.col(f"s_{k}")).alias(k) for k in keys], problem.alias("problem")).filter("problem IS NOT NULL")


def apply_delta(base: DataFrame, delta: DataFrame, summary: DataFrame, row_key: str, group: str, summarise: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """UPS-5: rows and summary after a delta (rows with ``deleted``): only groups that a changed row is or was in are summed again."""
    touched = delta.select(row_key, group).unionByName(base.join(delta.select(row_key), row_key, "left_semi").select(row_key, group)).select(group).distinct()
    rows = base.join(delta.select(row_key), row_key, "left_anti").unionByName(delta.filter("NOT deleted").drop("deleted"))
    fresh = summarise(rows.join(touched, group, "left_semi"))
    return rows, summary.join(touched, group, "left_anti").unionByName(fresh)


def dependency_graph(projects: DataFrame, documents: DataFrame, citations: DataFrame, year: int, window: int) -> tuple[DataFrame, DataFrame]:
    """GRF-9: nodes (id, kind, bucket) and edges (src, dst, relation) of projects and the policies that govern them.

    ``documents`` has project, document, year, in_force and relation; ``citations`` has document and cited. A
    document of the last ``window`` years, or in force at any age, is for execution, the others are cold archive;
    one that serves several projects is for execution if any of them needs it so.
    """
    hot = F.col("in_force") | F.col("year").between(year - window + 1, year)
    mark = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    policies = documents.groupBy("document").agg(F.max(hot).alias("hot"))
    nodes = projects.select(mark("project", "project").alias("id"), F.lit("project").alias("kind"), F.lit(None).cast("string").alias("bucket")).distinct()
    nodes = nodes.unionByName(policies.select(mark("policy", "document").alias("id"), F.lit("policy").alias("kind"), F.when(F.col("hot"), "execution").otherwise("archive").alias("bucket")))
    edges = documents.select(mark("project", "project").alias("src"), mark("policy", "document").alias("dst"), F.coalesce("relation", F.lit("governed-by")).alias("relation"))
    return nodes, edges.unionByName(citations.select(mark("policy", "document").alias("src"), mark("policy", "cited").alias("dst"), F.lit("cites").alias("relation"))).distinct()


def json_leaves(rows: DataFrame, key: str, text: str, deepest: int = 32) -> DataFrame:
    """PRJ-4, JSN-1: (key, path, value) of every leaf of a JSON text, names and places as a.b[0].

    Values are JSON texts, so 1 and "1" differ. Objects and lists are opened level by level, as long as
    there are any; empty ones have no leaves, text that does not parse has none either. What is nested
    deeper than ``deepest`` is one leaf there, as its JSON text.
    """
    open_ = rows.select(key, F.lit("").alias("path"), F.try_parse_json(text).alias("v")).filter("v IS NOT NULL")
    out = None
    for _ in range(deepest):
        kind = F.schema_of_variant("v")
        named = open_.withColumn("kind", kind)
        leaves = named.filter("NOT startswith(kind, 'OBJECT') AND NOT startswith(kind, 'ARRAY')").select(key, "path", F.coalesce(F.to_json("v"), F.lit("null")).alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        objects = named.filter("startswith(kind, 'OBJECT')").select(key, "path", F.explode(F.expr("cast(v as map<string, variant>)")).alias("name", "v"))
        objects = objects.select(key, F.concat("path", F.when(F.col("path") != "", ".").otherwise(""), "name").alias("path"), "v")
        lists = named.filter("startswith(kind, 'ARRAY')").select(key, "path", F.posexplode(F.expr("cast(v as array<variant>)")).alias("i", "v"))
        lists = lists.select(key, F.concat("path", F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("path"), "v")
        open_ = cut(objects.unionByName(lists), "json")
        if open_.isEmpty():
            return out
    return out.unionByName(open_.select(key, "path", F.to_json("v").alias("value")))


def json_diff(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """JN-12: (key, path, kind, old, new) of the leaves that were added, deleted or modified."""
    a = json_leaves(old, key, text).select(key, "path", F.col("value").alias("old"))
    b = json_leaves(new, key, text).select(key, "path", F.col("value").alias("new"))
    both = a.join(b, [key, "path"], "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return both.withColumn("kind", kind).filter("kind IS NOT NULL").select(key, "path", "kind", "old", "new")


def composite_leaves(packs: DataFrame, key: str, text: str, suffix: str = "_met", atomic: Sequence[str] = ("certificate", "conclusion", "assertion")) -> DataFrame:
    """RUL-9: (key, path, field, problem) of the rule leaves that still rest on one truth value for several conditions.

    A pack is a JSON rule tree of all/any with leaves that have field, and may have semantics and quote. A field
    that ends with ``suffix`` must be declared atomic by its semantics; if not, the problem is composite where the
    quoted text joins conditions, and undeclared where it does not.
    """
    leaves = json_leaves(packs, key, text).withColumn("name", F.regexp_extract("path", r"([^.\[\]]+)$", 1))
    parts = leaves.filter(F.col("name").isin("field", "semantics", "quote")).withColumn("at", F.regexp_replace("path", r"\.?[^.\[\]]+$", ""))
    plain = F.expr("try_parse_json(value)::string")
    one = parts.groupBy(key, "at").agg(*[F.max(F.when(F.col("name") == n, plain)).alias(n) for n in ("field", "semantics", "quote")])
    bad = one.filter(F.col("field").endswith(suffix) & ~F.coalesce(F.col("semantics").isin(*atomic), F.lit(False)))
    joins = F.coalesce(F.col("quote").rlike(r"(?i)\b(and|or|both|either|unless)\b"), F.lit(False))
    return bad.select(key, F.col("at").alias("path"), "field", F.when(joins, "composite").otherwise("undeclared").alias("problem"))


def validate_lineage(rows: DataFrame, keys: list[str], sources: DataFrame, on: Column, source_key: str, checks: dict[str, Column]) -> DataFrame:
    """RUL-11: (keys, problem), a row for each problem of each record.

    duplicate: another row has the keys; no source: no row of ``sources``, unique by ``source_key``, meets ``on``;
    and the named checks, conditions on the record and its source, that hold. A null condition is no problem.
    """
    twice = rows.groupBy(*keys).agg(F.count("*").alias("_same")).filter("_same > 1")
    counted = rows.join(twice.select(*[F.col(k).alias(f"_{k}") for k in keys], "_same"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    both = counted.join(sources, on, "left")
    found = [F.when(F.col("_same") > 1, "duplicate"), F.when(F.col(source_key).isNull(), "no source"), *[F.when(c, F.lit(n)) for n, c in checks.items()]]
    return both.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("problem"))
