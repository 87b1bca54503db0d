"""Relational operators: picking rows of a group, comparing and merging keyed tables, pages, grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dapple.operators.storage import cut

Keys = Sequence[str]


def pick_best(rows: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in ``order``: an aggregation, so it is combined before the shuffle."""
    values = [c for c in rows.columns if c not in keys]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*values), rank).alias("_best"))
    return best.select(*keys, "_best.*").select(*rows.columns)


def latest_per_key(rows: DataFrame, keys: Keys, by: Column) -> DataFrame:
    """One row for each key, the one with the greatest ``by``."""
    values = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), by).alias("_best"))
    return best.select(*keys, "_best.*").select(*rows.columns)


def row_hash(columns: Keys) -> Column:
    """SHA-256 over the values joined by the unit separator; null and '' differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns]), 256)


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Keys, content: str) -> DataFrame:
    """keys, status (added, removed, modified, same) of two tables that are unique by key."""
    b = before.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col(content).alias("_old"), F.lit(True).alias("_in_b"))
    a = after.select(*keys, F.col(content).alias("_new"), F.lit(True).alias("_in_a"))
    on = [F.col(k) == F.col(f"b_{k}") for k in keys]
    both = a.join(b, on, "full_outer")
    status = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("modified")
    return both.select(*[F.coalesce(F.col(k), F.col(f"b_{k}")).alias(k) for k in keys], status.alias("status"))


def keyed_overlay(base: DataFrame, delta: DataFrame, keys: Keys) -> DataFrame:
    """Rows of ``delta`` replace rows of ``base`` with the same key; other rows of both stay."""
    return base.join(delta.select(*keys).distinct(), list(keys), "left_anti").unionByName(delta)


def filled_overlay(base: DataFrame, delta: DataFrame, keys: Keys) -> DataFrame:
    """Values of ``delta`` that are neither null nor '' override those of ``base``."""
    values = [c for c in base.columns if c not in keys]
    d = delta.select(*[F.col(k).alias(f"d_{k}") for k in keys], *[F.col(v).alias(f"d_{v}") for v in values])
    both = base.join(d, [F.col(k) == F.col(f"d_{k}") for k in keys], "full_outer")
    filled = [F.coalesce(F.when(F.col(f"d_{v}").cast("string") != "", F.col(f"d_{v}")), F.col(v)).alias(v) for v in values]
    return both.select(*[F.coalesce(F.col(k), F.col(f"d_{k}")).alias(k) for k in keys], *filled).select(*base.columns)


def three_way_merge(base: DataFrame, local: DataFrame, remote: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, conflict: one side's change wins; where both changed differently the local value stays."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(key, F.col(value).alias(name))

    every = side(base, "b").join(side(local, "l"), key, "full_outer").join(side(remote, "r"), key, "full_outer")
    b, left, right = F.col("b"), F.col("l"), F.col("r")
    conflict = ~left.eqNullSafe(b) & ~right.eqNullSafe(b) & ~left.eqNullSafe(right)
    merged = F.when(left.eqNullSafe(b), right).otherwise(left)
    return every.select(key, merged.alias(value), conflict.alias("conflict"))


def compare_lists(left: DataFrame, right: DataFrame, keys: Keys, names: tuple[str, str]) -> DataFrame:
    """keys, status: in both lists or in which one; the full outer comparison of two populations."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    status = F.when(F.col("_r").isNull(), f"{names[0]}_only").when(F.col("_l").isNull(), f"{names[1]}_only").otherwise("both")
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))


def page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows with total, has_more, next_offset; the limit is clamped to 1..200."""
    limit, offset = max(1, min(limit, 200)), max(0, offset)
    total = rows.agg(F.count("*").alias("total"))
    part = rows.orderBy(*order).offset(offset).limit(limit)
    more = F.col("total") > offset + limit
    return part.crossJoin(F.broadcast(total)).withColumns({"has_more": more, "next_offset": F.when(more, F.lit(offset + limit))})


def route_requests(asked: DataFrame, lists: DataFrame, family: str, fields: dict[str, str], most: int = 200) -> DataFrame:
    """FLT-15: (id, status, total, page_size, first, has_more) of requests (id, family, field, wanted, size, start).

    ``lists`` has the rows of all families; ``fields`` are the filters that they support and their columns. A
    request to a family without rows or with another filter is rejected, sizes are clamped to 1..``most`` and
    starts to 0 and more. Rows are counted once for all requests, by family, filter and value.
    """
    counts = None
    for name, column in fields.items():
        one = lists.groupBy(F.col(family).alias("_family"), F.lit(name).alias("_field"), F.col(column).cast("string").alias("_value")).agg(F.count("*").alias("_total"))
        counts = one if counts is None else counts.unionByName(one)
    known = lists.select(F.col(family).alias("_known")).distinct()
    met = asked.join(known, F.col(family) == F.col("_known"), "left").join(counts, (F.col(family) == F.col("_family")) & (F.col("field") == F.col("_field")) & (F.col("wanted") == F.col("_value")), "left")
    status = F.when(F.col("_known").isNull(), "unknown list").when(~F.coalesce(F.col("field").isin(*fields), F.lit(False)), "unsupported filter").otherwise("accepted")
    size, first = F.least(F.greatest("size", F.lit(1)), F.lit(most)), F.greatest("start", F.lit(0))
    total = F.when(status == "accepted", F.coalesce("_total", F.lit(0)))
    return met.select("id", status.alias("status"), total.alias("total"), size.alias("page_size"), first.alias("first"), (total > first + size).alias("has_more"))


def top_per_group(rows: DataFrame, keys: Keys, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank; Spark cuts each task's groups to k before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def grid(*dimensions: DataFrame) -> DataFrame:
    """All combinations of small dimension tables, as cells to be filled."""
    out = dimensions[0]
    for d in dimensions[1:]:
        out = out.crossJoin(F.broadcast(d))
    return out


def upsert_with_history(current: DataFrame, incoming: DataFrame, keys: Keys, content: Keys, version: str = "version") -> DataFrame:
    """Current rows after the upsert with status inserted, updated, unchanged or kept and the row's version.

    A row counts as updated if the hash over ``content`` differs.
    """
    old = current.select(*[F.col(k).alias(f"o_{k}") for k in keys], *[F.col(c).alias(f"o_{c}") for c in content], F.col(version).alias("_version"), row_hash(content).alias("_old"))
    new = incoming.select(*keys, *content, row_hash(content).alias("_new"))
    both = new.join(old, [F.col(k) == F.col(f"o_{k}") for k in keys], "full_outer")
    status = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    step = F.when(status == "inserted", 1).when(status == "updated", F.col("_version") + 1).otherwise(F.col("_version"))
    names = [F.coalesce(F.col(k), F.col(f"o_{k}")).alias(k) for k in keys]
    values = [F.when(F.col("_new").isNull(), F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in content]
    return both.select(*names, *values, status.alias("status"), step.cast("int").alias(version))


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Rows numbered from 1 in a total order, without one task that sees them all.

    Rows are dealt out by range, numbered within their range, and the sizes of the ranges before
    are added; only one row for each range meets in a window.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    dealt = cut(dealt.withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)), "numbered")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    return dealt.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def running_totals(rows: DataFrame, keys: Keys, by: str, amount: str, name: str) -> DataFrame:
    """The sum of ``amount`` up to and with each row of its key in order of ``by``, and the key's sum as ``name``_all.

    Rows are dealt out by range of key and ``by``, so a key with a third of all rows is spread; sums within a
    range are windows, and the sums of the ranges before, one row for each range and key, are added.
    """
    order = [*keys, by]
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "dealt")
    within = F.sum(amount).over(Window.partitionBy("_part", *keys).orderBy(by))
    parts = dealt.groupBy("_part", *keys).agg(F.sum(amount).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", *keys, before.alias("_before"), F.sum("_sum").over(Window.partitionBy(*keys)).alias(f"{name}_all"))
    return dealt.withColumn("_within", within).join(parts, ["_part", *keys]).withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def carried(rows: DataFrame, keys: Keys, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``, the last value that is not null before each row of its key, in rising ``order``.

    Rows are dealt out by range of key and order. Within a range it is a running window; the last values of the
    ranges before, one row for each range and key, stand in where a range has none yet. So a key with a third of
    all rows is spread. The order should tell all rows of a key apart.
    """
    places = [f"_o{i}" for i in range(len(order))]
    named = rows.withColumns({**dict(zip(places, order, strict=True)), "_value": value})
    dealt = cut(named.repartitionByRange(*keys, *places).withColumn("_part", F.spark_partition_id()), "dealt")
    own = Window.partitionBy("_part", *keys).orderBy(*places).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("_within", F.last("_value", ignorenulls=True).over(own))
    parts = dealt.groupBy("_part", *keys).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*places))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    both = within.join(before, [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]])
    return both.select(*rows.columns, F.coalesce("_within", "_before").alias(name))


def greedy_match(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs by falling score, each side used once, ties to the smaller left, then right.

    In each round every pair that is the best of both its sides is taken, which is what the greedy
    pass would take of them; rounds go on until no pair is free.
    """
    best = lambda rows, k: rows.groupBy(k).agg(F.max_by(F.struct(left, right), F.struct(score, -F.col(left), -F.col(right))).alias("_best"))
    free, taken = cut(pairs.select(left, right, score), "free"), None
    while True:
        one = best(free, left).select("_best.*")
        other = best(free, right).select("_best.*")
        got = cut(free.join(one.join(other, [left, right], "left_semi"), [left, right], "left_semi"), "taken")
        if got.isEmpty():
            return got if taken is None else taken
        taken = got if taken is None else taken.unionByName(got)
        free = cut(free.join(got.select(left), left, "left_anti").join(got.select(right), right, "left_anti"), "free")
