"""JN-15: one-to-one assignment of two sides by nearest value.

The greedy pass takes the pairs of a block by rising distance, each side once. Of all pairs only neighbours
in the order of values can be next, so a round looks from each free value to the free values of the other side
before and after it, and takes every pair of which each is the other's nearest: those the greedy pass would
take too, whatever it takes elsewhere. What is left is closer to its next neighbours' places in the next round,
so the search widens only where the nearest were taken. A round reads the free rows once; pairs are never listed.

Values are dealt out by range of block and value. Within a range neighbours come from running windows; across
ranges from the first and last of each side, one row for each range and block, so no block meets in one task.

``similar_assignment`` takes pairs by a rounded similarity, in which many distances tie, and one-sided runs: a
block is one task there, which holds the block's rows, but no pairs.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterable
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dapple.operators.storage import cut

#: Places of the rounded similarity.
DIGITS = 9


def neighbours(free: DataFrame) -> DataFrame:
    """(block, side, id, other): for each value's smallest id, its nearest of the other side, ties to the smaller id."""
    heads = free.groupBy("block", "value", "side").agg(F.min("id").alias("id"))
    dealt = cut(heads.repartitionByRange("block", "value", "side").withColumn("part", F.spark_partition_id()), "dealt")
    place = F.struct("value", "side")
    of = lambda side: F.when(F.col("side") == side, F.struct("value", "id"))
    own = Window.partitionBy("part", "block").orderBy("value", "side")
    before, after = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)
    edge = Window.partitionBy("block").orderBy("part")
    earlier, later = edge.rowsBetween(Window.unboundedPreceding, -1), edge.rowsBetween(1, Window.unboundedFollowing)
    parts = dealt.groupBy("part", "block").agg(*[f(of(s), F.when(F.col("side") == s, place)).alias(f"{n}{s}") for s in (0, 1) for n, f in (("first", F.min_by), ("last", F.max_by))])
    carry = parts.select("part", "block", *[F.last(f"last{s}", ignorenulls=True).over(earlier).alias(f"_before{s}") for s in (0, 1)], *[F.first(f"first{s}", ignorenulls=True).over(later).alias(f"_after{s}") for s in (0, 1)])
    near = dealt
    for s in (0, 1):
        near = near.withColumns({f"before{s}": F.last(of(s), ignorenulls=True).over(before), f"after{s}": F.first(of(s), ignorenulls=True).over(after)})
    near = near.join(carry, ["part", "block"])
    both = [F.when(F.col("side") == 0, F.coalesce(f"{n}1", f"_{n}1")).otherwise(F.coalesce(f"{n}0", f"_{n}0")) for n in ("before", "after")]
    near = near.select("block", "side", "id", "value", both[0].alias("b"), both[1].alias("a"))
    ranked = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.value") - F.col("value")).alias("distance"), F.col(f"{c}.id").alias("other")))
    return near.select("block", "side", "id", F.least(ranked("b"), ranked("a")).alias("n")).filter("n IS NOT NULL").select("block", "side", "id", "n.*")


def nearest_assignment(left: DataFrame, right: DataFrame, block: str, value: Column, other_value: Column, a: str, b: str) -> DataFrame:
    """(block, a, b, distance), the pairs that a pass over all pairs of a block by (distance, a, b) takes, each side once.

    Values are whole numbers; rows with a null block or value take no part; ids are unique within a side. The
    smaller side of a block is used up. Where many rows of one side lie between two of the other, or at the same
    value, they are served one a round, so this is for sides that are mixed; ``relational.greedy_match`` takes any
    list of pairs.
    """
    side = lambda rows, v, key, s: rows.select(F.col(block).alias("block"), v.cast("long").alias("value"), F.lit(s).alias("side"), F.col(key).alias("id"))
    free = cut(side(left, value, a, 0).unionByName(side(right, other_value, b, 1)).filter("block IS NOT NULL AND value IS NOT NULL"), "free")
    taken = None
    while True:
        near = cut(neighbours(free), "near")
        one = near.filter("side = 0").select("block", F.col("id").alias("a"), F.col("other").alias("b"), "distance")
        other = near.filter("side = 1").select("block", F.col("other").alias("a"), F.col("id").alias("b"))
        got = cut(one.join(other, ["block", "a", "b"], "left_semi"), "taken")
        if got.isEmpty():
            out = got if taken is None else taken
            return out.select(F.col("block").alias(block), F.col("a").alias(a), F.col("b").alias(b), "distance")
        taken = got if taken is None else taken.unionByName(got)
        used = got.select(F.lit(0).alias("side"), F.col("a").alias("id")).union(got.select(F.lit(1), "b"))
        free = cut(free.join(used, ["side", "id"], "left_anti"), "free")


def billionths(distance: float) -> int:
    """1 / (1 + distance) rounded half up to nine places, as Spark rounds: by the shortest decimal form of the number."""
    x = 1 / (1 + distance)
    n = x * 10**DIGITS + 0.5
    whole = math.floor(n)
    if min(n - whole, whole + 1 - n) < 1e-5:
        return int(Decimal(repr(x)).scaleb(DIGITS).to_integral_value(ROUND_HALF_UP))
    return whole


class Free:
    """The free rows of one side in order of value: the next on either side of a place, and the smallest id of a run."""

    def __init__(self, rows: list[tuple[float, int]]):
        self.values, self.ids = [v for v, _ in rows], [i for _, i in rows]
        n = len(rows)
        self.size = 1 << max(1, n - 1).bit_length()
        none = (math.inf, -1)
        self.least = [none] * self.size + [(i, at) for at, i in enumerate(self.ids)] + [none] * (self.size - n)
        for at in range(self.size - 1, 0, -1):
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])
        self.up, self.down = list(range(n + 1)), list(range(n + 1))  # of down, place 0 is none

    def find(self, links: list[int], at: int) -> int:
        end = at
        while links[end] != end:
            end = links[end]
        while links[at] != end:
            links[at], at = end, links[at]
        return end

    def take(self, at: int) -> None:
        self.up[at], self.down[at + 1] = at + 1, at
        k = self.size + at
        self.least[k] = (math.inf, -1)
        while k > 1:
            k //= 2
            self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])

    def smallest(self, begin: int, end: int) -> tuple[float, int]:
        """The smallest free id of the places from ``begin`` on and before ``end``, and its place."""
        best, a, b = (math.inf, -1), self.size + begin, self.size + end
        while a < b:
            if a & 1:
                best, a = min(best, self.least[a]), a + 1
            if b & 1:
                b -= 1
                best = min(best, self.least[b])
            a, b = a // 2, b // 2
        return best

    def alike(self, value: float, near: int, step: int, score: int) -> int:
        """The last place from ``near`` on, in direction ``step``, whose similarity to ``value`` is ``score``."""
        n, good, stride = len(self.values), near, 1
        while 0 <= (at := good + step * stride) < n and billionths(abs(self.values[at] - value)) == score:
            good, stride = at, 2 * stride
        while stride:
            if 0 <= (at := good + step * stride) < n and billionths(abs(self.values[at] - value)) == score:
                good = at
            stride //= 2
        return good

    def best(self, value: float) -> tuple[int, int, int] | None:
        """(minus the similarity, id, place) of the free row most similar to a value, ties to the smallest id."""
        at = bisect_left(self.values, value)
        right, left = self.find(self.up, at), self.find(self.down, at) - 1
        sides = [(billionths(abs(self.values[i] - value)), i, step) for i, step in ((right, 1), (left, -1)) if 0 <= i < len(self.values)]
        if not sides:
            return None
        score, found = max(sides)[0], []
        for own, i, step in sides:
            if own == score:
                last = self.alike(value, i, step, score)
                found.append(self.smallest(min(i, last), max(i, last) + 1))
        i, at = min(found)
        return -score, i, at


def by_ids(a: Iterable[int], b: Iterable[int], odd_a: set[int], odd_b: set[int]) -> list[tuple[int, int]]:
    """The pairs of a side or both in the odd sets that a pass by (a, b) takes."""
    every, odd, used, out = sorted(b), sorted(odd_b & set(b)), set(), []
    at = {id(every): 0, id(odd): 0}
    for x in sorted(a):
        rows = every if x in odd_a else odd
        while at[id(rows)] < len(rows) and rows[at[id(rows)]] in used:
            at[id(rows)] += 1
        if at[id(rows)] < len(rows):
            used.add(rows[at[id(rows)]])
            out.append((x, rows[at[id(rows)]]))
    return out


def similar_pairs(a: dict[int, float | None], b: dict[int, float | None]) -> list[tuple[int, int, float | None]]:
    """(a, b, similarity) that a pass over all pairs by falling similarity, then a, then b takes, each side once.

    Of each value of the smaller side the best free partner is kept in a heap; it is worked out again only when
    it comes up and its partner is gone. A similarity that is no number comes first, one that is null last.
    """
    out: list[tuple[int, int, float | None]] = []

    def odd(test: Callable[[float | None], bool], score: float | None, among: Callable[[float | None], bool]) -> None:
        own = [{i for i, v in side.items() if among(v)} for side in (a, b)]
        for x, y in by_ids(*own, {i for i in own[0] if test(a[i])}, {i for i in own[1] if test(b[i])}):
            out.append((x, y, score))
            del a[x], b[y]

    odd(lambda v: v != v, math.nan, lambda v: v is not None)
    turned = len(a) < len(b)
    few, many = (a, b) if turned else (b, a)
    free = Free(sorted((v, i) for i, v in many.items() if v is not None and v == v))
    waiting: dict[float, list[int]] = {}
    for i, v in few.items():
        if v is not None and v == v:
            waiting.setdefault(v, []).append(i)
    for ids in waiting.values():
        heapq.heapify(ids)
    heap: list[tuple] = []

    def put(v: float) -> None:
        if waiting[v] and (found := free.best(v)):
            score, i, at = found
            own = waiting[v][0]
            heapq.heappush(heap, (score, *((own, i) if turned else (i, own)), at, v))

    for v in waiting:
        put(v)
    while heap:
        score, x, y, at, v = heapq.heappop(heap)
        if free.up[at] == at:
            out.append((x, y, -score / 10**DIGITS))
            free.take(at)
            heapq.heappop(waiting[v])
            del a[x], b[y]
        put(v)
    odd(lambda v: v is None, None, lambda v: True)
    return out


def similar_assignment(left: DataFrame, right: DataFrame, block: str, value: Column, other_value: Column, a: str, b: str) -> DataFrame:
    """(a, b, score) of rows of equal blocks, one to one, by falling score, ties to the smaller a, then b.

    The score is 1 / (1 + |value - other_value|), rounded to nine places, so that distances alike tie. No pair is
    listed: a block is a task that holds its rows in order of value. The smaller side of a block is used up. A
    round of a match works out again what had the same partner, which is much only where many different values
    of the smaller side have the same one next. Rows with a null block take no part, null values come last, and
    what is no number first; ids are whole numbers, unique within a side, and values finite otherwise.
    """
    side = lambda rows, v, key, s: rows.select(F.col(block).alias("block"), F.lit(s).alias("side"), F.col(key).cast("long").alias("id"), v.cast("double").alias("value"))
    rows = side(left, value, a, 0).unionByName(side(right, other_value, b, 1)).filter("block IS NOT NULL AND id IS NOT NULL")

    def match(own: pa.Table) -> pa.Table:
        sides: tuple[dict, dict] = ({}, {})
        for s, i, v in zip(*(own.column(c).to_pylist() for c in ("side", "id", "value")), strict=True):
            sides[s][i] = v
        pairs = similar_pairs(*sides)
        x, y, score = zip(*pairs, strict=True) if pairs else ((), (), ())
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64()), "score": pa.array(score, pa.float64())})

    found = rows.groupBy("block").applyInArrow(match, "a long, b long, score double")
    return found.select(F.col("a").alias(a), F.col("b").alias(b), "score")
