"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document's expected number of copies is proportional,
within its source, to a measure of the document (its size to the power ``GAMMA``, in steps of a
quarter octave), stops at ``CAP`` copies, and is scaled so that the expected words make the target.
Its whole part is allocated for certain; the fraction is its inclusion probability. The documents of
a source are then ordered by their random odds over their inclusion odds, and from the first on they
are taken as long as their words stay within what the whole copies leave of the target. So each
source has one draw of fixed size in words with unequal probabilities.

Where the next document is too long for what is left, the order goes on with those that fit, pass
after pass, until less than ``NEAR`` of the target is left or nothing fits; then the shortest of the
rest is taken if that is nearer.

The order is a function of the row's doc_id, source and text, so reruns agree. The words before a place come
from sums over buckets of the order; the bucket at the border is split into finer ones until it has
at most ``BORDER_ROWS`` places, so no source meets in one task. Tables with a row for each source, or
for each source and size step, are the only ones that windows run over.

Defined cases: a null text has size 0; rows of size 0 take no words; a null source is a source of its
own, last in order; a table without words gives targets of 0; rows alike in doc_id, source and text are
numbered and drawn each by itself, so a source of equal rows meets its target like any other, and how many
of them are taken is the same in every run; a null doc_id is placed by its text. In ``mix_rows``
every input column stays, and columns of the input that clash with working names are kept apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dapple.llm.common import WORD, discard, small_side, stash, table, text_of
from dapple.operators.relational import running_totals

WEIGHTS = (5, 2, 1)
CAP = 3.0
GAMMA = 0.5
#: Size steps to a doubling.
STEPS = 4
BUCKETS = 1024
BORDER_ROWS = 20_000
NEAR = 0.0005
#: Rows of a small table that may be broadcast.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Mix:
    """sources: source, source_size, target; shares: source, step, copies; cuts: source, cuts, pick."""

    sources: DataFrame
    shares: DataFrame
    cuts: DataFrame


def word_count() -> Column:
    return F.regexp_count(text_of(), F.lit(WORD)).cast("long")


def row_key(seed: int) -> Column:
    """What rows alike in doc_id, source and text share."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source").cast("string"), text_of())


def unit(h: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def repeated(keyed: DataFrame) -> DataFrame:
    """The keys ``h`` that several rows of a written table have. Written out."""
    return stash(keyed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "mix-repeated")


def with_draws(keyed: DataFrame, several: DataFrame) -> DataFrame:
    """``keyed`` rows with a draw ``u`` each, the same set of draws in every run.

    Rows alike are numbered, by ranges, so a key with a third of all rows is spread; the first has the draw
    of its key, the others one of key and number. Which of them has which number does not matter.
    """
    if several.isEmpty():
        return keyed.withColumn("u", unit(F.col("h")))
    side = small_side(several, BROADCAST_ROWS)
    alike = keyed.join(side, "h", "left_semi").withColumns({"_by": F.monotonically_increasing_id(), "_one": F.lit(1).cast("long")})
    numbered = running_totals(alike, ["h"], "_by", "_one", "_number").drop("_by", "_one", "_number_all")
    drawn = numbered.withColumn("u", unit(F.when(F.col("_number") == 1, F.col("h")).otherwise(F.xxhash64("h", "_number")))).drop("_number")
    return keyed.join(side, "h", "left_anti").withColumn("u", unit(F.col("h"))).unionByName(drawn)


def size_step() -> Column:
    return F.when(F.col("size") > 0, F.floor(STEPS * F.log2(F.col("size").cast("double")) + 1e-9)).otherwise(-1).cast("int")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """(source, size) rows to a row for each source: source_size, target.

    Targets share ``share`` of all sizes by weight; a target stops at ``cap`` times its source's size
    and the excess goes to the others by weight. That is one level L with target = min(cap, w * L):
    sources in order of cap / w are capped as long as cap / w is below the level that the rest gives.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place + 1)
    rows = by_source.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_w = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level_here", left / open_w).withColumn("n", F.row_number().over(order))
    rows = rows.withColumn("capped", F.col("most") / F.col("w") < F.col("level_here"))
    level = F.min_by(F.when(~F.col("capped"), F.col("level_here")), F.when(~F.col("capped"), F.col("n"))).over(every)
    rows = rows.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.col("w") * level))
    return rows.select("source", F.col("source_size").cast("long").alias("source_size"), "target")


def same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def expected_copies(steps: DataFrame, sources: DataFrame, cap: float = CAP, gamma: float = GAMMA) -> DataFrame:
    """source, step, copies from the words (source, step, words) and the targets of the sources.

    copies = min(cap, k * measure): the steps above some step are at the cap, and k gives the rest of
    the target to the others. The highest step that stays within the cap under its k decides.
    """
    measure = F.pow(F.lit(2.0), F.col("step") * (gamma / STEPS))
    rows = steps.filter("step >= 0").join(sources.select(F.col("source").alias("s"), "target"), same("source", "s")).withColumn("m", measure)
    down = Window.partitionBy("source").orderBy(F.col("step").desc())
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("m")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("k", (F.col("target") - cap * above) / rest)
    fits = F.col("k") * F.col("m") <= cap
    k = F.max_by(F.when(fits, F.col("k")), F.when(fits, F.col("step"))).over(Window.partitionBy("source"))
    return rows.select("source", "step", "words", F.greatest(F.lit(0.0), F.coalesce(F.least(F.lit(cap), k * F.col("m")), F.lit(cap))).alias("copies"))


def pareto_place(u: Column, pi: Column) -> Column:
    """The random odds over the inclusion odds, q, as q / (1 + q): from 0 on, the smallest are taken first."""
    q = u / (1.0 - u) * (1.0 - pi) / pi
    return q / (1.0 + q)


def part_of(copies: Column) -> Column:
    return copies - F.floor(copies)


def border(live: DataFrame, goals: DataFrame) -> DataFrame:
    """source, cut, have, n: up to which place the words of (source, place, size) stay within each goal.

    cut is 2 where all stay; have are the words up to it, n the rows in all. Written out.
    """
    fine, buckets = None, BUCKETS
    spent = []
    while True:
        rows = live if fine is None else live.join(fine.select(F.col("source").alias("s"), "low", "base"), same("source", "s")).filter(F.floor(F.col("place") * (buckets // BUCKETS)) == F.col("low"))
        base = F.lit(0).cast("long").alias("base") if fine is None else F.col("base")
        sums = rows.groupBy("source", F.floor(F.col("place") * buckets).alias("low"), base).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        run = Window.partitionBy("source").orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("end", F.col("base") + F.sum("words").over(run)).join(goals.select(F.col("source").alias("s"), "goal"), same("source", "s")).drop("s")
        over = F.col("end") > F.col("goal")
        edge = sums.groupBy("source").agg(F.min_by(F.struct("low", (F.col("end") - F.col("words")).alias("base"), "n"), F.when(over, F.col("low"))).alias("edge"), F.max("end").alias("all"), F.sum("n").alias("n_all"))
        edge = stash(edge.select("source", "edge.*", "all", "n_all"), "mix-edge")
        spent.append(edge)
        if fine is None:
            first = edge
        fine = edge.filter("low IS NOT NULL")
        most = fine.agg(F.max("n")).first()[0]
        if most is None or most <= BORDER_ROWS or buckets >= BUCKETS**4:
            break
        buckets *= BUCKETS
    near = live.join(fine.select(F.col("source").alias("s"), "low", "base"), same("source", "s")).filter(F.floor(F.col("place") * buckets) == F.col("low"))
    near = near.groupBy("source", "place", "base").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("end", F.col("base") + F.sum("words").over(run)).join(goals.select(F.col("source").alias("s"), "goal"), same("source", "s")).drop("s")
    inside = F.col("end") <= F.col("goal")
    # without a row of the border bucket the cut is before all of its places
    before = F.col("low") / F.lit(float(buckets))
    at = near.groupBy("source").agg(F.max(F.when(inside, F.col("place"))).alias("place"), F.max(F.when(inside, F.col("end"))).alias("end"))
    at = at.join(fine.select(F.col("source").alias("s"), "low", "base"), same("source", "s")).select("source", F.coalesce("place", before * (1 - 2.0**-50) - 2.0**-60).alias("cut"), F.coalesce("end", "base").alias("have"))
    at = at.withColumnRenamed("source", "s")
    out = first.join(at, same("source", "s"), "left").select("source", F.coalesce("cut", F.lit(2.0)).alias("cut"), F.coalesce("have", "all").alias("have"), F.col("n_all").alias("n"))
    out = stash(out, "mix-border")
    discard(*spent)
    return out


def plan_mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, share: float = 1.0, gamma: float = GAMMA) -> Mix:
    """``sized`` has source, size, u. It is read several times; give a written table."""
    steps = stash(sized.groupBy("source", size_step().alias("step")).agg(F.sum("size").alias("words"), F.sum("size").alias("size")), "mix-steps")
    sources = stash(targets(steps, weights, cap, share), "mix-sources")
    shares = stash(expected_copies(steps, sources, cap, gamma), "mix-shares")
    part = part_of(F.col("copies"))
    live = with_copies(sized.filter("size > 0"), shares).filter(part > 0).select("source", "size", pareto_place(F.col("u"), part).alias("place"))
    goals = shares.groupBy("source").agg(F.sum(F.col("words") * part).alias("goal")).filter("goal > 0")
    goals = stash(goals.join(sources.select(F.col("source").alias("s"), "target"), same("source", "s")).drop("s"), "mix-goals")

    passes, open_ = [], goals.select("source", "goal", "target", F.lit(-1.0).alias("after"), F.lit(2**62).alias("most"))
    while True:
        mine = open_.select(F.col("source").alias("s"), "after", "most")
        fitting = live.join(mine, same("source", "s")).filter((F.col("place") > F.col("after")) & (F.col("size") <= F.col("most"))).select("source", "place", "size")
        got = border(fitting, open_)
        left = open_.join(got.select(F.col("source").alias("s"), "cut", "have"), same("source", "s"), "left").select(
            "source", "target", "after", "most", F.coalesce("cut", F.col("after")).alias("cut"), (F.col("goal") - F.coalesce("have", F.lit(0))).alias("goal"), (F.coalesce("have", F.lit(0)) > 0).alias("took")
        )
        left = stash(left, "mix-left")
        passes.append(left)
        # the first pass may take nothing only because the first document is too long
        more = left.filter((F.col("goal") > NEAR * F.col("target")) & (F.col("goal") >= 1) & (F.col("took") | F.lit(len(passes) == 1)))
        if more.isEmpty():
            break
        open_ = more.select("source", "goal", "target", F.col("cut").alias("after"), F.floor("goal").alias("most"))
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    every = stash(every, "mix-passes")
    cuts = every.filter("took").groupBy("source").agg(F.collect_list(F.struct("after", "cut", "most")).alias("cuts"))
    rest = every.groupBy("source").agg(F.min("goal").alias("rest"), F.first("target").alias("target"))
    cuts = rest.join(cuts.select(F.col("source").alias("s"), "cuts"), same("source", "s"), "left").drop("s")
    cuts = stash(cuts.select("source", "rest", "target", F.coalesce("cuts", F.from_json(F.lit("[]"), "array<struct<after:double,cut:double,most:bigint>>")).alias("cuts")), "mix-cuts")
    short = cuts.filter(F.col("rest") > NEAR * F.col("target")).select(F.col("source").alias("s"), "rest", "cuts")
    left_over = live.join(short, same("source", "s")).filter(~in_cuts() & (F.col("size") < 2 * F.col("rest")))
    pick = left_over.groupBy("source").agg(F.min(F.struct("size", "place")).alias("x")).select(F.col("source").alias("s"), F.col("x.place").alias("pick"))
    cuts = stash(cuts.join(pick, same("source", "s"), "left").select("source", "cuts", "pick"), "mix-cuts")
    discard(steps, goals, *passes, every)
    return Mix(sources, shares, cuts)


def in_cuts() -> Column:
    return F.exists("cuts", lambda c: (F.col("place") > c["after"]) & (F.col("place") <= c["cut"]) & (F.col("size") <= c["most"]))


def with_copies(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """``rows`` with source, size, to which it adds the expected copies."""
    own = small_side(shares.select(F.col("source").alias("_s"), F.col("step").alias("_t"), "copies"), BROADCAST_ROWS)
    return rows.withColumn("_step", size_step()).join(own, same("source", "_s") & (F.col("_step") == F.col("_t")), "left").drop("_s", "_t", "_step")


def decide(rows: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` with source, size, u, to which it adds source_size, target, copies."""
    src = small_side(mix.sources.select(F.col("source").alias("_s"), "source_size", "target"), BROADCAST_ROWS)
    cut = small_side(mix.cuts.select(F.col("source").alias("_s2"), "cuts", "pick"), BROADCAST_ROWS)
    rows = with_copies(rows, mix.shares).join(src, same("source", "_s"), "left").join(cut, same("source", "_s2"), "left")
    part = part_of(F.col("copies"))
    rows = rows.withColumn("place", F.when(part > 0, pareto_place(F.col("u"), part)))
    taken = F.when(in_cuts() | (F.col("place") == F.col("pick")), 1).otherwise(0)
    copies = F.coalesce(F.floor("copies"), F.lit(0)) + F.when(F.col("place").isNotNull(), taken).otherwise(0)
    return rows.withColumn("copies", copies).drop("_s", "_s2", "cuts", "pick", "place")


def size_up(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), row_key(seed).alias("h"))


def mix_documents(docs: DataFrame, seed: int = 20, **options) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every document."""
    keyed = stash(size_up(docs, seed), "mix-keyed")
    several = repeated(keyed)
    sized = keyed.withColumn("u", unit(F.col("h"))) if several.isEmpty() else stash(with_draws(keyed, several), "mix-sized")
    out = decide(sized, plan_mix(sized, **options))
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.col("copies").cast("long").alias("copies"), (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix_rows(docs: DataFrame, seed: int = 20, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs``, all its columns, as often as the mix takes it."""
    keyed = stash(size_up(docs, seed), "mix-keyed")
    several = repeated(keyed)
    sized = keyed.withColumn("u", unit(F.col("h"))) if several.isEmpty() else stash(with_draws(keyed, several), "mix-sized")
    mix = plan_mix(sized, **options)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    held = docs.select(row, F.col("source").cast("string").alias("source"), word_count().alias("size"), row_key(seed).alias("h"))
    out = decide(with_draws(held, several), mix).filter("copies > 0")
    return out.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n"), "_row").select("_row.*")


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))
