"""Event logs replayed as state machines, by windows over each subject's events in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dapple.operators.storage import cut


def replay(events: DataFrame, subject: str, at: Column, precedence: Column, kind: Column, validity: int) -> DataFrame:
    """subject, step, at, kind, state, valid_until: the state after each event, in order of time, precedence and kind.

    recognised sets the state active for ``validity``; published only moves a subject that has no
    state; revoked ends validity at its own time; kinds that are unknown change nothing. So the last
    recognised or revoked event decides, or else whether one was published: running windows that cost
    the same for a step however many there are.
    """
    rows = events.select(F.col(subject), at.cast("long").alias("at"), precedence.cast("int").alias("_precedence"), kind.alias("kind"))
    order = Window.partitionBy(subject).orderBy("at", "_precedence", "kind")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    decides = F.last(F.when(F.col("kind").isin("recognised", "revoked"), F.struct("kind", "at")), ignorenulls=True).over(so_far)
    published = F.max(F.when(F.col("kind") == "published", 1)).over(so_far)
    seen = rows.select(subject, F.row_number().over(order).alias("step"), "at", "kind", decides.alias("_last"), published.alias("_published"))
    state = F.when(F.col("_last.kind") == "recognised", "active").when(F.col("_last.kind") == "revoked", "revoked").when(F.col("_published").isNotNull(), "published").otherwise("none")
    until = F.when(F.col("_last.kind") == "recognised", F.col("_last.at") + validity).when(F.col("_last.kind") == "revoked", F.col("_last.at"))
    return seen.select(subject, "step", "at", "kind", state.alias("state"), until.alias("valid_until"))


def as_of(replayed: DataFrame, subject: str, when: Column) -> DataFrame:
    """The state of each subject at a time: its last step up to then; active beyond its validity is expired."""
    now = F.struct("step", "state", "valid_until")
    seen = replayed.groupBy(subject).agg(F.max(F.when(F.col("at") <= when, now)).alias("_step"))
    state = F.when(F.col("_step").isNull(), "none").when((F.col("_step.state") == "active") & (F.col("_step.valid_until") < when), "expired").otherwise(F.col("_step.state"))
    return seen.select(subject, state.alias("state"), F.col("_step.valid_until").alias("valid_until"))


# The kinds of events, in the order in which those of a year count, and the states they lead to.
PRECEDENCE = {
    "recognition_publicity": 10,
    "recognition": 20,
    "review_due": 30,
    "review_publicity": 40,
    "continued_support": 45,
    "annual_evaluation": 50,
    "review_passed": 60,
    "re_recognition": 70,
    "changed": 80,
    "revoked": 90,
}
ACTIVATING = ("recognition", "review_passed", "re_recognition", "annual_evaluation")
LEADS_TO = {**dict.fromkeys(ACTIVATING, "active"), "review_due": "review_due", "review_publicity": "review_pending", "revoked": "revoked"}


def lifecycle_steps(events: DataFrame, subject: str, year: Column, kind: Column, status: Column, validity: Column) -> DataFrame:
    """WIN-4: (subject, step, year, kind, previous_state, state, valid_through), the state before and after each event.

    Events of a subject count by year (none first), precedence, status and kind. A subject begins as not_recorded;
    recognition_publicity makes that publicity_pending and changes no other state; the kinds of ``LEADS_TO`` set a
    state; changed, continued_support and unknown kinds leave it. An activating event with a year sets the last
    valid year to year + ``validity``, or to none (open) if that is null; revoked sets it to its own year.

    Each event is a function from state to state, and a run of them is again one: the last state that was set, or
    else whether one was published. So events are dealt out by range of subject and order, composed within their
    range, and the ranges before, one row for each range and subject, are put in front. A subject with a third
    of all events is spread over as many tasks as its share.
    """
    known = F.create_map(*[F.lit(x) for pair in PRECEDENCE.items() for x in pair])
    leads = F.create_map(*[F.lit(x) for pair in LEADS_TO.items() for x in pair])
    rows = events.select(
        F.col(subject), year.cast("int").alias("year"), F.coalesce(kind, F.lit("")).alias("kind"), F.coalesce(status, F.lit("")).alias("_status"), validity.cast("int").alias("_validity"), F.monotonically_increasing_id().alias("_n")
    )
    rows = rows.withColumns({"_year": F.coalesce("year", F.lit(0)), "_rank": F.coalesce(F.try_element_at(known, F.col("kind")), F.lit(0))})
    order = ["_year", "_rank", "_status", "kind", "_n"]
    sets = F.when(F.col("kind").isin(*ACTIVATING) & F.col("year").isNotNull(), F.struct((F.col("year") + F.col("_validity")).alias("y"))).when(F.col("kind") == "revoked", F.struct(F.col("year").alias("y")))
    rows = rows.withColumns({"_to": F.try_element_at(leads, F.col("kind")), "_pub": F.when(F.col("kind") == "recognition_publicity", 1), "_until": sets})
    dealt = cut(rows.repartitionByRange(subject, *order).withColumn("_part", F.spark_partition_id()), "lifecycle")

    own = Window.partitionBy("_part", subject).orderBy(*order)
    before, with_it = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    within = dealt.withColumns({"_i": F.row_number().over(own), "_to_before": last("_to", before), "_pub_before": F.max("_pub").over(before), "_until_now": last("_until", with_it)})
    at = F.struct(*order)
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    parts = dealt.groupBy("_part", subject).agg(latest("_to"), F.max("_pub").alias("_pub"), latest("_until"), F.count("*").alias("_count"))
    earlier = Window.partitionBy(subject).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select("_part", F.col(subject).alias("_subject"), last("_to", earlier).alias("_c_to"), F.max("_pub").over(earlier).alias("_c_pub"), last("_until", earlier).alias("_c_until"), F.sum("_count").over(earlier).alias("_c_count"))
    both = within.join(carry, (within["_part"] == carry["_part"]) & within[subject].eqNullSafe(carry["_subject"]))
    published = F.greatest("_pub_before", "_c_pub").isNotNull()
    previous = F.coalesce("_to_before", "_c_to", F.when(published, "publicity_pending"), F.lit("not_recorded"))
    state = F.when(F.col("_to").isNotNull(), F.col("_to")).when((F.col("_pub") == 1) & (F.col("_previous") == "not_recorded"), "publicity_pending").otherwise(F.col("_previous"))
    out = both.withColumn("_previous", previous)
    return out.select(subject, (F.col("_i") + F.coalesce("_c_count", F.lit(0))).cast("long").alias("step"), "year", "kind", F.col("_previous").alias("previous_state"), state.alias("state"), F.coalesce("_until_now", "_c_until")["y"].alias("valid_through"))


def lifecycle_as_of(steps: DataFrame, subject: str, year: int | None) -> DataFrame:
    """WIN-6: (subject, state, valid_through, last_step) at the end of a year; of all events without one.

    Events without a year always count. A state that is active beyond its last valid year is
    expired_pending_review; a subject whose events all come later is not_recorded.
    """
    counts = F.lit(True) if year is None else F.col("year").isNull() | (F.col("year") <= year)
    seen = steps.groupBy(subject).agg(F.max(F.when(counts, F.struct("step", "state", "valid_through"))).alias("_last"))
    state, until = F.coalesce("_last.state", F.lit("not_recorded")), F.col("_last.valid_through")
    over = F.lit(False) if year is None else F.coalesce((state == "active") & (until < year), F.lit(False))
    return seen.select(subject, F.when(over, "expired_pending_review").otherwise(state).alias("state"), until.alias("valid_through"), F.col("_last.step").alias("last_step"))
