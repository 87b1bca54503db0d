import random

import pytest
from pyspark.sql import functions as F

from dapple.operators import identity as I
from dapple.operators import lifecycle as L
from dapple.operators.ledger import RunLedger


def replay_by_hand(events, validity):
    """events: (year, kind, status) of one subject."""
    state, until, steps = "not_recorded", None, []
    for i, (year, kind, _) in enumerate(sorted(events, key=lambda e: (e[0] or 0, L.PRECEDENCE.get(e[1] or "", 0), e[2] or "", e[1] or "")), 1):
        before = state
        if kind == "recognition_publicity":
            state = "publicity_pending" if state == "not_recorded" else state
        else:
            state = L.LEADS_TO.get(kind, state)
        if kind in L.ACTIVATING and year is not None:
            until = None if validity is None else year + validity
        if kind == "revoked":
            until = year
        steps.append((i, year, kind or "", before, state, until))
    return steps


def test_lifecycle_of_a_hot_subject(spark):
    r = random.Random(9)
    kinds = [*L.PRECEDENCE, "unheard_of", None]
    event = lambda: (r.choice([None, *range(2000, 2012)]), r.choice(kinds), r.choice([None, "a", "b"]))
    rows = {("hot", 3): [event() for _ in range(400)], ("open", None): [event() for _ in range(30)], (None, 2): [event() for _ in range(12)]}
    rows |= {(f"s{i}", 1 + i % 4): [event() for _ in range(r.randint(1, 6))] for i in range(30)}
    flat = [(s, v, *e) for (s, v), events in rows.items() for e in events]
    frame = spark.createDataFrame(flat, "subject string, validity int, year int, kind string, status string").withColumn("step", F.lit("x"))
    got = L.lifecycle_steps(frame, "subject", F.col("year"), F.col("kind"), F.col("status"), F.col("validity"))
    want = [(s, *step) for (s, v), events in rows.items() for step in replay_by_hand(events, v)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    for year in (None, 2005):
        now = {x.subject: (x.state, x.valid_through, x.last_step) for x in L.lifecycle_as_of(got, "subject", year).collect()}
        for (s, v), events in rows.items():
            seen = [x for x in replay_by_hand(events, v) if year is None or x[1] is None or x[1] <= year]
            step, _, _, _, state, until = seen[-1] if seen else (None, None, None, None, "not_recorded", None)
            assert now[s] == ("expired_pending_review" if year and state == "active" and until is not None and until < year else state, until, step)
    assert L.lifecycle_steps(frame.limit(0), "subject", F.col("year"), F.col("kind"), F.col("status"), F.col("validity")).collect() == []


A, B, C = "A" * 18, "B" * 18, "C" * 18


def test_identities(spark):
    masters = [(1, "Old Mill", [], None), (2, "old-mill", ["Mill Two"], "p2"), (3, "New Mill", ["Mill Two", None], ""), (4, "Nobody", None, None), (5, "???", [], "p5"), (6, "Both", [], None), (4, "Nobody", None, None)]
    registry = [("OLD MILL", None, A.lower()), ("Mill 2", "mill two", B), ("New Mill", "x", C), ("Both", None, A), ("both", None, C), ("Nobody", None, "short"), ("Nobody", None, None)]
    got = I.resolve_identities(spark.createDataFrame(masters, "master long, name string, former array<string>, platform_id string"), spark.createDataFrame(registry, "name string, former_name string, code string"))
    keys = {r.master: (r.identity_key, r.confidence) for r in got.masters.collect()}
    assert {m: k for m, (k, _) in keys.items()} == {1: A, 2: "pending:p2", 3: "pending:newmill", 4: "name:nobody", 5: "platform:p5", 6: "pending:both"}
    assert keys[3][1] == "conflict_pending_manual_review" and got.invalid.count() == 2
    paths = {(r.master, r.code): r.path for r in got.conflicts.collect()}
    assert paths == {(2, B): f"{A} > oldmill > master:2 > milltwo > {B}", (3, C): f"{B} > milltwo > master:3 > newmill > {C}", (6, C): f"{A} > both > {C}"}
    assert {r.identity_key: r.n_masters for r in got.identities.collect()}["name:nobody"] == 2
    assert {(r.alias, r.alias_type) for r in got.aliases.filter("identity_key = 'pending:p2'").collect()} == {("old-mill", "current_or_list_name"), ("Mill Two", "former_name")}


def test_lookup_and_conflicts(spark):
    nodes = [("s1", "current_name", "Old Mill"), ("s1", "former_name", "Water Mill"), ("s1", I.CODE_NODE, A), ("s1", I.CODE_NODE, B), ("s2", "current_name", "old mill"), ("s2", I.CODE_NODE, B), ("s3", "current_name", "Wind Mill"), ("s3", I.MERGED_NODE, "s9"), ("s4", "former_name", "")]
    frame = spark.createDataFrame(nodes, "subject string, node_type string, value string")
    found = {(r.kind, r.subject, r.by, r.other) for r in I.identity_conflicts(I.with_normal(frame)).collect()}
    same, code, many, missing, merged = I.CONFLICTS
    assert found == {(same, "s1", "oldmill", "s1"), (same, "s2", "oldmill", "s1"), (code, "s1", B.lower(), "s1"), (code, "s2", B.lower(), "s1"), (many, "s1", A, A), (many, "s1", A, B), (missing, "s3", None, "Wind Mill"), (missing, "s4", None, None), (merged, "s3", None, "s9")}
    queries = spark.createDataFrame([(1, "OLD  MILL"), (2, f" {B.lower()}"), (3, "mill"), (4, "no such"), (5, None), (6, " - "), (7, "Water mill")], "query_id long, query string")
    got = {(r.query_id, r.subject, r.matched_by): r.conflicts for r in I.lookup_identities(frame, queries).collect()}
    assert got == {
        (1, "s1", "current_name"): f"{same},{many}", (1, "s2", "current_name"): same, (2, "s1", I.CODE_NODE): f"{code},{many}", (2, "s2", I.CODE_NODE): code,
        (3, "s1", "current_name"): many, (3, "s2", "current_name"): "", (3, "s3", "current_name"): f"{merged},{missing}", (3, "s1", "former_name"): many, (7, "s1", "former_name"): many,
    }
    assert I.lookup_identities(frame, queries.filter("query_id = 3"), limit=2).count() == 2
    part = {r.subject: r.component for r in I.identity_components(I.with_normal(frame)).collect()}
    assert part == {"s1": "s1", "s2": "s1", "s3": "s3", "s4": "s4"}


def test_a_run_goes_on_where_it_broke_off(spark, tmp_path):
    ledger = RunLedger(spark, f"file://{tmp_path}/l")
    assert ledger.entries().collect() == []
    with pytest.raises(ValueError):
        ledger.rows()
    read = []
    bad = F.when(F.col("v") < 0, "negative")

    def source(name, values):
        def get():
            read.append(name)
            if values is None:
                raise KeyboardInterrupt
            return spark.createDataFrame([(name, v) for v in values], "name string, v long")

        return name, get

    inputs = [source("a", [1, 2]), source("b", [3, -4]), source("c", None), source("d", [-5])]
    with pytest.raises(KeyboardInterrupt):
        ledger.run("r1", inputs, bad, "2024-01-01")
    assert sorted(map(tuple, ledger.rows().collect())) == [("a", 1), ("a", 2), ("b", 3)]
    inputs[2] = source("c", [6])
    inputs.append(("e", lambda: spark.read.parquet(f"{tmp_path}/missing.parquet")))
    assert ledger.run("r1", inputs, bad, "2024-01-01") == "partial" and ledger.run("r1", inputs, bad, "2024-01-01") == "partial"
    status = {r.input: (r.status, r.rows, r.rejected) for r in ledger.entries().collect()}
    assert status == {"a": ("success", 2, 0), "b": ("partial", 2, 1), "c": ("success", 1, 0), "d": ("failed", 1, 1), "e": ("failed", 0, 0)}
    assert sorted(map(tuple, ledger.rows().collect())) == [("a", 1), ("a", 2), ("b", 3), ("c", 6)]
    assert [(r.v, r._problem) for r in ledger.rows(rejected=True).orderBy("v").collect()] == [(-5, "negative"), (-4, "negative")]
    assert read == ["a", "b", "c", "c", "d"] and ledger.entries().count() == 5  # nothing that was done is read again
    assert ledger.days().first().asDict() == {"day": "2024-01-01", "inputs": 5, "rows": 6, "rejected": 2, "failed": 2}
