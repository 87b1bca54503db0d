import math
import random

import pytest
from pyspark.sql import functions as F

from dapple.functions import text as T
from dapple.operators import assignment, graph, lifecycle, relational, rules, search


def test_pick_best_and_latest(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (2, None, 1)], "k int, v string, n int")
    assert sorted(map(tuple, relational.pick_best(rows, ["k"], [-F.col("n"), F.col("v")]).collect())) == [(1, "a", 2), (2, None, 1)]
    assert {r["k"]: r["v"] for r in relational.latest_per_key(rows, ["k"], F.col("v")).collect()}[1] == "b"


def test_diffs_and_merges(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert {r["k"]: r["status"] for r in relational.snapshot_diff(a, b, ["k"], "v").collect()} == {1: "removed", 2: "modified", 3: "same", 4: "added"}
    assert sorted(map(tuple, relational.keyed_overlay(a, b, ["k"]).collect()), key=str) == [(1, "x"), (2, "z"), (3, None), (4, "w")]
    assert {r["k"]: r["v"] for r in relational.filled_overlay(a, spark.createDataFrame([(1, ""), (2, "n")], "k int, v string"), ["k"]).collect()} == {1: "x", 2: "n", 3: None}
    base = spark.createDataFrame([(i, "b") for i in range(4)], "k int, v string")
    local = spark.createDataFrame([(0, "b"), (1, "l"), (2, "b"), (3, "l")], "k int, v string")
    remote = spark.createDataFrame([(0, "b"), (1, "b"), (2, "r"), (3, "r")], "k int, v string")
    assert {r["k"]: (r["v"], r["conflict"]) for r in relational.three_way_merge(base, local, remote, "k", "v").collect()} == {0: ("b", False), 1: ("l", False), 2: ("r", False), 3: ("l", True)}


def test_upsert_and_page(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 3), (3, None, 1)], "k int, v string, version int")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "")], "k int, v string")
    got = {r["k"]: (r["v"], r["status"], r["version"]) for r in relational.upsert_with_history(old, new, ["k"], ["v"]).collect()}
    assert got == {1: ("a", "kept", 1), 2: ("c", "updated", 4), 3: (None, "unchanged", 1), 4: ("", "inserted", 1)}
    rows = relational.page(spark.range(10), [F.col("id")], 4, 3).collect()
    assert [r["id"] for r in rows] == [4, 5, 6] and rows[0]["total"] == 10 and rows[0]["has_more"] and rows[0]["next_offset"] == 7


def test_rules(spark):
    f = spark.createDataFrame([(1, 5, "verified"), (2, None, "verified"), (3, 1, "verified"), (4, 5, "candidate")], "k int, n int, e string")
    tree = {"all": [{"field": "n", "op": "gte", "value": 3}, {"any": [{"field": "k", "op": "eq", "value": 2}, {"field": "n", "op": "in", "value": [5]}]}]}
    assert {r["k"]: r["s"] for r in f.select("k", rules.status_of(rules.three_valued(tree)).alias("s")).collect()} == {1: "passed", 2: "pending", 3: "failed", 4: "passed"}
    five = {"all": [{"field": "n", "op": "gte", "value": 3, "evidence": "e"}, {"field": "k", "op": "eq", "value": 1, "when": {"field": "k", "op": "gt", "value": 9}}]}
    assert {r["k"]: r["s"] for r in f.select("k", rules.five_valued(five).alias("s")).collect()} == {1: "passed", 2: "unknown", 3: "failed", 4: "pending"}
    v = spark.createDataFrame([(None,), (-1.0,), (0.0,), (9.0,)], "v double")
    assert [r[0] for r in v.select(rules.banded(F.col("v"), [(0, 1), (5, 2)])).collect()] == [None, 0.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        rules.leaf({"field": "n", "op": "like", "value": 1})


def test_replay_and_as_of(spark):
    rows = [("a", 1, 0, "published"), ("a", 2, 1, "recognised"), ("a", 3, 0, "published"), ("b", 5, 2, "revoked"), ("c", 4, 3, "other")]
    e = spark.createDataFrame(rows, "s string, at long, o int, kind string")
    got = lifecycle.replay(e, "s", F.col("at"), F.col("o"), F.col("kind"), 3)
    steps = {}
    for r in got.orderBy("s", "step").collect():
        steps.setdefault(r["s"], []).append((r["state"], r["valid_until"]))
    assert steps == {"a": [("published", None), ("active", 5), ("active", 5)], "b": [("revoked", 5)], "c": [("none", None)]}
    states = lambda d: {r["s"]: r["state"] for r in lifecycle.as_of(got, "s", F.lit(d).cast("long")).collect()}
    assert states(4) == {"a": "active", "b": "none", "c": "none"}
    assert states(6) == {"a": "expired", "b": "revoked", "c": "none"}


def test_graph_with_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 4), (8, 8)], "src long, dst long")
    assert {r["node"]: r["component"] for r in graph.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8}
    one = spark.createDataFrame([(1,)], "node long")
    assert {r["node"]: r["distance"] for r in graph.reachable(e, one, 5).collect()} == {1: 0, 2: 1, 3: 2}
    assert {r["node"]: r["distance"] for r in graph.reachable(e, one, 1, reverse=True).collect()} == {1: 0, 3: 1}
    assert sorted(r["path"] for r in graph.paths(e, one, 5).collect()) == [[1], [1, 2], [1, 2, 3]]


def test_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert {r["component"] for r in graph.connected_components(e).collect()} == {0}


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "red red dog", "blue", "green sky", None])], "doc_id long, text string")
    parts = search.passages(docs)
    got = search.bm25(search.postings(parts), search.statistics(parts), ["red", "fox"]).collect()
    assert [r["doc_id"] for r in got] == [0] and got[0]["n_terms"] == 2
    idf = lambda n: max(math.log((5 - n + 0.5) / (n + 0.5)), 1e-6)
    norm = 1.2 * (0.25 + 0.75 * 2 / (8 / 5))
    assert got[0]["score"] == pytest.approx((idf(2) + idf(1)) * 2.2 / (1 + norm), abs=1e-5)
    assert [r["doc_id"] for r in search.bm25(search.postings(parts), search.statistics(parts), ["red", "sky"]).collect()][0] in (1, 3)


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.normal_url(F.lit("HTTP://Ex.com:80//a//b?utm_source=x&b=2&a=1#f"))) == "http://ex.com/a/b?a=1&b=2"
    assert one(T.compact_name(F.lit("A-b (C) 1."))) == "abc1"
    assert one(T.years(F.lit("2021, 12021 and 2019 2019"))) == [2019, 2021]
    assert one(T.iso_dates(F.lit("2024-02-30 2024/1/5 2023.12.31"))) == ["2023-12-31", "2024-01-05"]
    assert one(T.split_list(F.lit("a; b,,a"))) == ["a", "b"]
    assert one(T.jaccard(T.ngrams(F.lit("abcd"), 2), T.ngrams(F.lit("abce"), 2))) == 0.5
    assert one(T.ngrams(F.lit("a"), 2)) == []
    assert one(T.sequence_ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75
    assert one(T.nfkc(F.lit("ＡＢ①"))) == "AB1"
    assert one(T.clauses(F.lit("One. Two! x"))) == ["One.", "Two!", "x"]
    text = "a" * 900 + "\n" + "b" * 900
    assert next(T.chunk_spans(text)) == (0, 901)
    assert one(T.boundary_chunks(F.lit(text)))[1].startswith("a" * 179)


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = relational.numbered(rows, [F.col("v")], "n").collect()
    assert {r["v"]: r["n"] for r in got} == {v: v + 1 for v in range(1000)}


def test_greedy_match_equals_one_pass(spark):
    import random

    r = random.Random(4)
    pairs = [(a, b, r.randrange(6) / 5) for a in range(15) for b in range(12) if r.random() < 0.6]
    want, left, right = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in left and b not in right:
            want.add((a, b, s))
            left.add(a)
            right.add(b)
    got = relational.greedy_match(spark.createDataFrame(pairs, "a long, b long, s double"), "a", "b", "s")
    assert {tuple(x) for x in got.collect()} == want
    assert relational.greedy_match(spark.createDataFrame([], "a long, b long, s double"), "a", "b", "s").collect() == []


def test_nearest_assignment_equals_one_pass(spark):
    r = random.Random(14)
    for many, span in ((60, 400), (25, 12)):
        left = [(i, r.choice("xyz"), r.randrange(span)) for i in range(many)] + [(900, None, 3), (901, "x", None), (902, "alone", 5)]
        right = [(1000 + i, r.choice("xyz"), r.randrange(span)) for i in range(30)]
        pairs = sorted((abs(v - w), i, j, p) for i, p, v in left for j, q, w in right if p == q and p is not None and v is not None)
        used, want = set(), set()
        for d, i, j, p in pairs:
            if i not in used and j not in used:
                used |= {i, j}
                want.add((p, i, j, d))
        schema = "id long, b string, v long"
        x, y = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).withColumnRenamed("id", "other")
        got = assignment.nearest_assignment(x, y, "b", F.col("v"), F.col("v"), "id", "other")
        assert {tuple(z) for z in got.collect()} == want
    assert assignment.nearest_assignment(x.limit(0), y, "b", F.col("v"), F.col("v"), "id", "other").collect() == []


def test_carried_values_of_a_hot_key(spark):
    r = random.Random(21)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), i * 7 % 501, r.choice([None, None, i])) for i in range(400)]
    want, last = [], {}
    for k, at, v in sorted(rows, key=lambda x: x[1]):
        want.append((k, at, v, last.get(k)))
        last[k] = v if v is not None else last.get(k)
    frame = spark.createDataFrame(rows, "k string, at long, v long")
    got = relational.carried(frame, ["k"], [F.col("at")], F.col("v"), "before")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert relational.carried(frame.limit(0), ["k"], [F.col("at")], F.col("v"), "before").collect() == []
