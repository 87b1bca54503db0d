import gc
import random
import weakref

import duckdb

import corpus_pipeline
from dapple.llm import importance, suffixtree
from dapple.plans import ORACLE_SQL, QUERIES
from tests.llm.conftest import make


def test_reachable_starts_at_every_source(spark, tmp_path):
    """2 is no root, as an order leads from 1 to it, and yet a start: 3 is one step from it and two from 1."""
    rows = [(10, 1), (10, 2), (11, 2), (11, 3), (12, 3), (12, 4), (13, 4), (13, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in QUERIES["grf2_3_reachable"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == set(duck.sql(ORACLE_SQL["grf2_3_reachable"]).fetchall())
    assert {(s, n, d) for s, n, d, _ in got} == {(s, n, n - s) for s in range(1, 5) for n in range(s, min(s + 3, 5) + 1)}


def test_count_matrix_has_a_row_for_each_document(spark):
    """A row that held a block of documents made Parquet's readers and writers hold thousands of blocks at a time."""
    rows = [(i, " ".join(f"w{i + j}" for j in range(300)), "s") for i in range(50)] + [(50, None, "s"), (None, "a a b", "s")]
    got = importance.count_matrix(make(spark, rows).coalesce(1), buckets=97).collect()
    assert [(r["doc_id"], r["n_words"]) for r in got] == [(i, len((t or "").split())) for i, t, _ in rows]
    assert all(sum(r["counts"]) == r["n_words"] and len(r["columns"]) == len(set(r["columns"])) <= 97 for r in got)


def test_scores_of_a_tree_in_parts(spark, monkeypatch):
    """Tasks that hold few pairs at a time get the whole tree's scores; a bound for pairs once rose until they fitted."""
    r = random.Random(3)
    phrases = ["the terms of use apply here", "terms of use are long", "we use the long road home", "a road of terms"]
    docs = make(spark, [(i, " ".join(r.choice(phrases) for _ in range(r.randrange(1, 9))), "s") for i in range(120)] + [(None, None, "s")])
    bounds = suffixtree.Least(100.0, 400.0, 60.0)
    whole = {x["doc_id"]: x["score"] for x in suffixtree.score_documents(docs, 5, bounds, 2.0).collect()}
    monkeypatch.setattr(suffixtree, "TREE_PAIRS", 20)
    parts = {x["doc_id"]: x["score"] for x in suffixtree.score_documents(docs, 5, bounds, 2.0).collect()}
    assert len(whole) == 121 and max(abs(parts[i] - z) for i, z in whole.items()) < 1e-9


class Spent:
    def __init__(self):
        self.own = self  # only a collection finds it


def test_stages_of_the_pipeline_let_go_of_what_is_spent(spark, monkeypatch):
    gc.disable()
    try:
        for name, by in (("toxicity", "drop_toxic"), ("near_dedup", "drop_near_duplicates"), ("decontamination", "drop_leaks"), ("mixing", "mix_rows"), ("token_ids", "token_output")):
            monkeypatch.setattr(corpus_pipeline, by, lambda docs, *_: docs)
            spent = weakref.ref(Spent())
            assert spent() is not None
            getattr(corpus_pipeline, name)(spark, spark.range(1), "/root/testdata/sf0.001")
            assert spent() is None
    finally:
        gc.enable()
