import difflib
import random
from itertools import combinations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from dapple.functions import text as T
from dapple.operators import assignment, dictionary, graph, priorart, relational, search
from dapple.plans import ORACLE_SQL, QUERIES


def oracle(name, folder, *tables):
    duck = duckdb.connect()
    for t in tables:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return duck.sql(ORACLE_SQL[name]).fetchall()


def test_aliases_in_upper_case_keep_their_letters(spark, tmp_path):
    """A region's canonical form is its word in upper case: Spark's made SS of a sharp s, and a final sigma was another letter."""
    texts = ["Die ungeheitß und mäßig ﬁxierte große ᾳβγδεζ straße", "ΟΔΟΣΟΔΟΣ und İstanbul"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    turns = [(1, 1, "user", "MÄßIG ungeheitß und ﬁxierte ᾳβγδεζ"), (1, 2, "user", "ΟΔΟΣΟΔΟΣ istanbul οδοσοδοσ"), (2, 1, "user", None), (2, 2, "user", "große straße 2021"), (2, 3, "user", "MÄßIG straße ungeheitß ᾳβγδεζ; ﬁxierte und οδοσοδοΣ")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in QUERIES["str17_18_alias_plan"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(oracle("str17_18_alias_plan", tmp_path, "benchmark", "conversations"))
    assert [r[4] for r in got if r[:2] == (2, 3)] == ["STRAẞE,UNGEHEITẞ,ᾼΒΓΔΕΖ,ﬁXIERTE,ΟΔΟΣΟΔΟΣ"]


def test_trigram_postings_in_blocks(spark, tmp_path):
    """A posting was a row, so the index of 0.1 GB had 78 million rows; it is a list now, and a document stands in one list of a trigram."""
    r = random.Random(5)
    rows = [(i % 37, "".join(r.choice("abc ÄßΣ三") for _ in range(r.choice([0, 2, 3, 40, 2500])))) for i in range(60)] + [(50, None), (51, "Licensed licenses"), (None, "LICENSΣ"), (52, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("fts1_trigram_index", "fts1_trigram_search"):
        got = [tuple(x) for x in QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(map(str, got)) == sorted(map(str, oracle(name, tmp_path, "documents"))) and got
    parts = search.passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))
    blocks = search.trigram_postings(parts, block_chars=500).collect()
    postings = [(x.gram, d, c) for x in blocks for d, c in zip(x.doc_id, x.chunk, strict=True)]
    want = {(x.content.lower()[i : i + 3], x.doc_id, x.chunk) for x in parts.collect() for i in range(len(x.content) - 2)}
    assert len(postings) == len(set(postings)) and {(g.replace("ς", "σ"), d, c) for g, d, c in want} == set(postings)
    assert len(postings) > 2 * len(blocks) and max(sum(d in x.doc_id for x in blocks if x.gram == "abc") for d in range(37)) == 1


def test_assignment_lists_no_pairs(spark, monkeypatch):
    """All pairs of a block were listed and a round taken for each row of a one-sided run; sums of both sides tie here in many ways."""
    r = random.Random(8)
    for n, m in ((40, 9), (9, 40), (15, 15)):
        value = lambda: r.choice([None, float("nan"), 1024.0, 1.0, 9000 + r.randrange(40) / 100, r.randrange(900, 960) / 10])
        left = spark.createDataFrame([(i, value(), r.choice([1, 2, None])) for i in range(n)], "a long, v double, k int")
        right = spark.createDataFrame([(i, value(), r.choice([1, 2, 3])) for i in range(m)], "b long, w double, k int")
        score = F.round(1 / (1 + F.abs(F.col("v") - F.col("w"))), 9).alias("score")
        want = relational.greedy_match(left.join(right, "k").select("a", "b", score), "a", "b", "score").collect()
        got = assignment.similar_assignment(left, right, "k", F.col("v"), F.col("w"), "a", "b")
        assert sorted(map(str, got.collect())) == sorted(map(str, want)) and want
    assert [assignment.billionths(d) for d in (0.0, 1.0, 1023.0)] == [10**9, 5 * 10**8, 976563]
    monkeypatch.setattr(assignment, "billionths", lambda d, f=assignment.billionths: (seen.append(d), f(d))[1])
    seen: list[float] = []
    own, other = {i: 900 + i % 1000 / 10 for i in range(2000)}, {i: 1000.0 + 9 * i for i in range(1000)}
    assert len(assignment.similar_pairs(own, other)) == 1000 and len(seen) < 100_000  # of two million pairs


def test_close_names_in_blocks(spark, monkeypatch):
    """Nearly all names shared one of their rarest bigrams, and each such pair was a row; few pairs are scored now, whatever block they are in."""
    r = random.Random(9)
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "ß", "三", "ing ", "the ")) for _ in range(r.randint(4, 30)))[:60]
    names = [word() for _ in range(150)] + ["in " * 20, "in " * 19 + "on ", "n i" * 20, "a" * 64, "a" * 70, "ab" * 150, "ab" * 150 + "c"]
    for x in list(names):
        y = list(x)
        for _ in range(r.randint(1, 1 + len(y) // 8)):
            y[r.randrange(len(y))] = r.choice(["", "x", "an", y[0]])
        names.append("".join(y))
    own = sorted({x for x in names if len(x) >= 8})
    want = sorted((x, y) for x, y in combinations(own, 2) if difflib.SequenceMatcher(None, x, y).ratio() >= 0.9)
    rows = spark.createDataFrame([("p", x) for x in names], "b string, n string")
    for size in (dictionary.BLOCK_CHARS, 3000):
        got = dictionary.close_names(rows, "b", "n", block_chars=size).collect()
        assert sorted((x.x, x.y) for x in got) == want and len(want) > 50
    scored = []
    monkeypatch.setattr(dictionary.difflib, "SequenceMatcher", lambda _, x, y, f=difflib.SequenceMatcher: (scored.append(x), f(None, x, y))[1])
    ys = sorted(own, key=lambda x: (len(x), x))
    assert len(list(dictionary.close_to(own, ys, dictionary.lettered(ys, 2), dictionary.lettered(ys, 1), 0.9))) == len(want)
    assert len(scored) < 0.1 * len(own) ** 2 / 2


def test_title_groups_take_any_sign(spark, tmp_path):
    """A title that held the unit separator lost what came after it; groups of many titles rest on test_close_names_in_blocks."""
    page = lambda t: f'<html lang="en"><title>{t}</title></html>'
    spark.createDataFrame([(1, page("annual\x1freport 2021")), (2, page("annual\x1freport 2022")), (3, page("other"))], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.title_group for r in QUERIES["jn13_title_groups"](spark, str(tmp_path)).collect()}
    assert got == {1: "annual\x1freport 2021", 2: "annual\x1freport 2021", 3: "other"}


def test_likely_pairs_by_bounds(spark):
    """A ratio was worked out for most pairs that share a trigram: its bounds by letters and subsequences leave few."""
    r = random.Random(11)
    text = lambda: "".join(r.choice(("th", "er", "on", "an", "ß", "三", "ing", "the", "x")) for _ in range(r.choice([1, 2, 8, 20, 20, 45, 90])))
    own, other = [text() for _ in range(60)], [text() for _ in range(150)] + [""]
    other += ["".join(c for c in x if r.random() < 0.9) for x in own] + [x + "y" * 70 for x in own[:20]]
    for x in own[:30]:
        for y in other:
            assert T.ratio(x, y) == difflib.SequenceMatcher(None, x, y).ratio()

    def subsequence(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            before = row[:]
            for k, d in enumerate(y):
                row[k + 1] = before[k] + 1 if c == d else max(before[k + 1], row[k])
        return row[-1]

    pairs = [(i, j) for i in range(len(own)) for j in range(0, len(other), 7)]
    got = priorart.Common(own).lengths(np.array([i for i, _ in pairs]), other, np.array([j for _, j in pairs]))
    assert got.tolist() == [subsequence(own[i], other[j]) for i, j in pairs]

    def score(x, y):
        g, h = priorart.gram_set(x), priorart.gram_set(y)
        return round(0.45 * difflib.SequenceMatcher(None, x, y).ratio() + 0.55 * (len(g & h) / len(g | h)), 4)

    want = sorted((str(i), j, s) for i, x in enumerate(own) for j, y in enumerate(other) if y and (s := score(x, y)) >= 0.42)
    f = spark.createDataFrame([(str(i), x) for i, x in enumerate(own)], "feature string, x string")
    p = spark.createDataFrame([(j, 0, y) for j, y in enumerate(other)], "document long, locator int, x string")
    for size in (priorart.BLOCK_CHARS, 700):
        assert sorted((x.feature, x.document, x.score) for x in priorart.likely_pairs(f, p, block_chars=size).collect()) == want and want
    bounds = [2 * n / (len(own[i]) + len(other[j])) for (i, j), n in zip(pairs, got.tolist(), strict=True)]
    assert all(b >= T.ratio(own[i], other[j]) for (i, j), b in zip(pairs, bounds, strict=True))


def test_reachable_shuffles_starts_only(spark, tmp_path, monkeypatch):
    """Each step joined all that was reached with all edges and wrote it; a graph that a worker can hold is walked from each start."""
    r = random.Random(13)
    rows = [(r.randrange(60), r.randrange(80)) for _ in range(220)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    written = []
    monkeypatch.setattr(graph, "cut", lambda rows, label, f=graph.cut: (written.append(label), f(rows, label))[1])
    got = [tuple(x) for x in QUERIES["grf2_3_reachable"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, oracle("grf2_3_reachable", tmp_path, "lineitem"))) and max(x[2] for x in got) == 3
    assert written == ["steps"]
    edges = spark.createDataFrame([(r.randrange(40), r.randrange(40)) for _ in range(70)], "src int, dst int")  # with cycles
    starts = spark.createDataFrame([(i,) for i in (3, 3, 7, 99, None)], "node int")
    for reverse in (False, True):
        held = sorted(map(str, graph.reachable(edges, starts, 4, reverse).collect()))
        monkeypatch.setattr(graph, "BLOCK_EDGES", 0)
        assert held == sorted(map(str, graph.reachable(edges, starts, 4, reverse).collect())) and len(held) > 8
        monkeypatch.setattr(graph, "BLOCK_EDGES", 100)
