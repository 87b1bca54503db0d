import difflib
import random
from itertools import combinations

from dapple.operators import dictionary
from dapple.plans import QUERIES

NAMES = ["small rod", "old rod", "small rod", "red", "red wheel", "large red wheel", "wheel red large", "rod", "", "", "ab", "steel rod small", "old rods"]


def write_parts(spark, folder):
    rows = [(1 + 60 * i, x, "Brand#1", 1) for i, x in enumerate(NAMES)] + [(9000, "small rod", "Brand#2", 1), (9001, None, "Brand#1", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{folder}/part.parquet")
    return [(k, x) for k, x, brand, _ in rows if brand == "Brand#1" and x is not None]


def test_similar_names_equal_brute_force(spark, tmp_path):
    def score(x, y):
        short, long_ = sorted((len(x), len(y)))
        if x == y:
            return 1.0
        if short >= 4 and (x in y or y in x) and short / long_ >= 0.6:
            return 0.94
        return round(difflib.SequenceMatcher(None, x, y).ratio(), 4)

    parts = write_parts(spark, tmp_path)
    want = sorted((a, b, score(x, y)) for (a, x), (b, y) in combinations(parts, 2) if score(x, y) >= 0.6)
    got = sorted(tuple(r) for r in QUERIES["str3_4_similar_names"](spark, str(tmp_path)).collect())
    assert got == want and (1, 61, 0.625) in got


def test_jaccard_of_names_equals_brute_force(spark, tmp_path):
    parts = write_parts(spark, tmp_path)
    grams = lambda x: {x[i : i + 3] for i in range(len(x) - 2)}
    want, names = {("Brand#2", "small rod", "small rod", 100.0)}, {x for _, x in parts} - {""}
    for x in names:
        for y in names:
            g, h = grams(x), grams(y)
            score = 100.0 if x == y else 85 + min(10, 10 * len(x) / len(y)) if x in y and len(x) > 2 else 80 * len(g & h) / max(1, len(g | h))
            if score >= 20:
                want.add(("Brand#1", x, y, round(score, 4)))
    assert {tuple(r) for r in QUERIES["sim1_3_jaccard"](spark, str(tmp_path)).collect()} == want
    assert QUERIES["sim1_3_name_parts"](spark, str(tmp_path)).count() == len(parts) + 2


def test_hybrid_score_equals_brute_force(spark, tmp_path):
    parts = write_parts(spark, tmp_path)
    grams = lambda x: {x[i : i + 3] for i in range(len(x) - 2)}
    want = []
    for (a, x), (b, y) in combinations(parts, 2):
        g, h = grams(x), grams(y)
        j = len(g & h) / len(g | h) if g | h else 0.0
        if j * 0.55 + 0.45 >= 0.6:
            want.append((a, b, round(j * 0.55 + difflib.SequenceMatcher(None, x, y).ratio() * 0.45, 4)))
    assert want and sorted(tuple(r) for r in QUERIES["sim2_hybrid_score"](spark, str(tmp_path)).collect()) == sorted(want)


def test_chunk_sizes_of_the_query(spark, tmp_path):
    text = ("one two three. " * 200) + "\n" + "x" * 3000
    spark.createDataFrame([(1, text), (2, None), (3, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["str13_boundary_chunks"](spark, str(tmp_path)).orderBy("doc_id", "chunk").collect()]
    assert got[-1] == (3, 0, 5) and not [r for r in got if r[0] == 2]
    own = [n for d, _, n in got if d == 1]
    assert max(own) <= 1200 and sum(own) == len(text) + 180 * (len(own) - 1)


def test_greedy_assignment_of_the_query(spark, tmp_path):
    parts = [(i, 900.0 + 7 * i % 50, i % 9 + 1) for i in range(30)]
    suppliers = [(i, 900.0 + 11 * i % 60) for i in range(20)]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    pairs = [(-round(1 / (1 + abs(p - abs(b))), 9), i, j) for i, p, n in parts for j, b in suppliers if n % 10 + 1 == j % 10 + 1]
    left, right, want = set(), set(), []
    for s, i, j in sorted(pairs):
        if i not in left and j not in right:
            want.append((i, j, -s))
            left.add(i)
            right.add(j)
    assert sorted(tuple(r) for r in QUERIES["jn15_greedy_assignment"](spark, str(tmp_path)).collect()) == sorted(want) and want


def test_close_names_equal_brute_force(spark):
    r = random.Random(6)
    names = ["".join(r.choice("abcde") for _ in range(r.randint(6, 24))) + r.choice(["", " company limited"]) for _ in range(60)]
    for x in list(names):
        for _ in range(3):
            y = list(x)
            for _ in range(r.randint(0, 3)):
                y[r.randrange(len(y))] = r.choice(["", "x", "ab"])
            names.append("".join(y))
    names += ["aaaaaaaa", "aaaaaaaaa", "abababab", "ababababa", "short", "", None]
    rows = [(r.choice(["p", "q", None]), n) for n in names for _ in range(2)]
    want = set()
    for block in ("p", "q", None):
        own = sorted({n for b, n in rows if b == block and n is not None and len(n) >= 8})
        want |= {(block, x, y, int(s * 10000 + 0.5) / 10000) for x, y in combinations(own, 2) if (s := difflib.SequenceMatcher(None, x, y).ratio()) >= 0.9}
    got = dictionary.close_names(spark.createDataFrame(rows, "b string, n string"), "b", "n").collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want and len(want) > 40
    assert dictionary.close_names(spark.createDataFrame([], "b string, n string"), "b", "n").collect() == []


def test_title_groups(spark, tmp_path):
    page = lambda t, lang="en": f'<html lang="{lang}"><head><title>{t}</title></head></html>'
    rows = [(1, page("annual report 2021")), (2, page("annual report 2022")), (3, page("annual report  2022")), (4, page("annual report 2022", "de")), (5, page("x")), (6, "<html>"), (7, None), (8, page("annual reports 2022"))]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.title_group for r in QUERIES["jn13_title_groups"](spark, str(tmp_path)).collect()}
    assert got == {1: "annual report 2021", 2: "annual report 2021", 3: "annual report 2021", 8: "annual report 2021", 4: "annual report 2022", 5: "x"}
    pairs = {(r.x, r.y) for r in QUERIES["jn13_close_titles"](spark, str(tmp_path)).collect()}
    assert ("annual report 2021", "annual report 2022") in pairs and len(pairs) == 3
