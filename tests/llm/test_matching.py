import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from dapple.llm import annsearch, decontam, neardup
from tests.llm.conftest import make, prose


def edit_distance_within(p, s):
    row = [0] * (len(s) + 1)
    for i, x in enumerate(p):
        new = [i + 1]
        for j, y in enumerate(s):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_equal_full_alignment():
    r, items = random.Random(3), [(i, decontam.normal(prose(900 + i, 25 + i))) for i in range(12)]
    index = decontam.Index(items)
    for _ in range(60):
        k = r.randrange(len(items))
        p = list(items[k][1])
        for _ in range(r.randrange(0, max(2, int(0.1 * len(p))))):
            j = r.randrange(len(p))
            p[j : j + r.randrange(2)] = r.choice(["", "q", "qq"])
        text = decontam.normal(f"{prose(r.randrange(99), 20)} {''.join(p)} {prose(r.randrange(99), 9)}")
        best = edit_distance_within(items[k][1], text)
        hits = [h for h in index.find([text])[0] if h[0] == k]
        assert bool(hits) == (best <= index.edits[k])
        if hits:
            assert hits[0][3] == best and edit_distance_within(items[k][1], text[hits[0][1] : hits[0][2]]) == best


def test_leaks_odd_cases(spark, odd_rows):
    item = prose(77, 30)
    rows = [*odd_rows, (40, f"{prose(1, 50)}\n{item.upper().replace(' ', '  ')} {prose(2, 9)}", "s"), (41, "tiny", "s")]
    docs, items = make(spark, rows, extra=True), spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny"), (4, "tiny")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontam.find_leaks(docs, items).collect())
    assert got == [(40, 1, 0), (41, 4, 0), (41, 4, 0)]
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontam.find_leaks(docs, items, block_chars=3).collect()) == got
    kept = decontam.drop_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
    assert decontam.find_leaks(docs, items.limit(0)).collect() == [] and decontam.find_leaks(docs.limit(0), items).collect() == []


def shingle_counts(text):
    w = (text or "").encode().lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def weights_of(bags):
    """The stated weight of each shingle: 1 below a share of 1/50 of the documents, 1/2 in all of them."""
    n, seen = len(bags), Counter(s for b in bags for s in b)
    mean = sum(seen.values()) / neardup.SLOTS
    share = {s: max(c - mean, 1e-9) / n for s, c in seen.items()}
    return {s: 1.0 if x < neardup.FREE_SHARE else min(1.0, 0.5 + 0.5 * math.log(x) / math.log(neardup.FREE_SHARE)) for s, x in share.items()}


def weighted_jaccard(a, b, w):
    shared = sum(min(n, b[s]) * w[s] for s, n in a.items() if s in b)
    every = sum(n * w[s] for s, n in a.items()) + sum(n * w[s] for s, n in b.items())
    return shared / (every - shared) if shared else 0.0


def test_near_duplicates_equal_brute_force(spark, odd_rows):
    rows, r = list(odd_rows), random.Random(9)
    for g in range(12):
        words = prose(300 + g, 80 + 10 * g).split()
        for k in range(4):
            own = list(words)
            for _ in range(r.randrange(0, 4)):
                own[r.randrange(len(own))] = f"x{r.random()}"
            rows.append((1000 + 10 * g + k, " ".join(own), "s"))
    rows += [(2000 + i, " ".join(prose(900, 100).split()) + f" tail{i}", "s") for i in range(30)] + [(3000, "ONE   two", "s")]
    got = neardup.near_duplicates(make(spark, rows, extra=True)).collect()
    bags = [shingle_counts(t) for _, t, _ in rows]
    weights = weights_of(bags)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if weighted_jaccard(bags[a], bags[b], weights) >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = lambda pairs: sorted(sorted(v) for v in pairs.values())
    want, have = {}, {}
    for i, (d, _, _) in enumerate(rows):
        want.setdefault(root(i), []).append(str(d))
    for x in got:
        have.setdefault(x["class_rid"], []).append(str(x["doc_id"]))
    assert groups(have) == groups(want)


def test_hot_bucket_is_compared_whole(spark):
    """One bucket: a large class, pairs that are alike but unlike it, and a chain whose ends are not alike."""
    r = np.random.default_rng(4)
    fresh = lambda n: r.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    sets = [np.concatenate([core, fresh(4)]) for core in [fresh(96)] for _ in range(20)]
    sets += [np.concatenate([core, fresh(10)]) for core in (fresh(90) for _ in range(12)) for _ in range(2)]
    line = fresh(200)
    sets += [line[8 * k : 8 * k + 100] for k in range(10)]
    sets = [np.sort(x) for x in sets]
    feats = spark.createDataFrame([(i, i, b"%d" % i, [7], x.tobytes()) for i, x in enumerate(sets)], neardup.FEATURES)
    _, links, roots, _ = neardup.link_classes(feats, np.ones(neardup.SLOTS))
    have = {x["node"]: x["root"] for x in roots.collect()}
    assert have == {x["node"]: x["root"] for x in neardup.components(links).collect()}
    got = [have.get(i, i) for i in range(len(sets))]
    assert got == [0] * 20 + [20 + i // 2 * 2 for i in range(24)] + [44] * 10


def test_prefixes_lose_no_link(spark):
    r, idf = np.random.default_rng(6), np.where(np.arange(neardup.SLOTS) % 3 == 0, 0.5, 1.0)
    cores = [r.integers(0, 1 << 32, 60, dtype=np.uint64) for _ in range(5)]
    sets = []
    for i in range(60):
        x = cores[i % 5][r.random(60) > 0.12]
        sets.append(np.sort(np.concatenate([x, r.integers(0, 1 << 32, 3, dtype=np.uint64), np.repeat(x[:1], r.integers(0, 12))]).astype("<u4")).tobytes())
    pairs = {(a, b) for b in range(60) for a in range(b) if neardup.similarity(sets[a], sets[b], idf) >= neardup.SIMILAR}
    buckets = spark.createDataFrame([(1, i) for i in range(60)], "bucket long, rid long")
    texts = spark.createDataFrame(list(enumerate(sets)), "rid long, shingles binary")
    got = {tuple(x) for x in neardup.untried_pairs(buckets, None, texts, idf)[0].collect()}
    assert pairs and pairs <= got


def test_drop_near_duplicates(spark, odd_rows, tmp_path):
    make(spark, [*odd_rows, (60, prose(5, 40) + " end", "s")], extra=True).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(["1", "2", "3", "None", "5", "7", "8"])
    assert neardup.near_duplicates(docs.limit(0)).collect() == []


def test_samples_follow_weighted_similarity():
    a = prose(1, 500).split()
    b = a[100:] + prose(2, 100).split()
    s = neardup.shingles([" ".join(a).encode(), " ".join(b).encode()])
    idf = np.where(np.arange(neardup.SLOTS) % 3 == 0, 0.5, 1.0)
    draws = [neardup.sample(s, 2, idf)]
    cut = np.searchsorted(s, np.uint64(1) << np.uint64(32))
    x, y = ((p & np.uint64(0xFFFFFFFF)).astype("<u4") for p in (s[:cut], s[cut:]))
    (h, v), (g, w) = neardup.weigh(x, idf), neardup.weigh(y, idf)
    _, i, j = np.intersect1d(h, g, return_indices=True)
    shared = np.minimum(v[i], w[j]).sum()
    truth = shared / (v.sum() + w.sum() - shared)
    assert abs((draws[0][0] == draws[0][1]).mean() - truth) < 0.2


def brute(vectors, queries, k):
    out = set()
    for q, x in queries:
        best = sorted(((-float(np.dot(np.array(x), np.array(y))), v) for v, y in vectors if v != q))[:k]
        out |= {(q, i + 1, v) for i, (_, v) in enumerate(best)}
    return out


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=24).tolist()) for i in range(1500)] + [(5000 + i, [1.0] * 24) for i in range(3)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    queries = [x for x in vectors if x[0] % 20 == 0]
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in annsearch.search(df, F.col("vec_id") % 20 == 0, keep=200, query_block=30).collect()}
    want = brute(vectors, queries, 20)
    assert len(got) == len(want) and len({(a, c) for a, _, c in got} & {(a, c) for a, _, c in want}) / len(want) >= 0.9


def test_search_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [2.0, -1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in annsearch.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(1, 1, 2.0), (2, 1, 2.0), (3, 2, 2.0)]
    assert annsearch.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_search_repeated_queries(spark):
    """Rows alike are queries and candidates of their own."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 60)]
    twice = [(20, [3.0] * 8), (20, [3.0] * 8), (20, [1.0] * 8)]
    df = spark.createDataFrame([x for x in rows if x[0] % 20] + twice, "vec_id long, embedding array<double>")
    got = annsearch.search(df, F.col("vec_id") % 20 == 0, k=5).collect()
    assert len(got) == 15 and sorted(r["rank"] for r in got) == sorted([1, 2, 3, 4, 5] * 3)
    # of the two alike each has the other, then the third, among its own
    assert sorted(r["score"] for r in got if r["vec_id"] == 20) == [24.0, 24.0, 24.0, 24.0, 72.0, 72.0]


def test_leaks_of_repetitive_texts():
    """Items and texts that repeat a few characters: bounded work, and what full alignment finds."""
    r = random.Random(8)
    for unit, n in (("ab ", 60), ("a", 100), ("xyz xy ", 20)):
        item = decontam.normal(unit * n)
        index = decontam.Index([(1, item), (2, decontam.normal(prose(5, 30)))])
        for extra in (0, 1, 40):
            p = list(unit * (n + extra))
            for _ in range(r.randrange(0, 5)):
                p[r.randrange(len(p))] = "q"
            text = decontam.normal(f"{prose(3, 9)} {''.join(p)} {prose(4, 4)}")
            best = edit_distance_within(item, text)
            hits = [h for h in index.find([text])[0] if h[0] == 1]
            assert bool(hits) == (best <= index.edits[0]) and all(h[3] == best for h in hits)
    item = decontam.normal("ab " * 400)
    index = decontam.Index([(1, item)])
    assert [h[3] for h in index.find(["ab " * 30_000])[0]] == [0]
    assert [h[3] for h in index.find([("ab " * 399 + "qq ") * 60])[0]] == [2]


def test_components_of_any_shape(spark):
    """Chains, stars, rings and random graphs against a plain union."""
    r = random.Random(12)
    ids = list(range(400))
    r.shuffle(ids)
    links = [(ids[i], ids[i + 1]) for i in range(60)] + [(ids[100], ids[i]) for i in range(101, 140)] + [(ids[150 + i], ids[150 + (i + 1) % 30]) for i in range(30)]
    links += [(ids[200 + r.randrange(150)], ids[200 + r.randrange(150)]) for _ in range(110)]
    root = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(links, "a long, b long")
    assert {x["node"]: x["root"] for x in neardup.components(df).collect()} == root
    first, rest = df.limit(120), spark.createDataFrame(links[120:], "a long, b long")
    got = {x["node"]: x["root"] for x in neardup.merged(neardup.components(spark.createDataFrame(links[:120], "a long, b long")), rest).collect()}
    assert {k: v for k, v in got.items() if k in root} == root and neardup.components(first.limit(0)).collect() == []


def test_the_largest_class_does_not_meet_itself(spark):
    r = random.Random(12)
    words = prose(4, 60).split()

    def copy(k):
        own = list(words)
        for _ in range(k):
            own[r.randrange(len(own))] = "x%d" % r.randrange(10**6)
        return " ".join(own)

    rows = [(i, copy(1), "s") for i in range(300)] + [(900 + i, copy(3), "s") for i in range(6)]
    feats, idf = neardup.features(make(spark, rows).repartition(1))
    every = feats.select("rid", "doc_id", "shingles").collect()
    number = {x.doc_id: x.rid for x in every}
    buckets = feats.select(F.lit(1).alias("bucket"), "rid")
    roots = feats.filter("doc_id < 900").select(F.col("rid").alias("node"), F.lit(number[0]).alias("root"))
    pairs, spent = neardup.untried_pairs(buckets, roots, feats.select("rid", "shingles"), idf)
    outside = {number[900 + i] for i in range(6)}
    assert {x.rid for x in spent[-1].select("rid").distinct().collect()} <= outside  # what the keys are joined with
    got = {(x.a, x.b) for x in pairs.collect()}
    sets = {x.rid: x.shingles for x in every}
    for a in outside:
        for b in sets:
            if a != b and neardup.similarity(sets[a], sets[b], idf) >= neardup.SIMILAR:
                assert (min(a, b), max(a, b)) in got
    assert all(a in outside or b in outside for a, b in got)
