import collections
import math
import re
import zlib

import numpy as np

from dapple.llm import suffixtree, toxicity
from tests.llm.conftest import make, prose


def held(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n == 2


def test_base_score_and_better_model(spark, odd_rows):
    rows = [*odd_rows, *[(100 + i, f"{prose(i % 40, 60)} The terms of use apply here {prose(i, 5)}", "s") for i in range(150)]]
    got = suffixtree.score_documents(make(spark, rows, extra=True)).collect()
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]) for i, t, _ in rows]
    c = collections.Counter(w for i, ws in tokens if not held(i, 7) for w in ws)
    n, v = sum(c.values()), len(c)
    key = lambda i, k, m, b: (str(i), k, m, round(b, 6))
    want = sorted(key(i, len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens)
    assert sorted(key(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got) == want
    assert all(r["held_out"] == held(r["doc_id"], 7) and r["train_tokens"] == n and r["score"] < 0 for r in got)
    new = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new)


def test_tree_distribution_sums_to_one():
    tree = suffixtree.Tree(np.array([5, 9], np.uint64), np.log10([0.25, 0.25, 0.3, 0.2]), np.array([True, True, True, True]))
    tree.states = [np.log10(np.array([np.nan, np.nan, 0.4, np.nan]))]
    p = np.array([0.5, 0.1 + 0.0])
    below = 0.4 * np.array([0.25, 0.25, 0.3, 0.2])
    seen = (1 - 0.4) * np.array([0.5, 0.5]) + below[[0, 3]]
    tree.seen = [(np.array([(2 << suffixtree.BITS) | 0, (2 << suffixtree.BITS) | 3]), np.log10(seen))]
    total = sum(10 ** tree.log_p(np.array([2, x]))[1] for x in range(4))
    assert abs(total - 1) < 1e-9 and len(p) == 2


def tree_scores(train, texts, depth, bounds, gain):
    """The suffix tree by plain dictionaries: log10 probability of each text's symbols, and of rare words' shares."""
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", t), None] for t in train]
    c = collections.Counter(w for ws in words for w in ws)
    total = sum(c.values())
    least_symbol, least, least_pair = bounds.of(total)
    symbol = lambda w: w if w is None or c[w] >= least_symbol else "<rare>"
    root = collections.Counter(symbol(w) for ws in words for w in ws)
    for x in (None, "<rare>"):
        root[x] += 1
    every = sum(root.values())
    p = {(): {x: n / every for x, n in root.items()}}
    seen = collections.defaultdict(collections.Counter)
    for ws in words:
        s = [None, *map(symbol, ws)]  # a context of one symbol may be the start, a longer one ends before it
        for i in range(1, len(s)):
            for k in range(1, depth + 1):
                if i - k < 0 or (k > 1 and None in s[i - k : i]):
                    break
                seen[tuple(s[i - k : i])][s[i]] += 1
    contexts = {x for x, n in seen.items() if (root[x[0]] >= least if len(x) == 1 else sum(n.values()) >= least)}
    contexts = {x for x in contexts if sum(seen[x].values()) >= least and all(x[j:] in contexts for j in range(1, len(x)))}
    own, weight, gains = {}, {}, {}
    for x in sorted(contexts, key=len):
        n, t, k = seen[x], sum(seen[x].values()), len(seen[x])
        low = p[x[1:]]
        weight[x] = (t + k - sum(v for v in n.values() if v >= least_pair)) / (t + k)
        own[x] = {y for y, v in n.items() if v >= least_pair}
        p[x] = {y: (n[y] / (t + k) if y in own[x] else 0) + weight[x] * low[y] for y in low}
        gains[x] = sum(v * math.log((v - 1 + k * low[y]) / (t - 1 + k) / low[y]) for y, v in n.items())
        assert abs(sum(p[x].values()) - 1) < 1e-9
    states = {x for x in contexts if gains[x] >= gain}
    states |= {x[j:] for x in states for j in range(1, len(x))}
    rare = {w: n for w, n in c.items() if w is not None and n < least_symbol}
    out = []
    for t in texts:
        s, z, ws = [None], 0.0, [*re.findall(r"[^\x20\x09-\x0D]+", t), None]
        for w in ws:
            x = symbol(w)
            k = next(k for k in range(min(depth, len(s)), -1, -1) if not k or (tuple(s[-k:]) in states and not (k > 1 and None in s[-k:])))
            z += math.log10(p[tuple(s[-k:]) if k else ()][x])
            if x == "<rare>":
                z += math.log10((rare[w] - suffixtree.DISCOUNT if w in rare else suffixtree.DISCOUNT * len(rare)) / sum(rare.values()))
            s.append(x)
        out.append(z)
    return out, states


def test_scores_equal_brute_force_tree(spark):
    import random

    r = random.Random(11)
    phrases = ["the terms of use apply here", "terms of use are long", "we use the long road home", "a road of terms"]
    texts = [" ".join(r.choice(phrases) if r.random() < 0.7 else f"odd{r.randrange(40)} a the" for _ in range(r.randrange(1, 9))) for _ in range(160)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    bounds = suffixtree.Least(100.0, 400.0, 60.0)
    train = [t for i, t, _ in rows if not held(i, 7)]
    got = {x["doc_id"]: x["score"] for x in suffixtree.score_documents(make(spark, rows), 5, bounds, 2.0).collect()}
    want, states = tree_scores(train, texts, 5, bounds, 2.0)
    assert {len(x) for x in states} >= {1, 2, 3, 4}
    assert max(abs(got[i] - z) for i, z in enumerate(want)) < 1e-6


def test_lm_without_training_texts(spark):
    only = next(i for i in range(1000) if held(i, 7))
    got = suffixtree.score_documents(make(spark, [(only, "a b", "s")])).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(3, 0, 0, 0.0)]
    assert suffixtree.score_documents(make(spark, [])).collect() == []


def test_toxicity_held_out(spark, odd_rows):
    bad = ("vile", "grubby", "rotter")
    rows = [*odd_rows, *[(i, f"{prose(i, 30)} {bad[i % 3]} {prose(i + 1, 9)} {bad[i % 2]}" if i % 5 == 0 else prose(i, 40), "s") for i in range(100, 700)]]
    docs = make(spark, rows, extra=True)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(100, 700)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r["_score"] <= 1 for r in got)
    tested = [(r["_predicted"], int(r["doc_id"] % 5 == 0)) for r in got if r["doc_id"] and r["doc_id"] >= 100 and held(r["doc_id"], 4)]
    assert len(tested) > 80 and sum(a == b for a, b in tested) / len(tested) > 0.97
    assert sorted(toxicity.drop_toxic(docs, labels).columns) == sorted(docs.columns)


def test_toxicity_without_labels(spark):
    docs = make(spark, [(1, "what a moron, a stupid clown", "s"), (2, "a fine day", "s"), (3, None, "s")])
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["doc_id"]: r["_predicted"] for r in toxicity.score_documents(docs, model, ["doc_id"]).collect()} == {1: 1, 2: 0, 3: 0}


def planted_votes(n=60_000, seed=5):
    """Votes of eight voters with known rates; voter 5 repeats voter 4 for seven tenths of the documents."""
    r = np.random.default_rng(seed)
    y = r.random(n) < 0.08
    fires1, fires0 = np.array([0.8, 0.6, 0.7, 0.5, 0.6, 0.6, 0.4, 0.75]), np.array([0.02, 0.05, 0.01, 0.1, 0.04, 0.04, 0.02, 0.03])
    v = r.random((n, 8)) < np.where(y[:, None], fires1, fires0)
    same = r.random(n) < 0.7
    v[same, 5] = v[same, 4]
    return y, v, fires1, fires0


def test_label_model_finds_rates_and_dependences():
    y, v, fires1, fires0 = planted_votes()
    masks, n = np.unique(v @ (1 << np.arange(8)), return_counts=True)
    model = toxicity.label_model(toxicity.fires_of(masks, 8), n, 0.05)
    assert abs(model.prior - y.mean()) < 0.01
    assert np.abs(model.rates[1] - v[y].mean(0)).max() < 0.03 and np.abs(model.rates[0] - v[~y].mean(0)).max() < 0.01
    assert np.abs(model.rates[1] - fires1).max() < 0.05 and np.abs(model.rates[0] - fires0).max() < 0.02
    pairs = {frozenset((i, int(p))): model.depends[i] for i, p in enumerate(model.parent) if p >= 0}
    assert abs(pairs.pop(frozenset((4, 5))) - 0.7) < 0.05 and all(abs(x) < 0.1 for x in pairs.values())
    # brute force over the planted distribution: the posterior of each pattern
    odds = model.log_odds(toxicity.fires_of(masks, 8))
    at = np.searchsorted(masks, v @ (1 << np.arange(8)))
    share, many = np.bincount(at, y, len(masks)) / n, n > 300
    assert np.abs(1 / (1 + np.exp(-odds[many])) - share[many]).max() < 0.08
    # a voter that only repeats another adds nothing
    twice = np.concatenate([v, v[:, 4:5]], 1)
    masks2, n2 = np.unique(twice @ (1 << np.arange(9)), return_counts=True)
    odds2 = toxicity.label_model(toxicity.fires_of(masks2, 9), n2, 0.05).log_odds(toxicity.fires_of(masks2, 9))
    assert np.abs(odds2[np.argsort(masks2 & 255)] - odds[np.searchsorted(masks, np.sort(masks2 & 255))]).mean() < 0.15


def test_calibration_follows_labels():
    r = np.random.default_rng(2)
    z = r.normal(-2, 2, 5000)
    toxic = r.random(5000) < 1 / (1 + np.exp(-(0.5 * z + 1)))
    slope, shift = toxicity.calibration(z, toxic, np.ones(5000))
    assert abs(slope - 0.5) < 0.1 and abs(shift - 1) < 0.2
