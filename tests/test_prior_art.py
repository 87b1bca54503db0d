import difflib
import random
import re

from dapple.operators.priorart import prior_art_matrix


def folded(x, groups):
    x = re.sub(r"\s+|[，。；、,;:：()（）\[\]【】]", "", (x or "").lower())
    for canonical, terms in groups:
        for t in sorted(terms, key=len, reverse=True):
            x = x.replace(t.lower(), f"<{canonical}>")
    return x


def grams(x):
    return {x[i : i + 3] for i in range(len(x) - 2)} if len(x) > 3 else {x} if x else set()


def matrix_by_hand(features, passages, mappings, groups):
    out = {}
    for f, text, terms in features:
        for d in {p[0] for p in passages}:
            rows = []
            for doc, locator, x in passages:
                if doc != d:
                    continue
                matched = sorted({t.lower() for t in terms or [] if t.lower() in (x or "").lower()} - {""})
                a, b = folded(text, groups), folded(x, groups)
                score = round(0.45 * difflib.SequenceMatcher(None, a, b).ratio() + 0.55 * len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 4) if a and b else 0.0
                if matched or score >= 0.42:
                    rows.append((-len(matched), -score, locator, matched))
            rows.sort()
            own = mappings.get((f, d))
            if own:
                status = "MAPPING_INCOMPLETE" if own[0] == "disclosed" and not (own[1] and own[2]) else own[0]
            elif rows:
                status = "LEXICAL_REVIEW_REQUIRED" if any(r[3] for r in rows[:5]) else "SEMANTIC_REVIEW_REQUIRED"
            else:
                continue
            out[f, d] = (status, [(loc, m, -s) for _, s, loc, m in rows[:5]])
    return out


def test_matrix_equals_brute_force(spark):
    r = random.Random(3)
    words = "gear shaft rotor stator housing bearing seal valve spring washer (coil) magnet".split()
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n))
    features = [(f"f{i}", sentence(r.randint(3, 9)), r.sample(["rotor sta", "SEAL", "valve spring washer", "none"], r.randint(0, 2))) for i in range(12)] + [("e", "", None), ("n", None, ["coil"]), ("t", "abc", [])]
    passages = []
    for d in range(8):
        for k in range(7):
            base = r.choice(features)[1] or "abc"
            cut_ = r.randrange(1 + len(base))
            passages.append((d, k, r.choice([base[cut_:] + " " + sentence(2), sentence(7), base.replace("gear", "cog"), base.upper()])))
    passages += [(9, 0, None), (9, 1, ""), (9, 2, "abc"), (9, 3, "abcd")]
    groups = [("wheel", ["gear", "cog"])]
    mappings = {("f0", 0): ("disclosed", 1, 1), ("f1", 0): ("disclosed", 0, 2), ("f2", 9): ("not_disclosed", 0, 0)}
    got = prior_art_matrix(
        spark.createDataFrame(features, "feature string, text string, terms array<string>"),
        spark.createDataFrame(passages, "document long, locator int, text string"),
        spark.createDataFrame([(f, d, *m) for (f, d), m in mappings.items()], "feature string, document long, status string, evidence int, locators int"),
        groups,
    ).collect()
    want = matrix_by_hand(features, passages, mappings, groups)
    have = {(x.feature, x.document): (x.status, [(c.locator, list(c.terms), c.score) for c in x.candidates]) for x in got}
    assert have.keys() == want.keys()
    for key, (status, rows) in want.items():
        assert have[key][0] == status and [c[:2] for c in have[key][1]] == [c[:2] for c in rows], key
        assert all(abs(a[2] - b[2]) < 2e-4 for a, b in zip(have[key][1], rows))
    assert {s for s, _ in want.values()} >= {"LEXICAL_REVIEW_REQUIRED", "SEMANTIC_REVIEW_REQUIRED", "MAPPING_INCOMPLETE"}
