import hashlib
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from dapple.llm import licenses, pii, rollups
from tests.llm.conftest import make, prose


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
)
TEXTS = [
    "a@b.c_d@e.f x.y@z", "mail é𝄞 joe.doe+x@mail-1.example.com, and a@@b.com", "1.2.3.4.5.6.7.8 300.1.2.3 001.02.3.255 1.2.3.4567", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (988) 555-2485 4041894974608795 +12", "9" * 3000, "a." * 3000, "+" * 500 + "1 2", "4111111111111111 4111 1111 1111 1111 9", "x" * 20_000 + "@", "1 " * 3000, "+1 2 3 4 5 6 7 8 9\n+4 ((((",
]


def base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in PATTERNS for m in re.finditer(p, text or "") if ok(m.group()))


def test_base_spans_equal_brute_force(spark, odd_rows):
    rows = [*odd_rows, *[(100 + i, t, "s") for i, t in enumerate(TEXTS)]]
    got = pii.digest(pii.find_pii(make(spark, rows, extra=True))).collect()
    want = sorted((str(i), hashlib.sha256(base(t).encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == want
    assert all(set(filter(None, base(t).split(","))) <= set(r["spans"].split(",")) for i, t, _ in rows for r in got if r["doc_id"] == i and i != 5)


def test_contexts_discover_unseen_numbers(spark):
    rows = [(i, f"{prose(i, 8)} call desk +1 (988) 555-{2000 + i} {prose(i + 50, 8)}", "s") for i in range(12)]
    rows += [(50, f"{prose(90, 8)} call desk 988 555 7777 {prose(91, 8)}", "s"), (51, f"{prose(92, 8)} page 988 555 7777 99", "s"), (52, prose(93, 30), "s")]
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(make(spark, rows))).collect()}
    assert got[50]["n_learned"] == 1 and got[50]["spans"].startswith("phone:")
    assert got[52]["spans"] == "" and got[0]["n_phone"] == 1


def graph_scores(texts, rounds=6, support=3, least=0.5, accept=0.75):
    """The pattern-candidate graph scored by hand: (row, kind, start, end) of what is learned."""
    spot = re.compile(r"(?<![^\x20\x09-\x0D@])[^\x20\x09-\x0D@]+@[^\x20\x09-\x0D@]+|(?<![0-9])[+(]{0,2}[0-9](?:[\x20().:-]{0,2}[0-9]){6,}")
    words, occurs = re.compile(r"[^\W\d_]+"), []
    for row, t in enumerate(texts):
        spans = [(k, m.start(), m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in re.finditer(p, t) if ok(m.group())]
        cuts = [m.span() for m in spot.finditer(t)]
        for i, (a, b) in enumerate(cuts):
            left = words.findall(t[cuts[i - 1][1] if i else 0 : a][-64:].lower())
            right = words.findall(t[b : cuts[i + 1][0] if i + 1 < len(cuts) else len(t)][:64].lower())
            pats = [f"{left[-2]} {left[-1]} _"] if len(left) > 1 else []
            pats += [f"{left[-1]} _"] if left else []
            pats += [f"{left[-1]} _ {right[0]}"] if left and right else []
            if pats:
                occurs.append((row, t[a:b], a, b, pats, {k for k, x, y in spans if x < b and a < y}))
    edges = {(s, p) for _, s, _, _, ps, _ in occurs for p in ps}
    seeds = {(s, k): 1.0 for _, s, _, _, _, ks in occurs for k in ks}

    def fits(k, s):
        n = len(re.sub("[^0-9]", "", s))
        return "@" in s if k == 0 else bool(re.match(r"[0-9]+(?:[.:-][0-9]+){3,7}$", s)) if k == 1 else "@" not in s and (12 <= n <= 19 if k == 2 else 7 <= n <= 15)

    scores = dict(seeds)
    for _ in range(rounds):
        mass, size = {}, {}
        for s, p in edges:
            size[p] = size.get(p, 0) + 1
            for k in range(4):
                if (s, k) in scores:
                    m, n = mass.get((p, k), (0.0, 0))
                    mass[p, k] = (m + scores[s, k], n + 1)
        conf = {(p, k): m / (size[p] + 1) for (p, k), (m, n) in mass.items() if n >= support and m / (size[p] + 1) >= least}
        miss = {}
        for s, p in edges:
            for k in range(4):
                if (p, k) in conf and fits(k, s):
                    miss[s, k] = miss.get((s, k), 1.0) * (1 - min(conf[p, k], 0.999))
        found = {x: 1 - m for x, m in miss.items()}
        scores = {x: max(found.get(x, 0), seeds.get(x, 0)) for x in found.keys() | seeds.keys()}
    best = {}
    for (s, k), v in found.items():
        if v >= accept and (s not in best or (v, -k) > best[s]):
            best[s] = (v, -k)
    return {(row, -best[s][1], a, b) for row, s, a, b, _, ks in occurs if not ks and s in best}


def test_learned_spans_equal_brute_force(spark):
    import random

    r = random.Random(6)
    texts = []
    for i in range(120):
        lead, seed, other = r.choice([("call desk", f"+1 (988) 555-{2000 + i}", f"988 555 {7000 + i}"), ("server at", f"10.1.2.{i}", f"10.1.{i}.300"), ("write to", f"u{i}@host.example", f"u{i}@host"), ("item no", f"{r.randrange(10**9)}", f"+{10**9 + i}")])
        texts.append(f"{prose(i, 4)} {lead} {seed if r.random() < 0.8 else other} {r.choice(['today', 'now', prose(i, 1)])} {prose(i + 500, 3)} 4111 1111 1111 1111")
    want = graph_scores(texts)
    got = {(x["doc_id"], s["kind"], s["start"], s["end"]) for x in pii.find_pii(make(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect() for s in x["learned"]}
    assert got == want and len(want) > 5


def test_many_matches_in_a_text(spark):
    many = " ".join(f"write to u{i}@host.example and 10.0.0.{i % 256}" for i in range(6000))
    docs = make(spark, [(1, many, "s"), (1, "write to a@b.cd", "s"), (None, "x 10.1.1.1", "s")])
    got = pii.digest(pii.find_pii(docs)).collect()
    assert sorted((r["n_email"], r["n_ip"]) for r in got) == [(0, 1), (1, 0), (6000, 6000)]
    assert {r["base_sha256"] for r in got} == {hashlib.sha256(base(t).encode()).hexdigest() for t in (many, "write to a@b.cd", "x 10.1.1.1")}
    values = pii.extract_pii(docs)  # each span is cut from its own row
    assert values.count() == 12_002 and values.filter("kind = 'email' AND NOT contains(value, '@')").isEmpty() and values.filter("doc_id IS NULL").first()["value"] == "10.1.1.1"


def test_empty_tables(spark):
    none = make(spark, [])
    assert pii.digest(pii.find_pii(none)).collect() == []
    assert licenses.scan_licences(none).collect() == []
    assert rollups.counted(none).collect() == []


def test_licences(spark, odd_rows):
    mit = "Released under the MIT License."
    rows = [*odd_rows, (20, mit, "a"), (21, "RELEASED under the MIT licence", "a"), (22, f"Copyright (c) 2020 Me\n{mit}", "a"), (23, f"{prose(1, 20)}\n{mit}\nLicensed under CC BY-NC 4.0.", "a"), (24, f"{prose(1, 20)} {mit}", "a")]
    got = {r["doc_id"]: r for r in licenses.scan_licences(make(spark, rows, extra=True)).collect()}
    assert [got[i]["whole"] for i in (20, 21, 22, 23, 24)] == ["MIT", "MIT", "MIT", None, None]
    assert got[23]["licences"] == ["CC-BY-NC-4.0", "MIT"] and got[24]["licences"] == [] and got[1]["n_units"] == 0
    own = spark.createDataFrame([("Own", "my very own terms")], "licence string, text string")
    assert {r["doc_id"]: r["whole"] for r in licenses.scan_licences(make(spark, [(1, "My very, own TERMS!", "a")]), own).collect()} == {1: "Own"}


def test_whole_licences(spark):
    """Files of whole licences, wrapped anew, in other case, spelling and punctuation, with a copyright line of their own."""
    rows, want = [], {}
    for i, (name, text) in enumerate(licenses.LICENCES[len(licenses.STATEMENTS) :]):
        own = f"Copyright (C) {2000 + i} Somebody Else\n\n{text}"
        rows += [(3 * i, own.replace("\r", ""), "s"), (3 * i + 2, text + " x", "s")]
        want |= {3 * i: name, 3 * i + 2: None}
        if name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "Unlicense", "CC0-1.0"):  # no copyright line within
            rows.append((3 * i + 1, "\n".join(textwrap.wrap(re.sub(r"\bLICENSE\b", "LICENCE", text.upper()).replace("SUBLICENSE", "SUBLICENCE"), 50)).replace(",", " ; "), "s"))
            want[3 * i + 1] = name
    got = {r["doc_id"]: r["whole"] for r in licenses.scan_licences(make(spark, rows)).collect()}
    assert got == want and {"MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "MPL-2.0", "ISC", "Zlib", "Unlicense", "CC0-1.0"} <= set(want.values())


def test_canonical_form_is_stable(spark):
    texts = ["licence licence LICENCE, non-commercial non\ncommercial", "sub licence\nsub-licence", "x (c) y\n© 2020 z\nCopyright notice stays", "a\n---\nb", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("c", licenses.canonical(F.col("t"))).withColumn("d", licenses.canonical(F.col("c")))
    got = df.collect()
    assert [r["c"] for r in got] == [r["d"] for r in got] == ["license license license noncommercial noncommercial", "sublicense sublicense", "x c y copyright notice stays", "a b", ""]


def test_rollups_are_idempotent(spark, tmp_path):
    schema = "kind string, source string, lang string, tokenizer string, n_tokens long, old_tokens long, extra int"
    e = spark.createDataFrame([("insert", "a", "en", "t", 5, None, 1), ("insert", "a", "en", "t", 7, None, 1), ("insert", None, None, "t", None, None, 1)], schema)
    more = spark.createDataFrame([("revise", "a", "en", "t", 6, 5, 1), ("delete", None, None, "t", 0, None, 1)], schema)
    roll = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert roll.totals().collect() == []
    assert roll.commit("1", e) and roll.commit("2", more) and not roll.commit("2", more) and not roll.commit("1", e)
    assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "t", 2, 13)]
    roll.commit("3", e.limit(0))
    assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "t", 2, 13)]
    with pytest.raises(ValueError):
        roll.commit("../x", e)
    with pytest.raises(Exception, match="unknown kind"):
        rollups.signed(e.withColumn("kind", F.lit("odd"))).collect()


def test_corpus_batches(spark, odd_rows, tmp_path):
    roll = rollups.Rollup(spark, f"file://{tmp_path}/r")
    for name, events in rollups.corpus_events(make(spark, [*odd_rows, (30, "x y\nx y\nz", "c")], extra=True)).items():
        roll.commit(name, events)
    got = {(r["source"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in roll.totals().collect()}
    assert got["c", "words-1"] == (1, 3)  # the repeated line went
    assert got["b", "words-1"] == (2, 42)  # so did the copy


def test_columns_of_any_name_are_no_row_numbers(spark):
    texts = [f"write to the billing contact {i}55-01{i:02d}-77{i:02d} or +1 202 555 01{i:02d} now" for i in range(10, 40)]
    plain = make(spark, [(i, t, "s") for i, t in enumerate(texts)]).select("doc_id", "text")
    want = sorted(map(str, pii.digest(pii.find_pii(plain)).collect()))
    for name in ("rid", "s", "kind", "start", "tile", "score"):
        assert sorted(map(str, pii.digest(pii.find_pii(plain.selectExpr("*", f"1 AS {name}"))).collect())) == want
