import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from dapple.llm import importance, negatives, triebpe
from tests.llm.conftest import make, prose

BPE = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_trie_gives_the_ids_of_the_library():
    from tokenizers import Tokenizer

    tok, r = Tokenizer.from_file(BPE), random.Random(5)
    texts = ["", "it's", "''s 'll'd", "x <|endoftext|> y", "<|endoftext|><|endoftext|>", "a\0b", "\0", "一二 三 ﬁ", " " * 900, "a" * 3000, "ab" * 700, "a b", "🙂 👍"]
    texts += ["".join(r.choice("ab's tr'elvLm d.,!1 2\n\t  é") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randint(1, 0xD7FF), r.randint(32, 127)])) for _ in range(20)) for _ in range(500)]
    enc = triebpe.TrieEncoder(BPE)
    assert enc.merges is not None
    for _ in range(2):  # with nothing known, then with all known
        assert [np.frombuffer(x, "<u4").tolist()[:-1] for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    known = triebpe.token_bytes(BPE)
    for _ in range(2000):
        ids = [r.randrange(len(known)) for _ in range(5)]
        assert b"".join(known[i] for i in ids).decode(errors="replace") == tok.decode(ids, skip_special_tokens=False)


def test_the_trie_works_out_a_shared_prefix_once():
    merges, asked = triebpe.TrieEncoder(BPE).merges, []
    inner = merges.may_follow
    merges.may_follow = lambda a, b: asked.append((a, b)) or inner(a, b)
    alone = merges.encode([b"internationalisation"])
    first = len(asked)
    both = merges.encode([b"internationalisation", b"internationalise", b"international"])
    assert both[0] == alone[0] and len(asked) - first < first / 2


def test_another_build_is_left_to_the_library():
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    enc, tok = triebpe.TrieEncoder(path), Tokenizer.from_file(path)
    texts = ["Some words", "", "it's 12"]
    assert enc.merges is None
    assert [np.frombuffer(x, "<u4").tolist()[:-1] for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    # merges whose parts come later have no fixed history
    assert not triebpe.Merges({"vocab": {**{c: i for i, c in enumerate(map(chr, range(33, 127)))}, "ab": 200, "abc": 201}, "merges": [["ab", "c"], ["a", "b"]]}).sound


def test_encode_and_decode_documents(spark, odd_rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    rows = [*odd_rows, (20, "a <|endoftext|> b\0", "x"), (21, "naïve ﬁ 三", "x")]
    got = triebpe.decode_ids(triebpe.encode_texts(make(spark, rows, extra=True))).collect()
    want = [(i, tok.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _ in rows]
    assert sorted(map(str, [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in got])) == sorted(map(str, want))
    assert triebpe.encode_texts(make(spark, rows).limit(0)).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert [tuple(r) for r in triebpe.decode_ids(nothing).collect()] == [(1, bytearray(), "")]


def resampled_by_hand(rows, target, low=1, high=1, buckets=10_000, least=20, percent=10):
    def features(text):
        raw = (text or "").encode()
        low_case = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
        words, word = [], b""
        for b in low_case + b" ":
            if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
                word += bytes([b])
            elif word:
                words.append(word)
                word = b""
        return len(words), [zlib.crc32(b" ".join(words[i : i + n])) % buckets for n in range(low, high + 1) for i in range(len(words) - n + 1)]

    docs = [(i, *features(t)) for i, t, _ in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (ss + buckets) / ((s[b] + 1.0) * (tt + buckets)))) for b in range(buckets)]
    out = []
    for i, words, f in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted([r for r in out if r[1] >= least], key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = place
    return sorted(map(str, out))


def test_resampling_by_hand(spark, odd_rows):
    rows = [*odd_rows, *[(100 + i, prose(i, 15 + i % 40), "s") for i in range(200)], (400, "Ünï A-B c1 " * 10, "s"), (401, None, "s")]
    rows += [(500 + i, prose(1, 30), "s") for i in range(40)]  # equal texts: only the noise tells them apart
    target = [prose(i, 60) for i in range(0, 30, 3)] + [None, "", "ünï"]
    docs = make(spark, rows, extra=True).repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string").selectExpr("*", "'x' AS doc_id")
    for options in ({}, {"low": 1, "high": 3, "buckets": 97}):
        got = importance.resample(docs, aim, **options).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
        assert sorted(str(list(r)) for r in got) == resampled_by_hand(rows, target, **options)
    assert importance.resample(docs.limit(0), aim).collect() == []
    assert importance.resample(docs, aim.limit(0)).count() == len(rows)


def mined_by_hand(rows, asked, positives, k):
    whole = [(n, i, lab, [math.floor(256 * x) for x in v]) for n, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for n, i, lab, v in whole:
        if not asked(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m, other) for m, j, other, w in whole if m != n)
        for s, j, _, _ in [x for x in scored if x[3] == lab][:positives]:
            hit = [(x, y) for x, y, _, other in scored if other != lab and 50 * -s <= 100 * -x <= 95 * -s][:k]
            out += [(i, j, rank, y, -s, -x) for rank, (x, y) in enumerate(hit, 1)]
    return sorted(out)


def test_hard_negatives_by_hand(spark):
    r = random.Random(8)
    rows = [(i, [r.randint(-8, 8) / 8 for _ in range(4)], r.randint(0, 3)) for i in range(300)]
    rows += [(300, [0.5, 0.5], 1), (301, [], 2), (302, [0.0] * 4, 1)]
    rows += [(303, None, 1), (304, [None, 1.0], 1), (305, [float("nan"), 1.0], 1), (306, [float("inf"), 1.0], 1), (None, [1.0] * 4, 1), (307, [1.0] * 4, None)]
    rows += [(310, [0.25] * 4, 0)] * 4 + [(320, [0.5] * 4, 3)] * 6
    schema = "vec_id long, embedding array<double>, label int"
    table = spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS n", "'x' AS v", "'x' AS score", "'x' AS anchor").repartition(3)
    want = mined_by_hand(rows, lambda i: i % 10 == 0, 5, 3)
    for size in (negatives.BLOCK_BYTES, 400):
        got = negatives.mine(table, F.col("vec_id") % 10 == 0, block_bytes=size).collect()
        assert sorted(map(tuple, got)) == want and want
    assert negatives.mine(table.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.mine(table, F.lit(False)).collect() == []


def test_hard_negatives_beyond_doubles_and_longs(spark):
    big = [(1, [2.0**40 + 1, 2.0**40], 0), (2, [2.0**40, 2.0**40 + 3], 0), (3, [2.0**39, 2.0**40], 1), (4, [2.0**40, 2.0**39 + 5], 1), (5, [2.0**200, 1.0], 2)]
    table = spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")
    want = [tuple(min(x, 2**63 - 1) for x in row) for row in mined_by_hand(big, lambda i: i < 3, 5, 3)]
    assert sorted(map(tuple, negatives.mine(table, F.col("vec_id") < 3).collect())) == want and want
