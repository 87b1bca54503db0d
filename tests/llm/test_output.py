import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dapple.llm import mixing, tokenbin
from tests.llm.conftest import make, prose


def test_pieces_are_those_of_the_library():
    from tokenizers import Tokenizer

    from dapple.llm.bytebpe import Encoder

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok, r = Tokenizer.from_file(path), random.Random(3)
    texts = ["", "it's", "''s 'll'd", "x <|endoftext|> y", "a\0b", "\0", "一二 три ﬁ", " " * 9 + "a", "b" * 500, "a\u00a0b", "\x0b c"]
    texts += ["".join(r.choice("ab's tr'elvLm d.,!1 2\n\t  é") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    enc = Encoder(path, 2)
    for _ in range(2):  # with nothing known, then with all known
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist()[-1] for x in Encoder(str(public_tokenizers.path("word_bpe_49k.json")), 7).encode(texts)] == [7] * len(texts)


def test_token_round_trip(spark, odd_rows, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    odd = ["a  b", "a   b", "\n x", " a", "a ", "a\n ", "x  y's 's", " ", "  ", "it's 'tis <|endoftext|> ok", "é ü, ﬁ  x", "a \nb", "x.,. y   z"]
    rows = [*odd_rows, *[(100 + i, t, "s") for i, t in enumerate(odd)], *[(200 + i, prose(i, 50), "s") for i in range(30)]]
    docs = make(spark, rows, extra=True)
    manifest = tokenbin.write_tokens(docs, f"file://{tmp_path}/t", str(public_tokenizers.path("byte_bpe_50k.json")), frame_tokens=500)
    got = sorted(tokenbin.read_documents(manifest).collect(), key=lambda r: r["start"])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for _, t, _ in order]
    start = np.cumsum([0, *map(len, ids)])
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(d, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _, _), s, x in zip(order, start, ids)]
    path = manifest.orderBy("part").first()["path"]
    reader = tokenbin.FrameReader(path)
    row = int(reader.rows_of(5)[0]) if len(reader.rows_of(5)) else 0
    assert reader.tokens(row).tolist()[-1] == 2 and len(reader.table) > 1
    local = path.removeprefix("file://")
    data = bytearray(open(local, "rb").read())
    data[20] ^= 0xFF
    open(local, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017  the frame or its checksum is found to be damaged
        tokenbin.FrameReader(path).frame(0)
    assert tokenbin.token_output(docs.limit(0)).collect() == []


def test_mix_targets(spark, odd_rows):
    rows = [*odd_rows, *[(100 + i, prose(i, 20 + i % 60), f"s{i % 4}") for i in range(800)]]
    docs = make(spark, rows, extra=True)
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(docs).collect()))
    size, target, taken, most = {}, {}, {}, {}
    for r in got:
        s = r["source"]
        size[s] = size.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        most[s] = max(most.get(s, 0), r["size"])
        assert r["taken"] <= 3 * r["size"] and (r["size"] or r["taken"] == 0)
    every = sum(size.values())
    # targets by water filling, one source after the other
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), [5, 2, 1] * 9))
    want, left, open_ = {}, float(every), set(size)
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 3 * size[s]}
        if not full:
            want |= {s: weights[s] * level for s in open_}
            break
        want |= {s: 3.0 * size[s] for s in full}
        left -= sum(3.0 * size[s] for s in full)
        open_ -= full
    for s in size:
        assert target[s] == pytest.approx(want[s])
        alone = sum(r["source"] == s and r["size"] > 0 for r in got) == 1  # then the nearer of all and nothing
        assert abs(taken[s] - target[s]) <= (most[s] / 2 if alone else max(0.002 * target[s], 25))
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix_documents(docs.limit(0)).collect() == []


def test_mix_inclusion_follows_size(spark):
    """Over many sources alike, documents of each size are taken as often as expected; without the odds they would not be."""
    rows = [(s * 10_000 + i, " ".join(f"w{s}x{i}" for _ in range(4 << (i % 4) * 2)), f"s{s}") for s in range(5) for i in range(2000)]
    docs = make(spark, rows)
    got = {}
    for r in mixing.mix_documents(docs, weights=(1,), share=0.3).collect():
        got.setdefault(r["size"], []).append(r["copies"])
    measure = {n: n**mixing.GAMMA for n in got}
    k = 0.3 * sum(n * len(x) for n, x in got.items()) / sum(n * len(x) * measure[n] for n, x in got.items())
    assert sorted(got) == [4, 16, 64, 256]
    for n, x in got.items():
        want = k * measure[n]
        assert 0 < want < 1 and abs(sum(x) / len(x) - want) < 0.03, (n, want, sum(x) / len(x))
    # the same words drawn with even odds would take all sizes alike
    assert sum(got[256]) > 3 * sum(got[4])


def test_mix_fills_what_long_documents_leave(spark):
    rows = [(0, "long " * 20_000, "a"), *[(i, prose(i, 20 + i % 7), "a") for i in range(1, 900)], (5000, "only " * 90, "b"), (5001, "x " * 4000, "c"), (5002, "y " * 4000, "c")]
    for seed in (1, 2, 3):
        got = mixing.mix_documents(make(spark, rows), seed=seed, weights=(1,), share=0.6).collect()
        for s in "ac":
            own = [r for r in got if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= (30 if s == "a" else 2000)


def test_mix_border_is_split_into_finer_buckets(spark, monkeypatch):
    rows = [(i, prose(i, 3 + i % 9), f"s{i % 2}") for i in range(3000)]
    docs = make(spark, rows)
    plain = {r["doc_id"]: r["copies"] for r in mixing.mix_documents(docs).collect()}
    monkeypatch.setattr(mixing, "BORDER_ROWS", 1)
    monkeypatch.setattr(mixing, "BUCKETS", 16)
    assert {r["doc_id"]: r["copies"] for r in mixing.mix_documents(docs).collect()} == plain


def test_pipeline_stages(spark, tmp_path):
    bad = " moron stupid clown "
    rows = [(i, prose(i, 60) + (bad if i % 6 == 0 else ""), f"s{i % 3}") for i in range(120)]
    item = prose(999, 40)
    rows += [(500, prose(1, 60), "s1"), (501, prose(1, 60) + " more", "s1"), (502, f"{prose(700, 30)} {item}", "s1"), (503, None, None)]
    make(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = [r["doc_id"] for r in docs.collect()]
    gone = {i for i in range(120) if i % 6 == 0}
    assert set(ids["toxicity"]) == {i for i, _, _ in rows} - gone
    assert set(ids["near-dedup"]) == set(ids["toxicity"]) - {500, 501}
    assert set(ids["decontamination"]) == set(ids["near-dedup"]) - {502}
    assert set(ids["mixing"]) <= set(ids["decontamination"]) and sorted(ids["token-ids"]) == sorted(ids["mixing"])
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "decontamination", "mixing", "token-ids"]


def test_targets_are_met_where_rows_repeat(spark):
    same = prose(1, 100)
    rows = [(None, same, "A")] * 1000 + [(i, prose(i, 50 + i % 90), "B") for i in range(400)] + [(9, same, "C")] * 60 + [(1000 + i, prose(i, 100), "C") for i in range(60)]
    docs = make(spark, rows, extra=True).repartition(5)
    got = mixing.mix_documents(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.max(F.col("taken") / F.col("size")).alias("share")).collect()
    for r in got:
        assert abs(r.taken - r.target) <= max(0.002 * r.target, r.most) and r.share <= 3
    counts = lambda n: sorted(map(str, mixing.mix_documents(docs.repartition(n)).groupBy("source", "doc_id", "copies").count().collect()))
    assert counts(2) == counts(7)
    mixed = {r.source: r.words for r in mixing.mix_rows(docs).groupBy("source").agg(F.sum(mixing.word_count()).alias("words")).collect()}
    assert mixed == {r.source: r.taken for r in got}
