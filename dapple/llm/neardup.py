"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five words in lower case. A shingle weighs its count in the document times an inverse
document frequency that is 1 for shingles in fewer than one of fifty documents and falls to 1/2 for
those in all. Document frequencies over all documents come from a sketch of ``SLOTS`` counters; what
a counter holds beyond the mean is the estimate, and as the mean grows with the number of documents
the estimate's error stays the same share of them at any size.

Each of ``BANDS * ROWS`` samples draws one shingle (and weight step) of a document so that two
documents draw alike with the probability of their weighted Jaccard similarity. Equal bands make
candidates, verified on the whole shingle sets: a link is a weighted Jaccard similarity of 0.8 or more.

Exact copies are one class from the start. Buckets are then worked off in rounds: per bucket each
class is one member, the best-linked one; buckets of up to ``FEW`` classes compare all pairs, larger
ones compare every class with the centre of the largest, and their texts within random shares of about
``SHARE``, drawn anew each round. Links join classes, and rounds go on as long as they bring links for
one of fifty open classes, so a group of n copies costs about n comparisons a round. What the rounds leave is then
compared whole: every two texts of different classes that share a bucket meet, the largest class of a bucket and
shingle with the others but not with itself, unless a bound shows
that they cannot be links. Texts are ordered rarest shingle first; two that are linked share a shingle
within the first part of both, beyond which less than 0.8 of the heavier or 0.89 of the lighter is left
(prefix filter), and what is left from there on bounds what they share. So after it no untried pair of a bucket can be a link.

Defined cases: null and empty texts, and texts without words, stay alone; texts of one to four words
are one shingle; repeated rows are exact copies; a null doc_id is a row like any other, and a class
of null ids alone has a null class_id; an empty table gives an empty result; other columns are only
carried by ``drop_near_duplicates``. Its rows get their numbers once, in a table that is written before
anything else is read from it, so it holds however the documents come and whatever executors are lost.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.llm.common import batch_rows, discard, small_side, stash, table, text_of

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
#: What two linked texts share of the lighter one at least.
FIRST = 2 * SIMILAR / (1 + SIMILAR) - 1e-9
SLOTS = 1 << 18
FREE_SHARE = 1 / 50
FEW = 6
SHARE = 6
BLOCK_BYTES = 1 << 20
#: Row ids that may be broadcast: at most 16 MB.
BROADCAST_IDS = 2_000_000

_M = 0x9E3779B97F4A7C15
_M_INVERSE = pow(_M, -1, 1 << 64)
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


@lru_cache(maxsize=2)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2^64."""
    n = 1 << bits
    out = []
    for m in (_M, _M_INVERSE):
        p = np.full(n, m, _U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=_U))
    return out[0], out[1]


@lru_cache(maxsize=1)
def draws() -> tuple[np.ndarray, ...]:
    """Tables for the samples: log c, and pairs r, beta with r (1 - beta); the scaled forms, shifted."""
    rng = np.random.default_rng(7)
    n = 1 << 16
    log_c = np.log(rng.gamma(2.0, 1.0, n))
    r, beta = rng.gamma(2.0, 1.0, n), rng.random(n)
    scale, lift = float(1 << 25), 1 << 31
    c_int = (np.round(log_c * scale).astype(np.int64) + lift) << 32
    p_int = np.round(np.minimum(r * (1 - beta), 40.0) * scale).astype(np.int64) << 32
    return c_int, p_int, log_c, r, beta


def multipliers() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of a byte string."""
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(max(20, int(len(raw)).bit_length()))
    run = np.concatenate([np.zeros(1, _U), np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)], dtype=_U)])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(_U)), start, end


def shingles(texts: list[bytes]) -> np.ndarray:
    """Sorted (place of the text << 32 | shingle hash) of all texts, with repeats."""
    raw = np.frombuffer(b" ".join(t.lower() for t in texts), np.uint8)
    if not len(raw):
        return np.empty(0, _U)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    h, start, _ = word_hashes(raw)
    doc = np.searchsorted(begins, start, side="right") - 1

    parts = []
    n = len(h) - WORDS + 1
    if n > 0:
        s = sum(h[j : j + n] * _U((_M * (2 * j + 1)) % (1 << 64) | 1) for j in range(WORDS))
        whole = doc[:n] == doc[WORDS - 1 :]
        parts.append((doc[:n][whole], mix(s[whole]) >> _U(32)))
    # texts of fewer words are one shingle
    size = np.bincount(doc, minlength=len(texts))
    for d in np.flatnonzero((size > 0) & (size < WORDS)).tolist():
        a = int(np.searchsorted(doc, d))
        s = sum(h[a + j : a + j + 1] * _U((_M * (2 * j + 3)) % (1 << 64) | 1) for j in range(int(size[d])))
        parts.append((np.array([d]), mix(s) >> _U(32)))
    if not parts:
        return np.empty(0, _U)
    return np.sort(np.concatenate([(d.astype(_U) << _U(32)) | s for d, s in parts]))


def in_blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield held


def slot_of(h: np.ndarray) -> np.ndarray:
    return ((h.astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(14)).astype(np.int64)


def document_weights(rows: DataFrame) -> np.ndarray:
    """Inverse document frequency of each slot of the sketch, from all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            for block in in_blocks([t.encode() for t in b.column(2).to_pylist()]):
                n += len(block)
                seen += np.bincount(slot_of(np.unique(shingles(block)) & _U(0xFFFFFFFF)), minlength=SLOTS)
        at = np.flatnonzero(seen)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_pydict({"slot": pa.array(at[i : i + (1 << 16)], pa.int32()), "n": pa.array(seen[at[i : i + (1 << 16)]], pa.int64())})
        if n:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([-1], pa.int32()), "n": pa.array([n], pa.int64())})

    sums = rows.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n = max(1, int(sums.loc[sums["slot"] < 0, "n"].sum()))
    seen = np.zeros(SLOTS)
    own = sums[sums["slot"] >= 0]
    seen[own["slot"].to_numpy()] = own["n"].to_numpy()
    share = np.clip(seen - seen.mean(), 1e-9, n) / n
    return np.where(share < FREE_SHARE, 1.0, 0.5 + 0.5 * np.log(share) / np.log(FREE_SHARE)).clip(0.5, 1.0)


def weigh(feats: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a document and their weights."""
    h, n = np.unique(feats, return_counts=True)
    return h, n * idf[slot_of(h)]


def sample(block: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """The samples of n texts from their sorted shingles: n x (BANDS * ROWS) of 32 bits; texts without shingles are 0."""
    out = np.zeros((n, BANDS * ROWS), np.uint32)
    if not len(block):
        return out
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    tf = np.diff(np.append(first, len(block)))
    one = block[first]
    doc, h = (one >> _U(32)).astype(np.int64), (one & _U(0xFFFFFFFF)).astype(np.uint32)
    weight = tf * idf[slot_of(h)]
    begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    other = np.flatnonzero(weight != 1.0)
    log_w = np.log(weight[other])
    c_int, p_int, log_c, r, beta = draws()
    ident = h.astype(np.int64)
    for k, m in enumerate(multipliers()):
        g = h * m
        g ^= g >> np.uint32(16)
        g *= np.uint32(0x7FEB352D)
        g ^= g >> np.uint32(15)
        low = g & np.uint32(0xFFFF)
        key = c_int[g >> np.uint32(16)]
        key -= p_int[low]
        key += ident
        if len(other):
            j = low[other]
            t = np.floor(log_w / r[j] + beta[j])
            log_a = log_c[g[other] >> np.uint32(16)] - np.clip(r[j] * (t - beta[j] + 1), -40.0, 40.0)
            tag = h[other] ^ (t.astype(np.int64).astype(np.uint32) * np.uint32(0x9E3779B1))
            key[other] = ((np.round(log_a * (1 << 25)).astype(np.int64) + (1 << 31)) << 32) + tag
        out[doc[begins], k] = np.minimum.reduceat(key, begins) & 0xFFFFFFFF
    return out


FEATURES = "rid long, doc_id long, copy binary, bands array<long>, shingles binary"


def features(docs: DataFrame, rid: Column | None = None) -> tuple[DataFrame, np.ndarray]:
    """A row for each document: what exact copies share, bands, sorted shingle hashes. Written out.

    ``rid`` numbers the rows; without it they are numbered as they are written.
    """
    rows = docs.select((F.monotonically_increasing_id() if rid is None else rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    batch_rows(docs.sparkSession)
    idf = document_weights(rows)
    held = docs.sparkSession.sparkContext.broadcast(idf)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rids, ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), [t.encode() for t in b.column(2).to_pylist()]
            at = 0
            for block in in_blocks(texts):
                s = shingles(block)
                got = sample(s, len(block), held.value)
                keys = mix((got.reshape(len(block), BANDS, ROWS).astype(_U) * np.array([(_M * (2 * j + 1)) % (1 << 64) for j in range(ROWS)], _U)).sum(2) + np.arange(BANDS, dtype=_U) * _U(_M_INVERSE))
                cut = np.searchsorted(s, np.arange(len(block) + 1, dtype=_U) << _U(32))
                low = (s & _U(0xFFFFFFFF)).astype("<u4")
                own = [low[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                rid = rids[at : at + len(block)]
                # texts without words are no copies of each other
                copy = [xxhash.xxh3_128_digest(t) if o else struct.pack("<q", i) for t, o, i in zip(block, own, rid, strict=True)]
                bands = [k if o else [] for k, o in zip(keys.astype(np.int64).tolist(), own, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(ids[at : at + len(block)], pa.int64()), pa.array(copy, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(own, pa.binary())], names=["rid", "doc_id", "copy", "bands", "shingles"])
                at += len(block)

    return stash(rows.mapInArrow(make, FEATURES), "neardup-features"), idf


def similarity(a: bytes, b: bytes, idf: np.ndarray) -> float:
    """The weighted Jaccard similarity."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    (h, v), (g, w) = weigh(x, idf), weigh(y, idf)
    _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    shared = np.minimum(v[i], w[j]).sum()
    return shared / (v.sum() + w.sum() - shared)


def verified(pairs: DataFrame, feats: DataFrame, idf: np.ndarray) -> DataFrame:
    """Those of the pairs (a, b) that are links."""
    held = pairs.sparkSession.sparkContext.broadcast(idf)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = [similarity(x, y, held.value) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    left = feats.select(F.col("rid").alias("a"), F.col("shingles").alias("x"))
    right = feats.select(F.col("rid").alias("b"), F.col("shingles").alias("y"))
    # sort-merge joins at any size: a hot side is split by the skew join, and the plan stays the same as data grow
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(check, "a long, b long, similarity double").filter(F.col("similarity") >= SIMILAR)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); the root is the smallest node it is connected with.

    Each node takes the smallest label among itself and its neighbours, then that node's label. Edges between
    labels that still differ are the graph of the next round, which is soon small; the labels of the rounds
    are then followed back.
    """
    edges = stash(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges")
    rounds, spent = [], [edges]
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stash(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "cc-near")
        labels = stash(near.join(near.select(F.col("node").alias("root"), F.col("root").alias("far")), "root").select("node", F.col("far").alias("root")), "cc-labels")
        rounds.append(labels)
        side = lambda c, labels=labels: labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        left = edges.join(side("a"), "a").join(side("b"), "b").filter("ra <> rb")
        edges = stash(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        spent += [near, edges]
        if edges.isEmpty():
            break
    out = rounds.pop()
    for labels in reversed(rounds):
        top = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = stash(labels.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "cc-roots")
    discard(*spent)
    return out


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after more links: those that join two of the classes so far are followed between classes alone."""
    if roots is None:
        return components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = roots.select("node", "root")
    every = stash(every.unionByName(ends.join(every, "node", "left_anti").select("node", F.col("node").alias("root"))), "cc-nodes")
    side = lambda c: every.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = links.join(side("a"), "a").join(side("b"), "b").filter("ra <> rb")
    between = stash(between.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-links")
    if between.isEmpty():
        return every
    top = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return every.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def draw_of(*cols: Column) -> Column:
    return F.xxhash64(*cols)


PREFIXES = "rid long, token long, weight double, weight_left double"


def prefixes(sets: DataFrame, idf: np.ndarray) -> DataFrame:
    """Of each text the shingles among which it has its first common one with any text it is linked with.

    In order of their number of texts here; with each what the text's shingles weigh, in all and from
    this one on.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                seen += np.bincount(slot_of(np.unique(np.frombuffer(x, "<u4"))), minlength=SLOTS)
        at = np.flatnonzero(seen)
        if len(at):
            yield pa.RecordBatch.from_pydict({"slot": pa.array(at, pa.int32()), "n": pa.array(seen[at], pa.int64())})

    sums = sets.select("shingles").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    texts = np.zeros(SLOTS, np.int64)
    texts[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    held = sets.sparkSession.sparkContext.broadcast((idf, texts))
    share = SIMILAR - 1e-9

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, texts = held.value
        for b in batches:
            parts: list[list[np.ndarray]] = []
            for rid, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h, w = weigh(np.frombuffer(x, "<u4"), idf)
                order = np.lexsort((h, texts[slot_of(h)]))
                h, w = h[order], w[order]
                left = np.cumsum(w[::-1])[::-1]
                k = int((left >= share * left[0]).sum())
                parts.append([np.full(k, rid), h[:k].astype(np.int64), np.full(k, left[0]), left[:k]])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["rid", "token", "weight", "weight_left"])

    return sets.select("rid", "shingles").mapInArrow(make, PREFIXES)


def untried_pairs(buckets: DataFrame, roots: DataFrame | None, sets: DataFrame, idf: np.ndarray) -> tuple[DataFrame, list[DataFrame]]:
    """All pairs (a, b) of texts of different classes in a bucket that no bound excludes, and spent tables.

    Two texts that are linked share 2s/(1 + s) of what the lighter one weighs at least, s being the
    similarity, so their first common shingle is among the lighter one's first, from which on that much is left.
    """
    named = buckets.withColumn("root", F.col("rid")) if roots is None else buckets.join(roots.select(F.col("node").alias("rid"), F.col("root").alias("r")), "rid", "left").select("bucket", "rid", F.coalesce("r", "rid").alias("root"))
    several = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    open_ = stash(named.join(several, "bucket"), "neardup-left")
    some = stash(open_.select("rid").distinct(), "neardup-some")
    heads = stash(prefixes(sets.join(small_side(some, BROADCAST_IDS), "rid", "left_semi"), idf), "neardup-prefixes")
    keyed = open_.hint("merge").join(heads, "rid").withColumn("key", F.xxhash64("bucket", "token")).drop("bucket", "token")
    # most shingles have one text in a bucket, or are none of the first of any text there
    first = F.col("weight_left") >= FIRST * F.col("weight")
    shared = keyed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(first).alias("first")).filter("low < high AND first").select("key")
    keyed = stash(keyed.hint("merge").join(shared, "key"), "neardup-keys")
    # of two texts of different classes one is outside the key's largest class, so that class need not meet itself,
    # and what the others meet of their own is less than what they meet of it
    sizes = keyed.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"))
    small = stash(keyed.hint("merge").join(largest, "key").filter("root <> top").drop("top"), "neardup-small")
    other = small.select("key", *[F.col(c).alias(f"{c}_2") for c in keyed.columns if c != "key"])
    most = F.least("weight_left", "weight_left_2")
    may = most >= (SIMILAR - 1e-9) * (F.col("weight") + F.col("weight_2") - most)
    lighter = F.when(F.col("weight") <= F.col("weight_2"), F.col("weight_left")).otherwise(F.col("weight_left_2"))
    near = lighter >= FIRST * F.least("weight", "weight_2")
    met = keyed.hint("merge").join(other, "key").filter((F.col("root") != F.col("root_2")) & near & may)
    return met.select(F.least("rid", "rid_2").alias("a"), F.greatest("rid", "rid_2").alias("b")).distinct(), [open_, some, heads, keyed, small]


def link_classes(feats: DataFrame, idf: np.ndarray) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(copy, rid) of one document of each exact copy class, the links (a, b) between them, the (node, root) of what they connect, and spent tables."""
    first = stash(feats.groupBy("copy").agg(F.min("rid").alias("rid")), "neardup-copies")
    bands = feats.join(first.select("rid"), "rid").select("rid", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = stash(bands.join(shared, "bucket").select("bucket", "rid"), "neardup-buckets")
    some = stash(buckets.select("rid").distinct(), "neardup-some")
    sets = stash(feats.select("rid", "shingles").join(small_side(some, BROADCAST_IDS), "rid", "left_semi"), "neardup-sets")
    spark = feats.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    tried, turn = links, 0
    roots = None
    spent = [some, sets, buckets]
    while True:
        turn += 1
        if roots is None:
            members = buckets.select("bucket", F.col("rid").alias("root"), F.col("rid").alias("centre"), F.lit(1).cast("long").alias("size"))
        else:
            named = buckets.join(roots.withColumnRenamed("node", "rid"), "rid", "left")
            members = named.select("bucket", F.coalesce("root", "rid").alias("root"), F.coalesce("centre", "rid").alias("centre"), F.coalesce("size", F.lit(1)).cast("long").alias("size")).distinct()
        if roots is None:
            texts = buckets.withColumn("root", F.col("rid"))
        else:
            texts = named.select("bucket", "rid", F.coalesce("root", "rid").alias("root"))
        order = F.struct("size", draw_of(F.col("centre"), F.lit(turn)).alias("draw"), "centre")
        per = members.groupBy("bucket").agg(F.count("*").alias("n"), F.max(order).alias("hub")).filter("n > 1").select("bucket", "n", F.col("hub.centre").alias("hub"))
        open_ = stash(members.join(per, "bucket").select("bucket", "centre", "hub", "n"), "neardup-open")
        star = open_.filter((F.col("n") > FEW) & (F.col("centre") != F.col("hub"))).select(F.least("centre", "hub").alias("a"), F.greatest("centre", "hub").alias("b"))
        few = open_.filter(F.col("n") <= FEW).groupBy("bucket").agg(F.array_sort(F.collect_list("centre")).alias("c"))
        pairs = few.select(F.explode("c").alias("a"), "c").select("a", F.explode(F.filter("c", lambda x: x > F.col("a"))).alias("b"))
        large = texts.groupBy("bucket").agg(F.count("*").alias("n_texts")).join(per.filter(F.col("n") > FEW).select("bucket"), "bucket")
        place = F.pmod(draw_of(F.col("rid"), F.col("bucket"), F.lit(-turn)), F.ceil(F.col("n_texts") / SHARE)).alias("share")
        shares = texts.join(large, "bucket").groupBy("bucket", place).agg(F.array_sort(F.collect_list(F.struct("rid", "root"))).alias("c"))
        others = F.filter("c", lambda x: (x["rid"] > F.col("x.rid")) & (x["root"] != F.col("x.root")))
        mixed = shares.select(F.explode("c").alias("x"), "c").select(F.col("x.rid").alias("a"), F.explode(others).alias("y")).select("a", F.col("y.rid").alias("b"))
        pairs = stash(star.unionByName(pairs).unionByName(mixed).distinct().join(tried, ["a", "b"], "left_anti"), "neardup-pairs")
        if pairs.isEmpty():
            spent += [open_, pairs]
            break
        new = stash(verified(pairs, sets, idf).select("a", "b"), "neardup-links")
        tried = tried.unionByName(pairs)
        open_classes = open_.select("centre").distinct().count()
        discard(open_)
        n_new = new.count()
        if not n_new and turn > 2:
            break
        links = stash(links.unionByName(new), "neardup-links")
        roots = merged(roots, new)
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        best = roots.join(degree, "node").groupBy("root").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("centre"), F.count("*").alias("size"))
        roots = stash(roots.join(best, "root").select("node", "root", "centre", "size"), "neardup-roots")
        if turn > 1 and n_new * 50 < open_classes:
            break
    pairs, used = untried_pairs(buckets, roots, sets, idf)
    pairs = stash(pairs.join(tried, ["a", "b"], "left_anti"), "neardup-pairs")
    new = stash(verified(pairs, sets, idf).select("a", "b"), "neardup-links")
    return first, links.unionByName(new), merged(roots, new), [*spent, *used, pairs]


def near_duplicates(docs: DataFrame, rid: Column | None = None) -> DataFrame:
    """rid, doc_id, class_id (smallest doc_id of the class), class_rid (its first row), n_links of the text, class_size."""
    feats, idf = features(docs, rid)
    first, links, roots, spent = link_classes(feats, idf)
    discard(*spent)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = roots.join(degree, "node", "left").withColumnRenamed("node", "rid")
    classes = stash(first.join(named, "rid", "left").select("copy", F.coalesce("root", "rid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "neardup-classes")
    rows = stash(feats.select("rid", "doc_id", "copy").join(classes, "copy").select("rid", "doc_id", "root", "n_links"), "neardup-rows")
    discard(feats, first, classes)
    heads = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min_by("rid", F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("class_rid"), F.count("*").alias("class_size"))
    return rows.join(heads, "root").select("rid", "doc_id", "class_id", "class_rid", "n_links", "class_size")


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "class_size")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id; all columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    held = stash(docs.select(F.monotonically_increasing_id().alias("_rid"), row), "neardup-docs")
    found = near_duplicates(held.select("_rid", "_row.doc_id", "_row.text"), F.col("_rid"))
    gone = stash(found.filter(F.col("rid") != F.col("class_rid")).select(F.col("rid").alias("_rid")), "neardup-gone")
    return held.join(small_side(gone, BROADCAST_IDS), "_rid", "left_anti").select("_row.*")
