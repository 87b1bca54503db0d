"""Approximate maximum inner product search with score-aware anisotropic quantisation.

Vectors are split into short subspaces of ``SUB`` components, each quantised to 16 codewords (four
bits). Training weighs the residual error parallel to the vector ``ETA`` times as much as the
orthogonal error, as the parallel part is what moves high inner products; assignment does coordinate
descent over the subspaces under the same loss, codewords are the solution of the weighted least
squares. A query builds one table of 16 entries per subspace and scans the packed codes by table
lookups; the best ``KEEP`` per query go to exact reranking in double precision on the original
vectors.

The codebook is fitted on a sample of about ``SAMPLE`` vectors drawn by a hash of their row number;
every vector is encoded and searched. Codes are scanned where they lie: queries come in blocks of about
``QUERY_BLOCK`` and go to each partition, which gives back its best per query; those candidates, a
bound number for each query and partition, are reduced in two steps. A block's result is written
before the next block begins, so one block is all that the driver and the tasks hold.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
those with a null vec_id; vectors of another length than the most frequent one take no part either.
Rows are told apart by a number they get once, in a written table: each query row has a result list of
its own, also where ids or rows repeat, and skips its own row only. Ties go to the smaller vec_id; fewer
candidates than k give all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.llm.common import batch_rows, discard, stash, table

SUB = 2
SAMPLE = 20_000
ETA = 4.0
KEEP = 300
QUERY_BLOCK = 20_000
SHARES = 16
#: Numbers of the vectors that a task reranks at a time, whatever their dimension.
HELD_NUMBERS = 4_000_000
ROUNDS = 6
FOUND = "n long, query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").filter((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0.0))


class Codebook:
    """Sixteen codewords for each subspace, and the loss's weight of the parallel error."""

    def __init__(self, sample: np.ndarray, eta: float = ETA, rounds: int = ROUNDS):
        n, dim = sample.shape
        self.dim, self.eta, self.parts = dim, eta, -(-dim // SUB)
        x = self.padded(sample)
        rng = np.random.default_rng(3)
        pick = rng.integers(0, n, (self.parts, 16))
        self.words = np.stack([x[pick[p], p] for p in range(self.parts)])
        for _ in range(rounds):
            codes = self.encode(sample)
            self.fit(x, codes)

    def padded(self, v: np.ndarray) -> np.ndarray:
        """n x parts x SUB"""
        out = np.zeros((len(v), self.parts * SUB))
        out[:, : self.dim] = v
        return out.reshape(len(v), self.parts, SUB)

    def encode(self, v: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """n x parts codes, by coordinate descent on |r|^2 + (eta - 1) (r.u)^2 with u = v / |v|."""
        x = self.padded(v)
        u = x / np.linalg.norm(v, axis=1)[:, None, None]
        codes = np.zeros((len(v), self.parts), np.uint8)
        along = np.zeros(len(v))  # r.u of the subspaces as coded so far
        parts = np.zeros((len(v), self.parts))
        for sweep in range(sweeps):
            for p in range(self.parts):
                r = x[:, p, None, :] - self.words[None, p]
                ru = np.einsum("nks,ns->nk", r, u[:, p])
                rest = (along - parts[:, p])[:, None] if sweep else 0.0
                loss = (r * r).sum(2) + (self.eta - 1) * (rest + ru) ** 2
                best = loss.argmin(1)
                codes[:, p] = best
                new = ru[np.arange(len(v)), best]
                along += new - parts[:, p]
                parts[:, p] = new
        return codes

    def fit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Codewords of one subspace after the other, the others held."""
        u = x / np.linalg.norm(x.reshape(len(x), -1), axis=1)[:, None, None]
        r = x - np.stack([self.words[p][codes[:, p]] for p in range(self.parts)], 1)
        along = (r * u).sum((1, 2))
        for p in range(self.parts):
            others = along - (r[:, p] * u[:, p]).sum(1)
            for k in range(16):
                own = codes[:, p] == k
                if own.any():
                    up, xp = u[own, p], x[own, p]
                    a = own.sum() * np.eye(SUB) + (self.eta - 1) * up.T @ up
                    b = xp.sum(0) + (self.eta - 1) * (up * (others[own] + (xp * up).sum(1))[:, None]).sum(0)
                    self.words[p, k] = np.linalg.solve(a, b)
            r[:, p] = x[:, p] - self.words[p][codes[:, p]]
            along = others + (r[:, p] * u[:, p]).sum(1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x parts x 16 inner products."""
        return np.einsum("qps,pks->qpk", self.padded(q), self.words)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes of four bits to a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | (codes[:, 1::2] << 4)


def scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """queries x vectors approximate scores: the tables of two subspaces make one of 256 entries for a byte."""
    q, parts, _ = tables.shape
    if parts % 2:
        tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
    pairs = (tables[:, 1::2, :, None] + tables[:, ::2, None, :]).reshape(q, -1, 256).astype(np.float32)
    out = np.zeros((q, len(packed)), np.float32)
    for b in range(packed.shape[1]):
        out += pairs[:, b].take(packed[:, b], axis=1)
    return out


def best_of(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, in no order."""
    return np.argpartition(-score, k - 1, axis=1)[:, :k] if score.shape[1] > k else np.tile(np.arange(score.shape[1]), (len(score), 1))


def column(b: pa.RecordBatch, i: int, dim: int) -> np.ndarray:
    return b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(vectors: DataFrame, asked: Column, k: int = 20, keep: int = KEEP, sample: int = SAMPLE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of ``vectors`` for which ``asked`` holds.

    ``asked`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = stash(usable(vectors).select(F.monotonically_increasing_id().alias("n"), "vec_id", "v"), "ann-rows")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return empty
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    alike = rows.filter(F.size("v") == dim)
    drawn = alike if n <= sample else alike.filter(F.pmod(F.xxhash64("n"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    some = drawn.select("v").toArrow().column("v").combine_chunks()
    book = spark.sparkContext.broadcast(Codebook(some.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
    batch_rows(spark, 10_000)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = pack(book.value.encode(column(b, 2, dim)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in packed], pa.binary()), b.column(2)], names=["n", "vec_id", "code", "v"])

    index = stash(alike.mapInArrow(encode, "n long, vec_id long, code binary, v array<double>"), "ann-index")
    queries = index.filter(asked)
    found, blocks = [], max(1, -(-queries.count() // query_block))
    for block in range(blocks):
        own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("n", F.lit(5)), F.lit(blocks)) == block)
        got = own.select("n", "vec_id", "v").toArrow()
        if not got.num_rows:
            continue
        q = got.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        held = spark.sparkContext.broadcast((got.column("n").to_numpy(), got.column("vec_id").to_numpy(), q))

        def look(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            numbers, ids, vecs = held.value
            kept: list = []
            for b in batches:
                own, v_ids, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), column(b, 3, dim)
                packed = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(v_ids), -1)
                best = []
                for a in range(0, len(ids), 256):
                    part = vecs[a : a + 256]
                    score = scan(book.value.tables(part), packed)
                    score[numbers[a : a + 256, None] == own[None, :]] = -np.inf
                    at = best_of(score, keep)
                    exact = np.empty(at.shape)
                    step = max(1, HELD_NUMBERS // (at.shape[1] * dim))
                    for q in range(0, len(part), step):
                        exact[q : q + step] = np.einsum("qd,qkd->qk", part[q : q + step], v[at[q : q + step]])
                    exact[numbers[a : a + 256, None] == own[at]] = -np.inf
                    # the best of the exact scores, ties to the smaller id
                    order = np.lexsort((v_ids[at], -exact), axis=1)[:, :k]
                    best.append((np.take_along_axis(v_ids[at], order, 1), np.take_along_axis(exact, order, 1)))
                if best:
                    new = np.concatenate([x for x, _ in best]), np.concatenate([x for _, x in best])
                    if kept:
                        both, score = np.concatenate([kept[0], new[0]], 1), np.concatenate([kept[1], new[1]], 1)
                        order = np.lexsort((both, -score), axis=1)[:, :k]
                        new = np.take_along_axis(both, order, 1), np.take_along_axis(score, order, 1)
                    kept = list(new)
            if kept:
                real = np.isfinite(kept[1])
                each = real.sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, each)), pa.array(np.repeat(ids, each)), pa.array(kept[0][real]), pa.array(kept[1][real])], names=["n", "query_id", "vec_id", "score"])

        place = F.struct((-F.col("score")).alias("s"), F.col("vec_id"))
        # first within shares of a query's finds, so that no group grows with the number of partitions alone
        share = F.pmod(F.xxhash64("vec_id"), F.lit(SHARES)).alias("share")
        part = index.mapInArrow(look, FOUND).groupBy("n", "query_id", share).agg(F.slice(F.array_sort(F.collect_list(place)), 1, k).alias("best"))
        best = part.groupBy("n", "query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        out = best.select("query_id", F.posexplode("best").alias("rank", "x"))
        found.append(stash(out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score")), "ann-found"))
        held.unpersist()
    discard(rows, index)
    batch_rows(spark)
    return reduce(DataFrame.unionByName, found) if found else empty


def op9_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
