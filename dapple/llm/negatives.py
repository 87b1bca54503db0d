"""Hard negatives by a full sort of each anchor's scores.

Components become integers, so a score is an exact integer inner product. Each anchor is scored against
every row; a share of the rows is sorted by score and id in the task that holds it (a lexsort), and the
shares' results are merged. First each anchor's positives are found, the best rows of its own label.
Then, in the sorted scores of the rows of other labels, a binary search finds the first score that is
not above a positive's upper limit, and from there entries are read as long as they are not below its
lower limit, ``k`` at most: a row among the first k of all is among the first k of its share.

Anchors are a set share of all rows, so this is a scan of all rows for each block of anchors. A block
has at most ``BLOCK_BYTES`` of components, whatever the dimension; it and its positives, a bound number
for each anchor, are sent to the tasks, and a block's result is written before the next begins. A task
gives back ``k`` rows at most for each anchor and positive; they are merged in shares, then over them.

Defined cases: rows with a null vec_id, label or vector, or a null or non-finite component, also after
scaling, take no part. A shorter vector has zeros where a longer one goes on. Rows are told apart by a
number of their own, so repeated rows are each other's positives and have results of their own, and ties
in vec_id go by that number. An anchor without positives, or a positive without a row within its limits,
has no rows (so with a negative positive score, whose limits leave nothing between them). Scores
beyond 64 bits are compared exactly and written as the nearest long. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.llm.common import batch_rows, discard, stash, table

SCALE = 256
POSITIVES = 5
K = 3
LOWER, UPPER = 50, 95
BLOCK_BYTES = 32 << 20
BLOCK_ANCHORS = 20_000
#: Scores that a task holds at a time.
HELD_SCORES = 2_000_000
SHARES = 16

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """n, vec_id, label, v (array of whole doubles) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double") * F.lit(float(scale)))
    rows = vectors.select(F.monotonically_increasing_id().alias("n"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("v", lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))
    return rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(finite).withColumn("v", whole)


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows of ``dim`` numbers, shorter ones with zeros behind."""
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


class Anchors:
    """A block of anchors, and the limits that its positives set once they are known."""

    def __init__(self, rows: pa.Table, dim: int, most: float):
        self.n, self.ids, self.labels = (rows.column(c).to_numpy() for c in ("n", "vec_id", "label"))
        self.v = matrix(rows.column("v").combine_chunks(), dim)
        #: Sums of products that fit a double are exact in any order; beyond, Python's integers are.
        self.exact = dim * most * most < 2.0**53
        self.positives: list[list[tuple[int, int]]] = [[] for _ in self.n]

    def scores(self, first: int, last: int, v: np.ndarray) -> np.ndarray:
        if self.exact:
            return (self.v[first:last] @ v.T).astype(np.int64)
        whole = np.vectorize(int, otypes=[object])
        return whole(self.v[first:last]).dot(whole(v).T) if v.size else np.zeros((last - first, len(v)), object)

    def find_positives(self, n: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, count: int) -> Iterator[tuple]:
        """(anchor, score, id, n) of the best rows of an anchor's own label; the rows come in order of id and n."""
        step = max(1, HELD_SCORES // max(1, len(n)))
        for first in range(0, len(self.n), step):
            score = self.scores(first, min(first + step, len(self.n)), v)
            for i, row in enumerate(score):
                at = np.flatnonzero((labels == self.labels[first + i]) & (n != self.n[first + i]))
                for j in at[np.argsort(-row[at], kind="stable")[:count]]:
                    yield first + i, int(row[j]), int(ids[j]), int(n[j])

    def find_negatives(self, n: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, k: int, lower: int, upper: int) -> Iterator[tuple]:
        """(anchor, place of its positive, score, id, n) of the first rows of other labels within a positive's limits."""
        step = max(1, HELD_SCORES // max(1, len(n)))
        for first in range(0, len(self.n), step):
            score = self.scores(first, min(first + step, len(self.n)), v)
            for i, row in enumerate(score):
                if not self.positives[first + i]:
                    continue
                other = np.flatnonzero(labels != self.labels[first + i])
                falling = -row[other]
                order = np.argsort(falling, kind="stable")  # by id where scores are equal, as the rows are in order of id
                falling, other = falling[order], other[order]
                for place, (positive, _) in enumerate(self.positives[first + i]):
                    most, least = upper * positive // 100, -(-lower * positive // 100)
                    begin = np.searchsorted(falling, -most, "left")
                    for j in other[begin : begin + k]:
                        if row[j] < least:
                            break
                        yield first + i, place, int(row[j]), int(ids[j]), int(n[j])


def ordered(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, ...]:
    n, ids, labels = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("n", "vec_id", "label"))
    order = np.lexsort((n, ids))
    return n[order], ids[order], labels[order], matrix(b.column(b.schema.get_field_index("v")), dim)[order]


def sized(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


def kept(found: dict[tuple, list], new: Iterator[tuple], width: int, count: int) -> None:
    """Adds rows to those of a task: for each key, their first ``width`` values, ``count`` entries by falling score, then id and number."""
    for row in new:
        best = found.setdefault(row[:width], [])
        best.append((-row[width], *row[width + 1 :]))
        if len(best) > 8 * count:
            best.sort()
            del best[count:]


def of_task(found: dict[tuple, list], count: int) -> Iterator[tuple]:
    for key, best in found.items():
        for entry in sorted(best)[:count]:
            yield (*key, -entry[0], *entry[1:])


def first_of(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The first ``count`` of each key by falling score, then id, then number, as the array ``best``.

    Exact scores are the strings ``s`` of a sign and digits where a long is too small; see ``sort_key``.
    """
    entry = F.struct("key", "vec_id", "n", "score")
    share = F.pmod(F.xxhash64("n"), F.lit(SHARES)).alias("share")
    part = rows.groupBy(*keys, share).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, count).alias("best"))
    return part.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, count).alias("best"))


#: Half the range of exact scores: more than 1,000 bits for each factor, and room for the sum.
RANGE = 1 << 2200


def sort_key(score: int, exact: bool) -> str:
    """A string whose order is that of falling scores."""
    return f"{(1 << 63) - score:020d}" if exact else f"{RANGE - score:0700d}"


def mine(vectors: DataFrame, asked: Column, label: Column | None = None, scale: int = SCALE, positives: int = POSITIVES, k: int = K, lower: int = LOWER, upper: int = UPPER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``asked``, a condition on vec_id, holds; a negative has another label
    and lower * positive_score <= 100 * negative_score <= upper * positive_score.
    """
    spark = vectors.sparkSession
    rows = stash(usable(vectors, F.col("label") if label is None else label, scale), "hard-rows")
    most = F.max(F.array_max(F.transform("v", F.abs)))
    dim, largest, asking = rows.agg(F.max(F.size("v")), most, F.count_if(asked)).first()
    found: list[DataFrame] = []
    if not asking:
        return spark.createDataFrame([], RESULT)
    dim, largest = dim or 0, largest or 0.0
    blocks = max(1, -(-asking // BLOCK_ANCHORS), -(-asking * 8 * dim // block_bytes))
    for block in range(blocks):
        own = rows.filter(asked)
        got = (own if blocks == 1 else own.filter(F.pmod(F.xxhash64("n"), F.lit(blocks)) == block)).toArrow()
        if not got.num_rows:
            continue
        anchors = Anchors(got, dim, largest)
        held = spark.sparkContext.broadcast(anchors)
        exact = anchors.exact
        batch_rows(spark, 10_000)

        def positive_rows(batches: Iterator[pa.RecordBatch], held=held, exact=exact) -> Iterator[pa.RecordBatch]:
            best: dict[tuple, list] = {}
            for b in batches:
                kept(best, held.value.find_positives(*ordered(b, dim), positives), 1, positives)
            if best:
                out = [(a, sort_key(s, exact), str(s), i, n) for a, s, i, n in of_task(best, positives)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["anchor", "key", "score", "vec_id", "n"])

        best = first_of(rows.mapInArrow(positive_rows, "anchor int, key string, score string, vec_id long, n long"), ["anchor"], positives)
        # a bound number for each anchor of the block
        for anchor, places in best.select("anchor", F.transform("best", lambda x: F.struct(x["score"], x["vec_id"]))).toLocalIterator():
            anchors.positives[anchor] = [(int(s), i) for s, i in places]
        held.unpersist()
        held = spark.sparkContext.broadcast(anchors)

        def negative_rows(batches: Iterator[pa.RecordBatch], held=held, exact=exact) -> Iterator[pa.RecordBatch]:
            block, best = held.value, {}
            for b in batches:
                kept(best, block.find_negatives(*ordered(b, dim), k, lower, upper), 2, k)
            out = []
            for a, place, s, i, n in of_task(best, k):
                positive, positive_id = block.positives[a][place]
                out.append((a, place, int(block.ids[a]), positive_id, sized(positive), sort_key(s, exact), sized(s), i, n))
            if out:
                types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=NEGATIVE_NAMES)

        near = first_of(rows.mapInArrow(negative_rows, NEGATIVE), ["anchor", "place", "anchor_id", "positive_id", "positive_score"], k)
        each = near.select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("rank", "x"))
        each = each.select("anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))
        found.append(stash(each, "hard-found"))
        held.unpersist()
    discard(rows)
    batch_rows(spark)
    return reduce(DataFrame.unionByName, found)


NEGATIVE = "anchor int, place int, anchor_id long, positive_id long, positive_score long, key string, score long, vec_id long, n long"
NEGATIVE_NAMES = [part.split()[0] for part in NEGATIVE.split(", ")]


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are every fiftieth id; labels where vec_id is divisible by seven are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


ORACLE = """
WITH rows AS (
    SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.n AS anchor, a.vec_id AS anchor_id, a.label = r.label AS same, r.n, r.vec_id, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM rows a JOIN rows r ON a.n <> r.n WHERE a.vec_id % 50 = 0),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, n) <= 5),
negatives AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.vec_id, s.n) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
