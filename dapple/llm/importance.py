"""Importance resampling towards a target distribution over hashed n-gram buckets.

The features of a text are its runs of ``low`` to ``high`` words; a feature's bucket is the crc32 of its
UTF-8 bytes modulo ``buckets``. The sparse document-by-bucket count matrix is written once: a row of the
table is a document with its bucket numbers and their counts, at most ``buckets`` of them, and an Arrow
batch is a CSR block, whose row starts are the offsets of its lists. (Parquet's readers and writers hold
thousands of rows whatever their length, so a row is never a block.) Column sums of the blocks give the
distribution of the raw documents, those of the target texts the distribution aimed at; a bucket's gain is
the scaled logarithm of the two shares with one count added everywhere. The matrix times the gains gives a
document's weight. With Gumbel noise, a function of seed and doc_id, added, the highest scores are a draw
without repetition in proportion to the weights.

Column sums leave a task as one row of at most ``buckets`` numbers, so the driver and a task hold the
gains and never more. Draws are numbered by ranges of the order, not in one task.

Defined cases: null and empty texts, and texts without words, have no features, weight 0 and are drawn
only if they have ``least_words``; a null doc_id has the noise of the empty string and comes before the
others in ties; rows that share a doc_id share its noise and are drawn each by itself; an empty table
gives an empty result; an empty target has an even distribution. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.llm.common import batch_rows, discard, stash, table, text_of
from dapple.operators.relational import numbered

BUCKETS = 10_000
SCALE = 1000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Distinct features whose buckets a task remembers.
REMEMBERED = 200_000

#: Bytes to bytes: A-Z to lower case, what is no part of a word to a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

BLOCK = "doc_id long, n_words long, columns array<int>, counts array<int>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(LETTERS).split()


def runs(words: list[bytes], low: int, high: int) -> Iterator[bytes]:
    for n in range(low, high + 1):
        if n == 1:
            yield from words
        else:
            yield from map(b" ".join, zip(*[words[i:] for i in range(n)], strict=False))


def count_matrix(docs: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """The count matrix of a table of texts: for each its words, and the buckets and counts of its features."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            n_words, starts, columns, counts = [], [0], array("i"), array("i")
            for text in b.column(1).to_pylist():
                words = words_of(text)
                row: Counter[int] = Counter()
                for feature, n in Counter(runs(words, low, high)).items():
                    at = known.get(feature)
                    if at is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        at = known[feature] = zlib.crc32(feature) % buckets
                    row[at] += n
                n_words.append(len(words))
                columns.extend(row.keys())
                counts.extend(row.values())
                starts.append(len(columns))
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.array(x, np.int32))) for x in (columns, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), *lists], names=["doc_id", "n_words", "columns", "counts"])

    batch_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(count, BLOCK)


def entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a CSR block, one row after the other."""
    columns, counts = (b.column(b.schema.get_field_index(x)).flatten().to_numpy() for x in ("columns", "counts"))
    return columns, counts.astype(np.int64)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The counts of each bucket over all documents."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            np.add.at(total, *entries(b))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    sums = blocks.select("columns", "counts").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """For each bucket the scaled log of its share in the target over its share in the raw documents, rounded down."""
    s, t, buckets = raw.astype(float), target.astype(float), float(len(raw))
    return np.floor(scale * np.log((t + 1.0) * (s.sum() + buckets) / ((s + 1.0) * (t.sum() + buckets)))).astype(np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the count matrix times the gains."""
    held = blocks.sparkSession.sparkContext.broadcast(gain)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, counts = entries(b)
            starts = np.cumsum([0, *b.column(b.schema.get_field_index("columns")).value_lengths().to_pylist()])
            sums = [np.concatenate([[0], np.cumsum(x)])[starts] for x in (counts, counts * held.value[columns])]
            ids, n_words = (b.column(b.schema.get_field_index(x)) for x in ("doc_id", "n_words"))
            yield pa.RecordBatch.from_arrays([ids, n_words, *[pa.array(np.diff(x)) for x in sums]], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(multiply, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED, scale: int = SCALE) -> Column:
    """Scaled Gumbel noise, rounded down, from the first eight hex digits of the SHA-256 of seed:doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, low: int = 1, high: int = 1, buckets: int = BUCKETS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``; rank is null where it is not drawn.

    Of the documents with ``least_words``, ``percent`` of a hundred (rounded down) are drawn. ``target`` is a
    table with a column text.
    """
    blocks = stash(count_matrix(docs, low, high, buckets), "count-matrix")
    aim = column_sums(count_matrix(target.select(F.lit(0).alias("doc_id"), "text"), low, high, buckets), buckets)
    gain = gains(column_sums(blocks, buckets), aim, scale)
    rows = stash(weights(blocks, gain).withColumn("score", F.col("weight") + noise(seed, scale)), "weights")
    discard(blocks)
    drawn = percent * rows.filter(F.col("n_words") >= least_words).count() // 100
    # words first, so that ranks count only the documents that can be drawn
    able = numbered(rows.filter(F.col("n_words") >= least_words), [F.col("score").desc(), F.col("doc_id"), F.col("n_words")], "place")
    ranked = able.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    return ranked.unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents towards the benchmark."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = """
WITH RECURSIVE crc(i, c, k) AS (
    SELECT i, i, 0 FROM range(256) t(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
lookup AS (SELECT list(c ORDER BY i) AS entries FROM crc WHERE k = 8),
letters AS (
    SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS n, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    UNION ALL SELECT 'b', item_id, row_number() OVER (), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT side, id, n, unnest(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM letters),
counted AS (SELECT side, id, n, w, count(*) AS f FROM words GROUP BY ALL),
spelt AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM counted)),
hashed AS (
    SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)),
        lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM spelt, lookup),
cells AS (SELECT side, id, n, bucket, sum(f) AS f FROM counted JOIN hashed USING (w) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(f) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(f) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t FROM cells GROUP BY bucket),
total AS (SELECT sum(s) AS ss, sum(t) AS tt FROM sums),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS g FROM sums, total),
weighed AS (
    SELECT l.id AS doc_id, coalesce(sum(f), 0)::BIGINT AS n_features, coalesce(sum(f * g), 0)::BIGINT AS weight
    FROM letters l LEFT JOIN cells c ON c.side = 'd' AND c.n = l.n LEFT JOIN gain USING (bucket) WHERE l.side = 'd' GROUP BY l.id, l.n),
scored AS (
    SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM placed
"""
