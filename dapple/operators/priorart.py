"""RUL-10: features of claims against the passages of documents, by verified mappings, by terms and by likeness."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dapple.functions import text as T
from dapple.operators.dictionary import counted, occurrences, term_hits
from dapple.operators.storage import cut

# The weights of the score, the least score of a candidate, how many of them are kept.
RATIO, JACCARD = 0.45, 0.55
LEAST, KEEP = 0.42, 5
#: Characters of features, and features, that a task holds at a time; passages that it compares with them at once.
BLOCK_CHARS, BLOCK_FEATURES, ROWS = 100_000, 2_000, 256
#: Columns of the counts of letters at most.
BINS = 1024


def folded(c: Column, groups: Sequence[tuple[str, Sequence[str]]] = ()) -> Column:
    """A text without blanks and punctuation in lower case, with terms of the same meaning as one sign, the longest first."""
    out = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+|[，。；、,;:：()（）\[\]【】]", "")
    for canonical, terms in groups:
        for term in sorted(terms, key=len, reverse=True):
            out = F.replace(out, F.lit(term.lower()), F.lit(f"<{canonical}>"))
    return out


def grams(c: Column) -> Column:
    return F.when(F.length(c) > 3, T.ngrams(c, 3)).when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def gram_set(x: str) -> set[str]:
    return {x[i : i + 3] for i in range(len(x) - 2)} if len(x) > 3 else {x} if x else set()


class Common:
    """Longest common subsequences of some texts with others, a bit for each letter of a text, many pairs at a time."""

    def __init__(self, texts: Sequence[str]):
        letters = sorted({ord(c) for x in texts for c in x})
        self.kinds = len(letters) + 1
        self.places = np.full(0x110000, len(letters), np.int32)  # the last is for letters of no text
        self.places[letters] = np.arange(len(letters))
        self.words = np.array([-(-len(x) // 64) for x in texts])
        self.masks = np.zeros((int(self.words.max(initial=1)), len(texts), self.kinds), np.uint64)
        for i, x in enumerate(texts):
            for k, c in enumerate(x):
                self.masks[k // 64, i, self.places[ord(c)]] |= np.uint64(1 << k % 64)

    def lengths(self, held: np.ndarray, others: Sequence[str], which: np.ndarray) -> np.ndarray:
        """The length for each pair of a text held and one of the others."""
        out = np.zeros(len(held), np.int64)
        size = np.array([len(x) for x in others], np.int64)
        begins = np.append(0, np.cumsum(size))
        letters = self.places[np.frombuffer("".join(others).encode("utf-32-le", "surrogatepass"), "<u4")]
        flat = self.masks.reshape(len(self.masks), -1)
        for words in np.unique(self.words[held]):
            every = np.flatnonzero(self.words[held] == words)
            every = every[np.argsort(size[which[every]], kind="stable")]
            for own in (every[i : i + 16384] for i in range(0, len(every), 16384)):
                longer = np.searchsorted(size[which[own]], np.arange(size[which[own[-1]]]), "right")
                base, begin = held[own] * self.kinds, begins[which[own]]
                v = [np.full(len(own), ~np.uint64(0)) for _ in range(words)]
                for step, first in enumerate(longer.tolist()):
                    place, carry = base[first:] + letters[begin[first:] + step], None
                    for w in range(words):
                        mask, now = flat[w][place], v[w][first:]
                        u = now & mask
                        total = now + u
                        if words > 1:
                            over = total < u
                            if carry is not None:
                                total += carry
                                over |= total < carry
                            carry = over.astype(np.uint64)
                        now &= ~mask
                        now |= total
                out[own] = 64 * words - sum(np.bitwise_count(x).astype(np.int64) for x in v)
        return out


def spread(rows: DataFrame) -> DataFrame:
    """The rows over four times as many tasks as there are cores at least, so that no core waits for a last long one."""
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def likely_pairs(features: DataFrame, passages: DataFrame, least: float = LEAST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(feature, document, locator, score) of the pairs whose score reaches ``least``.

    Features (feature, x) are few and come in blocks; each passage (document, locator, x) meets all features of a
    block at once: a row of a matrix for each of its trigrams, added up, has what it shares with each. The ratio is
    at most what the letters of both have in common, a product of matrices, and at most their longest common
    subsequence, which is worked out for the pairs that are left, by bits; the ratio itself where that allows it.
    """
    if least <= 0.405:
        raise ValueError("pairs without a common trigram could reach a score of 0.405")
    spark = features.sparkSession
    features = cut(features.filter("x <> ''").select("feature", "x").distinct(), "features")
    size, n = features.agg(F.sum(F.length("x")), F.count("*")).first()
    blocks, parts = max(1, -(-(size or 0) // block_chars), -(-n // BLOCK_FEATURES)), []
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    for block in range(blocks):
        own = features if blocks == 1 else features.filter(F.pmod(F.xxhash64("feature", "x"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])

        def look(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            if not held.value:
                return
            ids, texts = zip(*held.value, strict=True)
            grams = [gram_set(x) for x in texts]
            index = {g: i for i, g in enumerate(dict.fromkeys(g for own in grams for g in own))}
            kinds, n = np.array([len(g) for g in grams], np.float32), np.array([len(x) for x in texts], np.float32)
            holds = np.zeros((len(index) + 1, len(texts)), np.uint8 if kinds.max() < 256 else np.uint32)  # the last row is for trigrams of no feature
            for i, own in enumerate(grams):
                holds[[index[g] for g in own], i] = 1
            common, none = Common(texts), len(index)
            row, kind = occurrences(texts, 1)
            columns = np.unique(kind)
            letters = counted(row, np.searchsorted(columns, kind) % BINS, len(texts), min(BINS, len(columns)))
            for b in batches:
                at, which, scores, left = [], [], [], []
                every = b.column(2).to_pylist()
                if not every:
                    continue
                for start in range(0, len(every), ROWS):
                    xs = every[start : start + ROWS]
                    own = [gram_set(x) for x in xs]
                    shared = np.stack([holds[np.array([index.get(g, none) for g in g_x], np.intp)].sum(0, dtype=holds.dtype) for g_x in own])
                    m, k = np.array([len(x) for x in xs], np.float32)[:, None], np.array([len(g) for g in own], np.float32)[:, None]
                    jaccard = shared / (kinds + k - shared)
                    total = n + m
                    row, kind = occurrences(xs, 1)
                    column = np.searchsorted(columns, kind).clip(max=len(columns) - 1)
                    known = columns[column] == kind
                    alike = counted(row[known], column[known] % BINS, len(xs), letters.shape[1]) @ letters.T
                    most = np.minimum(np.minimum(alike, n), m) * (2 * RATIO) / total
                    i, j = np.nonzero((shared > 0) & (most + JACCARD * jaccard >= least - 1e-4))
                    s = shared[i, j].astype(np.float64)
                    left.append((start + i, j, total[i, j], s / (kinds[j].astype(np.float64) + k[i, 0] - s)))
                i, j, total, jaccard = map(np.concatenate, zip(*left, strict=True))
                may = RATIO * 2 * common.lengths(j, every, i) / total + JACCARD * jaccard >= least - 1e-4
                for row, f, own in zip(i[may].tolist(), j[may].tolist(), jaccard[may].tolist(), strict=True):
                    score = round(RATIO * T.ratio(texts[f], every[row]) + JACCARD * own, 4)
                    if score >= least:
                        at.append(row)
                        which.append(ids[f])
                        scores.append(score)
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.string()), b.column(0).take(rows), b.column(1).take(rows), pa.array(scores, pa.float64())], names=["feature", "document", "locator", "score"])

        kind = {f.name: f.dataType.simpleString() for f in passages.schema}
        found = passages.select("document", "locator", "x").mapInArrow(look, f"feature string, document {kind['document']}, locator {kind['locator']}, score double")
        parts.append(found if blocks == 1 else cut(found, "likely"))
    return reduce(DataFrame.unionByName, parts)


def prior_art_matrix(features: DataFrame, passages: DataFrame, mappings: DataFrame | None = None, groups: Sequence[tuple[str, Sequence[str]]] = (), least: float = LEAST, keep: int = KEEP) -> DataFrame:
    """(feature, document, status, basis, candidates) of features (feature, text, terms) and passages (document, locator, text).

    A passage is a candidate if it holds a term of the feature, in any case, or scores ``least``: 0.45 of the
    sequence ratio and 0.55 of the trigram Jaccard of the folded texts. Of each feature and document the ``keep``
    best stay: most terms, then the highest score, then the first locator. A verified mapping (feature, document,
    status, evidence, locators, the last two counts) decides the status, but is MAPPING_INCOMPLETE if it says
    disclosed without evidence or locator; else terms ask for a lexical review, likeness alone for a semantic one.
    Pairs of a feature and a document that are not in the result are NOT_LOCATED_IN_PROVIDED_TEXT. Keys are
    unique; null and empty texts are candidates of nothing.
    """
    held = cut(features.select(F.col("feature").cast("string").alias("feature"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), folded(F.col("text"), groups).alias("fx")), "features")
    texts = cut(spread(passages).select("document", "locator", F.lower(F.coalesce("text", F.lit(""))).alias("low"), folded(F.col("text"), groups).alias("x")), "passages")
    wanted = held.select("feature", F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("term"))
    keyed = texts.select(F.struct("document", "locator").alias("key"), "low")
    lexical = term_hits(keyed, "key", "low", wanted).join(wanted, "term").groupBy("feature", "key.document", "key.locator").agg(F.count("*").alias("n_terms"), F.array_sort(F.collect_set("term")).alias("matched"))
    lexical = cut(lexical, "lexical")  # read twice
    likely = likely_pairs(held.select("feature", F.col("fx").alias("x")), texts, least)
    keys = ["feature", "document", "locator"]
    likely = cut(likely, "likely")
    # passages that hold a term and are not alike have their score too
    cores = texts.sparkSession.sparkContext.defaultParallelism
    other = lexical.join(likely, keys, "left_anti").repartition(cores, *keys).join(held.select("feature", "fx"), "feature").join(texts.select("document", "locator", "x"), ["document", "locator"])
    score = F.round(RATIO * T.sequence_ratio("fx", "x") + JACCARD * T.jaccard(grams(F.col("fx")), grams(F.col("x"))), 4)
    other = other.select(*keys, "n_terms", "matched", F.when((F.col("fx") != "") & (F.col("x") != ""), score).otherwise(0.0).alias("score"))
    alike = likely.join(lexical, keys, "left").select(*keys, F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "matched", "score")
    scored = alike.unionByName(other)
    place = Window.partitionBy("feature", "document").orderBy(F.desc("n_terms"), F.desc("score"), "locator")
    best = scored.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= keep)
    one = F.struct("place", "locator", F.coalesce("matched", F.array().cast("array<string>")).alias("terms"), "score")
    cells = best.groupBy("feature", "document").agg(F.array_sort(F.collect_list(one)).alias("candidates"), (F.max("n_terms") > 0).alias("lexical"))
    status = F.when(F.col("lexical"), "LEXICAL_REVIEW_REQUIRED").otherwise("SEMANTIC_REVIEW_REQUIRED")
    basis = F.when(F.col("lexical"), "machine_candidate_only").otherwise("hybrid_semantic_candidate_only")
    if mappings is not None:
        known = mappings.select(F.col("feature").cast("string").alias("feature"), "document", F.coalesce("status", F.lit("uncertain")).alias("_status"), "evidence", "locators")
        cells = cells.join(known, ["feature", "document"], "full_outer")
        broken = (F.col("_status") == "disclosed") & ((F.coalesce("evidence", F.lit(0)) == 0) | (F.coalesce("locators", F.lit(0)) == 0))
        status = F.when(broken, "MAPPING_INCOMPLETE").when(F.col("_status").isNotNull(), F.col("_status")).otherwise(status)
        basis = F.when(broken, "mapping_missing_evidence_or_locator").when(F.col("_status").isNotNull(), "verified_feature_mapping").otherwise(basis)
    return cells.select("feature", "document", status.alias("status"), basis.alias("basis"), F.coalesce("candidates", F.array().cast("array<struct<place:int,locator:int,terms:array<string>,score:double>>")).alias("candidates"))
