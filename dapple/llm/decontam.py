"""Benchmark decontamination by the q-gram lemma.

A benchmark item of m characters that a document holds with at most e edits shares at least
m + 1 - q(e + 1) character q-grams with it, all within e + 1 neighbouring diagonals (place in the
document less place in the item). So shared q-grams are counted in bands of 2(e + 1) diagonals that
overlap by half; bands that reach the bound are kept and verified by an alignment within the band.
What is counted are the places in the document whose q-gram the item has within the band. An item's
places of a q-gram are held by stretches of e + 1 places, the first and last of each, which tell all
bands, so a q-gram that an item repeats costs no more than the item has stretches.
Both sides are compared in lower case with white space as single spaces.

The benchmark is the smaller side: it is indexed in blocks of ``BLOCK_CHARS`` characters, each sent
to the tasks in turn, and what a block gives is written before the next, so what a task holds is
bounded however many items there are. Documents are read once for each block and never shuffled; every
whole text is searched.

Defined cases: null and empty texts hold nothing; null and empty items match nothing; items shorter
than q match where they stand unchanged; a repeated row or item has its own result row; among
equally good places of an item in a document the first counts; an empty table on either side gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.llm.common import batch_rows, stash, table, text_of

Q = 12
EDIT_RATE = 0.06
BLOCK_CHARS = 2_000_000
#: Characters of document text that are hashed at a time.
STEP_CHARS = 2_000_000
#: Shared q-grams and bands that are held at a time.
STEP_MATCHES = 1_000_000
MULT = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 22
HIT = "doc_id long, item_id long, start long, end long, edits int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().replace("\0", " ").split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of every q-gram, by doubling."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    level, size, out, done = c.astype(np.uint64) + np.uint64(1), 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if q & size:
                n = len(c) - q + 1
                piece = level[done : done + n]
                out = piece.copy() if out is None else out * np.uint64(pow(int(MULT), size, 1 << 64)) + piece
                done += size
            if done == q:
                return out
            level = level[:-size] * np.uint64(pow(int(MULT), size, 1 << 64)) + level[size:]
            size *= 2


def slot(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h ^ (h >> np.uint64(29))) * MULT) >> np.uint64(64 - TABLE_BITS)


def banded(item: np.ndarray, doc: np.ndarray, low: int, high: int, pinned: bool = False) -> tuple[int, int]:
    """Fewest edits between the whole item and a stretch of ``doc`` along diagonals low..high, and where that ends.

    The stretch may begin anywhere in the band, or, if ``pinned``, only at the document's start.
    """
    width, far = high - low + 1, np.int32(1 << 20)
    lane = np.arange(width, dtype=np.int32)
    padded = np.full(len(item) + width + 1, -1, np.int64)
    begin, end = max(low, 0), min(low + len(item) + width, len(doc))
    padded[begin - low : max(begin, end) - low] = doc[begin : max(begin, end)]
    last = len(doc) - low  # lanes beyond the ends of the document are out
    # row[k]: item[:i] against a stretch that ends before doc place low + i + k
    row = np.where((lane + low >= 0) & (lane <= last), (lane + low) * pinned, far).astype(np.int32)
    for i, x in enumerate(item):
        change = row + (padded[i : i + width] != x)
        drop = np.append(row[1:], far) + 1
        best = np.minimum(change, drop)
        place = lane + (low + i + 1)
        best[(place < 0) | (place > len(doc))] = far
        row = np.minimum(np.minimum.accumulate(best - lane) + lane, far)
    k = int(row.argmin())
    return int(row[k]), low + len(item) + k


class Index:
    """A block of benchmark items: their q-grams in order of hash."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE):
        self.q, self.ids, self.texts = q, [i for i, _ in items], [t for _, t in items]
        self.edits = np.array([max(0, min(int(rate * len(t)), len(t) // q - 1)) for t in self.texts], np.int64)
        self.least = np.array([len(t) + 1 - q * (e + 1) for t, e in zip(self.texts, self.edits, strict=True)], np.int64)
        self.short = [k for k, t in enumerate(self.texts) if len(t) < q]
        hashes = [gram_hashes(codes(t), q) for t in self.texts]
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes] or [np.empty(0, np.int64)]).astype(np.int64)
        every = np.concatenate([*hashes, np.empty(0, np.uint64)])
        order = np.lexsort((place, item, every))
        every, item, place = every[order], item[order], place[order]
        step = self.edits[item] + 1
        part = place // step
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]) | (item[1:] != item[:-1]) | (part[1:] != part[:-1])
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(every))
        #: For each q-gram, item and stretch: the first and the last place in the stretch.
        self.item, self.part = item[begin], part[begin]
        self.low, self.high = place[begin] % step[begin], place[stop - 1] % step[begin] if len(begin) else place
        self.keys, self.first, self.n = np.unique(every[begin], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[slot(self.keys)] = True

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its hits: (item_id, start, end, edits)."""
        texts = [normal(t) for t in texts]
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size < STEP_CHARS):
                size += len(texts[b]) + 1
                b += 1
            self._search(texts, a, b, out)
            a = b
        return out

    def _search(self, texts: list[str], a: int, b: int, out: list) -> None:
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        c = codes("\0".join(texts[a:b]))
        h = gram_hashes(c, self.q)
        at = np.flatnonzero(self.table[slot(h)]) if len(h) else np.empty(0, np.int64)
        if len(at) and len(self.keys):
            k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            real = self.keys[k] == h[at]
            at, k = at[real], k[real]
            doc = np.searchsorted(begins, at, side="right") - 1
            self._bands(texts, a, doc, at - begins[doc], k, out)
        for k in self.short:
            t = self.texts[k]
            for d in range(a, b) if t else ():
                if (s := texts[d].find(t)) >= 0:
                    out[d].append((self.ids[k], s, s + len(t), 0))

    def _windows(self, doc: np.ndarray, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of document, item and band, and how many places of the document share a q-gram there."""
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        n = self.n[k]
        total = np.cumsum(n)
        cut = [0]
        while cut[-1] < len(n):
            done = total[cut[-1] - 1] if cut[-1] else 0
            cut.append(max(cut[-1] + 1, int(np.searchsorted(total, done + STEP_MATCHES, side="right"))))
        for x, y in zip(cut, cut[1:], strict=False):
            m = n[x:y]
            own = np.repeat(np.arange(x, y), m)
            post = np.repeat(self.first[k[x:y]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            item = self.item[post]
            step = self.edits[item] + 1
            block, rest = at[own] // step - self.part[post], at[own] % step
            # the diagonals at - place fall into one band for the places up to ``rest``, into the one below for the others
            upper, lower = self.low[post] <= rest, self.high[post] > rest
            base = (doc[own] * len(self.ids) + item) << 28
            rows = np.concatenate([base[upper] + block[upper], base[upper] + block[upper] - 1, base[lower] + block[lower] - 1, base[lower] + block[lower] - 2]) + (1 << 27)
            who = np.concatenate([own[upper], own[upper], own[lower], own[lower]])
            order = np.lexsort((who, rows))
            rows, who = rows[order], who[order]
            once = np.ones(len(rows), bool)
            once[1:] = (rows[1:] != rows[:-1]) | (who[1:] != who[:-1])
            got, c = np.unique(rows[once], return_counts=True)
            keys, back = np.unique(np.concatenate([keys, got]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, c]), len(keys)).astype(np.int64)
        return keys, counts

    def _bands(self, texts: list[str], a: int, doc: np.ndarray, at: np.ndarray, k: np.ndarray, out: list) -> None:
        keys, counts = self._windows(doc, at, k)
        both, band = keys >> 28, (keys & ((1 << 28) - 1)) - (1 << 27)
        rows = np.stack([both // len(self.ids), both % len(self.ids), band], 1)
        rows = rows[counts >= self.least[rows[:, 1]]]
        aligned: dict[tuple[int, bytes], tuple[int, int]] = {}
        whole: tuple[int, np.ndarray] = (-1, np.empty(0, np.int64))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, k, g in rows.tolist():
            text, t, e = texts[a + d], self.texts[k], int(self.edits[k])
            if best.get((d, k), (1,))[0] == 0:
                continue  # bands come in order, so an unchanged one before stands first
            low, high = g * (e + 1) - e, (g + 2) * (e + 1) + e
            s = text.find(t, max(low, 0), max(high, 0) + len(t))
            if s >= 0:
                got = (0, s, s + len(t))
            else:
                if whole[0] != d:
                    whole = (d, codes(text).astype(np.int64))
                edits, end = self._aligned(k, whole[1], low, high, aligned)
                if edits > e:
                    continue
                _, stop = banded(codes(t)[::-1].astype(np.int64), codes(text[:end])[::-1].astype(np.int64), -edits, edits, pinned=True)
                got = (edits, end - stop, end)
            if (d, k) not in best or got < best[d, k]:
                best[d, k] = got
        for (d, k), (edits, start, end) in sorted(best.items()):
            out[a + d].append((self.ids[k], start, end, edits))


    def _aligned(self, k: int, c: np.ndarray, low: int, high: int, known: dict) -> tuple[int, int]:
        """``banded`` of an item; stretches inside a text that are equal are aligned once."""
        t = codes(self.texts[k]).astype(np.int64)
        stop = low + len(t) + high - low + 1
        if low < 0 or stop > len(c):
            return banded(t, c, low, high)
        part = c[low:stop]
        key = (k, part.tobytes())
        if key not in known:
            if len(known) > 1000:
                known.clear()
            known[key] = banded(t, part, 0, high - low)
        edits, end = known[key]
        return edits, end + low


def blocks_of(benchmark: DataFrame, size: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    held, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).toLocalIterator():
        t = normal(r["text"])
        if held and n + len(t) > size:
            yield held
            held, n = [], 0
        held.append((r["item_id"], t))
        n += len(t)
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item that it holds: the place in the normalised text and the edits."""
    batch_rows(docs.sparkSession)
    spark, rows = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    parts = []
    for block in blocks_of(benchmark, block_chars):
        index = spark.sparkContext.broadcast(Index(block, q, rate))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = index.value.find(b.column(1).to_pylist())
                ids = b.column(0).to_pylist()
                got = [(ids[d], *x) for d, xs in enumerate(hits) for x in xs]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "item_id", "start", "end", "edits"])

        parts = [stash(p, "leaks") if k == len(parts) - 1 else p for k, p in enumerate(parts)] + [rows.mapInArrow(search, HIT)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], HIT)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no benchmark item, all their columns."""
    for n, block in enumerate(blocks_of(benchmark, block_chars)):
        docs = (stash(docs, "clean") if n else docs).filter(clean(docs.sparkSession, Index(block, q, rate))(text_of()))
    return docs


def clean(spark: SparkSession, index: Index):
    """Whether texts hold no item of the index, as a column function."""
    batch_rows(spark)
    held = spark.sparkContext.broadcast(index)

    @F.pandas_udf("boolean")
    def check(text: pd.Series) -> pd.Series:
        return pd.Series([not x for x in held.value.find(list(text))])

    return check


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
