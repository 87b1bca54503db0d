"""Language model scores from a probabilistic suffix tree over words.

Symbols are the words of at least some number of training tokens, one symbol for all rarer words, and the
end of a text. Contexts are the last one, two, ... symbols within the text, up to ``depth``. A context of
enough occurrences becomes a state if its next-symbol distribution diverges from that of the context one
symbol shorter: if, each occurrence left out of its own count, its smoothed distribution gives the symbols
that follow it ``GAIN`` nats more. Suffixes of states are states. What follows a state often enough has a
probability of its own; the rest of the state's mass, and a part in proportion to the number of different
symbols seen, goes by the shorter context's distribution, so each distribution sums to one. A token is
scored in the longest state that is a suffix of what precedes it; a rare word then has its discounted share
of the rare symbol, and what the discount frees is the share of unknown words, taken together as one as in
the base score.

How many occurrences are enough grows with the square root of the training tokens (``Least``): the tree
grows with the corpus, though slower. Tasks get its contexts whole, and its pairs by what follows, at most
``TREE_PAIRS`` or one symbol's at a time: whatever state a token is scored in, the pairs that matter have
the token's symbol, so a pass for each part of the symbols scores each token once, with the whole tree's
result. Texts become symbols once, in the first pass; levels and scores read those. Word counts and the
counts of each level come from all training texts. The words that are broadcast with their counts have at least
``COMMON_SHARE`` of all tokens, so there are 1 / COMMON_SHARE at most; other words meet their counts in a
join. Word keys are 64-bit hashes.

Defined cases: null and empty texts have the end alone; a null doc_id counts as '' in the split and
keeps its row; repeated rows count and score each; without training texts N and V are 0, nothing is
known and each token halves the score; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.llm.common import batch_rows, discard, held_out, stash, table, text_of
from dapple.llm.neardup import in_blocks, word_hashes

DEPTH = 5
#: Pairs that tasks hold at a time.
TREE_PAIRS = 4_000_000
GAIN = 5.0
COMMON_SHARE = 2.5e-7
DISCOUNT = 0.75
#: Distinct entries that a task gathers before it gives them on.
FLUSH = 400_000
END, RARE, FIRST_WORD = 0, 1, 2
BITS = 24
_U = np.uint64


@dataclass(frozen=True)
class Least:
    """Occurrences of a symbol, a state, and a pair of a state and what follows, in a million training tokens."""

    symbol: float = 40.0
    state: float = 200.0
    pair: float = 4.0

    def of(self, total: int) -> tuple[float, float, float]:
        """Bounds for ``total`` tokens: as the square root of their number, 2 at least."""
        by = math.sqrt(total / 1e6)
        return max(2.0, self.symbol * by), max(2.0, self.state * by), max(2.0, self.pair * by)


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n) over all texts of ``rows``; the end is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(seen)
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                yield pa.RecordBatch.from_pydict({"word": pa.array(part, pa.binary()), "n": pa.array([seen[k] for k in part], pa.int64())})
            seen.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(t.encode().lower().split())
                seen[b""] += 1
                if len(seen) > FLUSH:
                    yield from out()
        yield from out()

    return rows.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hashed(words: DataFrame) -> DataFrame:
    """(h, n) of every training word but the end."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h, _, _ = word_hashes(np.frombuffer(b" ".join(b.column(0).to_pylist()), np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), b.column(1)], names=["h", "n"])

    return words.filter(F.length("word") > 0).select("word", "n").mapInArrow(make, "h long, n long")


def place_in(have: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys are in a sorted array, and whether they are."""
    if not len(have):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    i = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return i, have[i] == keys


@dataclass
class Tree:
    """What tasks need to follow the tree.

    A context of k symbols is numbered by its place in ``contexts[k]``, sorted keys of its oldest
    symbol and the number of the rest; contexts of one symbol are numbered by the symbol. By level,
    ``seen`` holds sorted keys of (context, next symbol) and log10 p, ``states`` the log10 weight of
    the shorter context for each context, not a number where it is no state.
    """

    symbols: np.ndarray
    root: np.ndarray
    #: Symbols frequent enough to be contexts.
    candidates: np.ndarray
    contexts: list[np.ndarray] = field(default_factory=lambda: [np.empty(0, np.int64), np.empty(0, np.int64)])
    seen: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    states: list[np.ndarray] = field(default_factory=list)

    def sequence(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of a block of texts: word hashes, the texts they are in, all symbols with ends, whether a symbol is a word."""
        raw = np.frombuffer(b" ".join(t.lower() for t in texts), np.uint8)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        h, start, _ = word_hashes(raw) if len(raw) else (np.empty(0, _U), np.empty(0, np.int64), None)
        doc = np.searchsorted(begins, start, side="right") - 1
        i, hit = place_in(self.symbols, h)
        s = np.full(len(h) + len(texts), END, np.int64)
        at = np.arange(len(h)) + doc
        s[at] = np.where(hit, i + FIRST_WORD, RARE)
        word = np.zeros(len(s), bool)
        word[at] = True
        return h, doc, s, word

    def contexts_of(self, s: np.ndarray, depth: int, mine: np.ndarray | None = None) -> list[np.ndarray]:
        """For each symbol the number of its context by length; -1 where there is none, or it is not ``mine``. Texts start after an end."""
        before = np.concatenate([[END], s[:-1]])
        out = [np.zeros(len(s), np.int64), before]
        older = before
        # a longer context ends in a symbol that is one itself
        able = self.candidates[before] if mine is None else self.candidates[before] & mine
        for k in range(2, depth + 1):
            able &= older != END  # a context does not reach beyond the start of its text
            older = np.concatenate([[END], older[:-1]])
            at = np.flatnonzero(able)
            i, hit = place_in(self.contexts[k], (older[at] << BITS) | out[-1][at])
            able[at[~hit]] = False
            out.append(np.full(len(s), -1))
            out[-1][at[hit]] = i[hit]
        return out

    def log_p(self, s: np.ndarray, mine: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each symbol, or 0 where it is not ``mine``, in its longest state."""
        out, open_ = np.zeros(len(s)), np.arange(len(s)) if mine is None else np.flatnonzero(mine)
        contexts = self.contexts_of(s, len(self.states), mine)
        for k in range(len(self.states), 0, -1):
            c = contexts[k][open_]
            weight = np.where(c >= 0, self.states[k - 1][np.maximum(c, 0)], np.nan)
            in_state = ~np.isnan(weight)
            at = open_[in_state]
            i, hit = place_in(self.seen[k - 1][0], (c[in_state] << BITS) | s[at])
            out[at[hit]] += self.seen[k - 1][1][i[hit]]
            out[at[~hit]] += weight[in_state][~hit]
            open_ = np.concatenate([open_[~in_state], at[~hit]])
        out[open_] += self.root[s[open_]]
        return out


def symbol_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of texts' symbols: how many texts, and their symbols one after the other."""
    for block in in_blocks(column.to_pylist()):
        yield len(block), np.frombuffer(b"".join(block), np.int32).astype(np.int64)


def count_level(rows: DataFrame, tree: Tree, k: int) -> DataFrame:
    """(context, next, n) for the candidate contexts of k symbols."""
    held = rows.sparkSession.sparkContext.broadcast(tree)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([x for _, x in parts]), len(keys)).astype(np.int64)

        def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"context": pa.array(keys >> BITS), "next": pa.array(keys & ((1 << BITS) - 1)), "n": pa.array(n)})

        for b in batches:
            for _, s in symbol_blocks(b.column(0)):
                c = held.value.contexts_of(s, k)[k]
                own = held.value.candidates[c] if k == 1 else c >= 0
                parts.append(np.unique((c[own] << BITS) | s[own], return_counts=True))
                if sum(len(x) for x, _ in parts) > 2 * FLUSH:
                    parts = [merged()]
                    if len(parts[0][0]) > FLUSH:
                        yield out(*parts.pop())
        if parts:
            yield out(*merged())

    return rows.select("symbols").mapInArrow(count, "context long, next long, n long").groupBy("context", "next").agg(F.sum("n").alias("n"))


def root_of(words: DataFrame, total: int, ends: int, bounds: Least) -> Tree:
    """The tree's symbols and their shares, from (h, n) of the training words."""
    least_symbol, least, _ = bounds.of(total)
    top = words.filter(F.col("n") >= least_symbol).toArrow()
    h, n = top.column("h").to_numpy().astype(_U), top.column("n").to_numpy()
    order = np.argsort(h)
    counts = np.concatenate([[ends, total - ends - n.sum()], n[order]]).astype(float)
    counts[:FIRST_WORD] += 1
    return Tree(h[order], np.log10(counts / counts.sum()), counts >= least)


def grow(rows: DataFrame, tree: Tree, total: int, depth: int = DEPTH, bounds: Least | None = None, gain: float = GAIN) -> DataFrame:
    """Grows contexts and states, level by level, from the symbols of the training texts; returns the pairs of
    the states, (level, context, next, p), as a written table."""
    spark = rows.sparkSession
    _, least, least_pair = (bounds or Least()).of(total)
    n_symbols = len(tree.root)
    shorter = F.broadcast(spark.createDataFrame(pa.table({"next": np.arange(n_symbols), "below": 10**tree.root})))
    levels = []
    for k in range(1, depth + 1):
        grams = stash(count_level(rows, tree, k), "tree-counts")
        sums = stash(grams.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter(F.col("total") >= least), "tree-sums")
        if k > 1 and sums.isEmpty():
            discard(grams, sums)
            break
        got = grams.join(F.broadcast(sums), "context")
        if k == 1:
            got = got.join(shorter, "next")
        else:
            codes = tree.contexts[k]
            parents = F.broadcast(spark.createDataFrame(pa.table({"context": np.arange(len(codes)), "parent": codes & ((1 << BITS) - 1)})))
            got = got.join(parents, "context").join(levels[-1].select(F.col("context").alias("parent"), "next", F.col("p").alias("below")), ["parent", "next"])
        kinds, below, often = F.col("kinds"), F.col("below"), F.col("n") >= least_pair
        rest = F.broadcast(grams.filter(often).groupBy("context").agg(F.sum("n").alias("kept")))
        got = got.join(rest, "context", "left").withColumn("weight", (F.col("total") + kinds - F.coalesce("kept", F.lit(0))) / (F.col("total") + kinds))
        got = got.withColumn("p", F.when(often, F.col("n") / (F.col("total") + kinds)).otherwise(0.0) + F.col("weight") * below)
        left_out = (F.col("n") - 1 + kinds * below) / (F.col("total") - 1 + kinds)
        level = stash(got.withColumn("gain", F.col("n") * F.log(left_out / below)).withColumn("often", often), "tree-level")
        discard(grams, sums)
        levels.append(level)
        if k < depth:
            more = level.filter((F.col("n") >= least) & (F.col("next") != END)).select("context", "next").toArrow()
            # one symbol longer: the context's oldest symbol becomes older than what follows it
            code = longer(tree, k, more.column("context").to_numpy(), more.column("next").to_numpy())
            tree.contexts.append(np.unique(code))
            if not len(code):
                break
    keep: np.ndarray | None = None
    pairs = []
    for k in range(len(levels), 0, -1):
        tested = levels[k - 1].groupBy("context").agg(F.sum("gain").alias("gain"), F.first("weight").alias("weight")).toArrow()
        c, weight = tested.column("context").to_numpy(), tested.column("weight").to_numpy()
        good = tested.column("gain").to_numpy() >= gain
        if keep is not None:
            good |= np.isin(c, tree.contexts[k + 1][keep] & ((1 << BITS) - 1))
        keep = c[good]
        state = np.full(max(n_symbols if k == 1 else len(tree.contexts[k]), 1), np.nan)
        state[keep] = np.log10(weight[good])
        names = F.broadcast(spark.createDataFrame(pa.table({"context": pa.array(keep, pa.int64())})))
        pairs.append(levels[k - 1].filter("often").join(names, "context").select(F.lit(k).alias("level"), "context", "next", "p"))
        tree.states.insert(0, state)
    out = stash(reduce(DataFrame.unionAll, pairs), "tree-pairs")
    discard(*levels)
    return out


def part_of(pairs: DataFrame, part: int, parts: int, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By level the sorted keys and log10 p of the pairs whose next symbol is of a part."""
    key = (F.shiftleft("context", BITS) + F.col("next")).alias("key")
    got = pairs.filter(F.col("next") % parts == part).select("level", key, F.log10("p").alias("p")).toArrow()
    level, key, p = (got.column(x).to_numpy() for x in ("level", "key", "p"))
    order = np.lexsort((key, level))
    ends = np.searchsorted(level[order], np.arange(1, levels + 2))
    return [(key[order[a:b]], p[order[a:b]]) for a, b in zip(ends, ends[1:])]


def longer(tree: Tree, k: int, context: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Codes of the contexts of k + 1 symbols that (context, following) make, where their suffix is a candidate."""
    symbols = [following]
    c = context
    for j in range(k, 1, -1):
        code = tree.contexts[j][c]
        symbols.append(code >> BITS)
        c = code & ((1 << BITS) - 1)
    # oldest first: the symbols of the context from old to new, then what followed
    names = [*symbols[1:], c]
    number = following
    for j in range(2, k + 1):
        i, hit = place_in(tree.contexts[j], (names[len(names) - j + 1] << BITS) | number)
        number = np.where(hit, i, -1)
    ok = (number >= 0) & (names[0] != END if k == 1 else True)
    return (names[0][ok] << BITS) | number[ok]


@dataclass(frozen=True)
class Counts:
    """N, V, count of the end, the tree, common words by hash with their counts, and what rare words share."""

    n: int
    v: int
    ends: int
    tree: Tree
    common: np.ndarray
    count: np.ndarray
    rare_tokens: int
    rare_kinds: int


def rare_share(n: np.ndarray, c: Counts) -> np.ndarray:
    """log10 of a rare word's share of the rare symbol; n = 0: of all unknown words."""
    if not c.rare_tokens:
        return np.zeros(len(n))
    return np.log10(np.where(n > 0, n - DISCOUNT, DISCOUNT * c.rare_kinds) / c.rare_tokens)


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
FIRST = f"{SCORED}, rest array<struct<h:long,tf:int>>, symbols binary"


def first_pass(rows: DataFrame, counts: Counts) -> DataFrame:
    """Sums over each text's common words, the rest of its words with their counts in the text, and its symbols."""
    held = rows.sparkSession.sparkContext.broadcast(counts)

    def score(texts: list[bytes]) -> tuple[list, ...]:
        c, n = held.value, len(texts)
        h, doc, s, word = c.tree.sequence(texts)
        i, hit = place_in(c.common, h)
        i, d = i[hit], doc[hit]
        least = np.log10(c.n + c.v + 1)
        tokens = np.bincount(doc, minlength=n) + 1
        known = np.bincount(d, minlength=n) + (c.ends > 0)
        base = np.bincount(d, np.log10(c.count[i] + 1.0) - least, n) + np.log10(c.ends + 1.0) - least
        rare = s[word][hit] == RARE
        total = np.bincount(d[rare], rare_share(c.count[i[rare]], c), n).astype(float)
        other = np.flatnonzero(~hit)
        other = other[np.lexsort((h[other], doc[other]))]
        first = np.flatnonzero(np.concatenate([[True], (h[other][1:] != h[other][:-1]) | (doc[other][1:] != doc[other][:-1])])) if len(other) else other
        tf = np.diff(np.append(first, len(other)))
        at = other[first]
        flat = pa.StructArray.from_arrays([pa.array(h[at].astype(np.int64)), pa.array(tf, pa.int32())], names=["h", "tf"])
        rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[at], np.arange(n + 1)), pa.int32()), flat)
        begins = np.concatenate([[0], np.cumsum(tokens)]).astype(np.int32) * np.int32(4)
        symbols = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(begins), pa.py_buffer(s.astype(np.int32))])
        return tokens, known, base, total, rest, symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at = [t.encode() for t in b.column(3).to_pylist()], 0
            for block in in_blocks(texts):
                part = b.slice(at, len(block))
                tokens, known, base, total, rest, symbols = score(block)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(total), rest, symbols], names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest", "symbols"])
                at += len(block)

    return rows.mapInArrow(run, FIRST)


def tree_pass(rows: DataFrame, tree: Tree, part: int, parts: int) -> DataFrame:
    """``rows`` of ``first_pass`` without the rest, their scores with those of the symbols of a part of the tree added."""
    held = rows.sparkSession.sparkContext.broadcast(tree)
    last = part == parts - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [np.empty(0)]
            for n, s in symbol_blocks(b.column(7)):
                p = held.value.log_p(s, s % parts == part if parts > 1 else None)
                sums.append(np.bincount(np.cumsum(s == END) - (s == END), p, n))
            score = pa.array(b.column(6).to_numpy() + np.concatenate(sums))
            columns = [*b.columns[:6], score, *b.columns[7:]]
            yield pa.RecordBatch.from_arrays(columns[: 7 if last else 8], names=b.schema.names[: 7 if last else 8])

    return rows.drop("rest").mapInArrow(run, SCORED if last else f"{SCORED}, symbols binary")


def score_documents(docs: DataFrame, depth: int = DEPTH, bounds: Least | None = None, gain: float = GAIN) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    bounds = bounds or Least()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held_out(7).alias("held_out"), text_of().alias("text"))
    batch_rows(docs.sparkSession)
    train = rows.filter(~F.col("held_out"))
    words = stash(count_words(train), "lm-words")
    total, kinds, ends = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.length("word") == 0, F.col("n"))), F.lit(0))).first()
    known = stash(hashed(words), "lm-lookup")
    tree = root_of(known, total, ends, bounds)
    common = known.filter(F.col("n") >= max(2.0, COMMON_SHARE * total)).toArrow()
    h, n = common.column("h").to_numpy().astype(_U), common.column("n").to_numpy()
    order = np.argsort(h)
    rare = known.filter(F.col("n") < bounds.of(total)[0]).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    counts = Counts(total, kinds, ends, tree, h[order], n[order], rare[0], rare[1])
    coded = stash(first_pass(rows, counts), "lm-first")
    pairs = grow(coded.filter(~F.col("held_out")), tree, total, depth, bounds, gain)
    parts = max(1, -(-pairs.count() // TREE_PAIRS))
    first = coded
    for part in range(parts):
        tree.seen = part_of(pairs, part, parts, len(tree.states))
        spent, first = first, stash(tree_pass(first, tree, part, parts), "lm-scores")
        if part:
            discard(spent)
    discard(pairs)
    rest = coded.select("rid", F.explode("rest").alias("r")).select("rid", F.col("r.h").alias("h"), F.col("r.tf").alias("tf"))
    least = float(np.log10(total + kinds + 1))
    new, one = (float(x) for x in rare_share(np.array([0, 1]), counts))
    seen = F.coalesce("n", F.lit(0))
    share = F.when(seen == 0, new).otherwise(F.log10(F.greatest(seen - DISCOUNT, F.lit(DISCOUNT / 4))) + (one - float(np.log10(1 - DISCOUNT)))) if counts.rare_tokens else F.lit(0.0)
    met = rest.join(known, "h", "left")
    met = met.groupBy("rid").agg(F.sum(F.when(seen > 0, F.col("tf")).otherwise(0)).alias("known2"), F.sum(F.col("tf") * (F.log10(seen + 1.0) - least)).alias("base2"), F.sum(F.col("tf") * share).alias("score2"))
    out = first.join(met, "rid", "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", add("n_known", "known2").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), add("base", "base2").alias("base_score"), add("score", "score2").alias("score"))


def op2_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
