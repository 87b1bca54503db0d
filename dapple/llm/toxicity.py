"""Toxicity by weak supervision.

Voters are lexicons and patterns. Lexicons are mined from labelled documents: words and word
beginnings whose documents are toxic far more often than others; words and beginnings of each length
make up voters by the strength of their odds. The other patterns are a short general word list, several different hits, and shouting. Every
document, labelled or not, is voted on, and the vote patterns are counted; there are at most
2 ** ``N_VOTERS`` of them.

A generative label model with two latent classes is fitted to these counts by expectation
maximisation and sees no label: how often each voter fires in either class, and which voters depend on
each other given the class. The dependences are a tree over the voters, the one of greatest
conditional mutual information, found anew as the classes become clear; a voter's evidence is given
the vote of its parent, so voters that say the same count once. Labels set the share of toxic
documents that it starts from, and a line on its log odds that calibrates them. The posterior labels
of a sample of documents train a logistic regression over the lexicon hits, and that scores every
whole text.

At most about ``SAMPLE`` labelled rows, drawn by a hash of id and text, are mined and calibrate, and at
most about ``SAMPLE`` documents train the regression: half of them with votes and half without,
weighted back. The lexicon holds all significant entries of the mined rows, of whose number ``SAMPLE`` is
the bound. Votes and scores are a pass over the documents each, without a shuffle of texts.

Defined cases: null and empty texts score the model's base rate; rows without a label, with a null
doc_id, or held out teach no label; a doc_id labelled both ways counts as what it is more often, as
unlabelled in a tie; without any usable label the general word list alone decides; repeated rows score
alike and count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.llm.common import batch_rows, discard, held_out, stash, table, text_of

SAMPLE = 20_000
BEGINNINGS = (4, 5, 6)
#: Log odds from which an entry counts as very strong, strong, and at all.
TIERS = (5.5, 4.5, 3.5)
#: Distinct entries that a task gathers before it gives them on.
FLUSH = 150_000
THRESHOLD = 0.3
#: A dependence of two voters is kept from this test statistic on (chi-squared, two degrees of freedom).
DEPENDS = 18.4
#: A short general list, for corpora without labels and as a voter of its own.
GENERAL = ("idiot", "moron", "stupid", "scum", "trash", "pathetic", "worthless", "loser", "clown", "disgusting")
_WORD = re.compile(r"[^\W\d_]+")


def hits_of(text: str) -> set[str]:
    """Distinct words, and beginnings of longer words marked by a star."""
    words = set(_WORD.findall(text.lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in BEGINNINGS))


def entries_in(text: str, lexicon: dict[str, int]) -> dict[str, int]:
    """The entries that a text holds, with their tiers."""
    return {x: lexicon[x] for x in hits_of(text) & lexicon.keys()}


def voter_of(entry: str, tier: int) -> int:
    """Which voter a lexicon entry of some tier belongs to."""
    kind = 0 if entry[-1] != "*" else 1 + BEGINNINGS.index(len(entry) - 1)
    return kind * len(TIERS) + tier


#: Lexicon voters, then: general list, 2 and 3 different hits, shouting.
N_LEXICONS = len(TIERS) * (1 + len(BEGINNINGS))
N_VOTERS = N_LEXICONS + 4


def votes(text: str, found: dict[str, int]) -> int:
    """The voters that fire, as bits, on a text with the lexicon entries ``found`` and their tiers."""
    mask = 0
    for entry, tier in found.items():
        mask |= 1 << voter_of(entry, tier)
    words = {x for x in found if x[-1] != "*"}
    stems = {x[: BEGINNINGS[0]] for x in found}
    letters, capitals = sum(map(str.isalpha, text)), sum(map(str.isupper, text))
    fires = (any(g in words for g in GENERAL), len(stems) >= 2, len(stems) >= 3, letters > 50 and capitals > letters // 2)
    for k, x in enumerate(fires):
        mask |= int(x) << (N_LEXICONS + k)
    return mask


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of about ``sample`` labelled rows at most that are not held out."""
    said = F.avg(F.col("toxic").cast("int"))
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(4)).groupBy("doc_id").agg(said.alias("said")).filter("said <> 0.5")
    usable = stash(usable.select(F.col("doc_id").alias("id"), (F.col("said") > 0.5).cast("int").alias("toxic")), "toxicity-labels")
    rows = docs.select("doc_id", text_of().alias("text")).join(usable, F.col("doc_id") == F.col("id"))
    n = docs.select("doc_id").join(usable, F.col("doc_id") == F.col("id")).count()
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    return rows.select("text", "toxic")


def mine(rows: DataFrame) -> dict[str, int]:
    """All significant entries with their tiers by the strength of their association, and the general list.

    An entry is in from a log likelihood ratio on at which, by chance, about one in seven corpora would have
    one of all entries that were counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(pos.keys() | neg.keys())
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({"entry": part, "pos": [pos[k] for k in part], "neg": [neg[k] for k in part]})
            pos.clear()
            neg.clear()

        for b in batches:
            for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                (pos if toxic else neg).update(hits_of(text))
                (pos if toxic else neg)[""] += 1
            if len(neg) > FLUSH:
                yield from out()
        yield from out()

    counts = stash(rows.mapInArrow(count, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("pos >= 3 OR entry = ''"), "toxicity-counts")
    every = counts.filter("entry = ''").first()
    if every is None or not every["pos"] or not every["neg"]:
        return dict.fromkeys(GENERAL, 0)
    pos, neg, p, n = F.col("pos"), F.col("neg"), float(every["pos"]), float(every["neg"])
    odds = F.log((pos + 0.5) / (p + 1.0)) - F.log((neg + 0.5) / (n + 1.0))
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    both, all_ = pos + neg, p + n
    ratio = 2 * (term(pos, both * p / all_) + term(neg, both * n / all_) + term(p - pos, (all_ - both) * p / all_) + term(n - neg, (all_ - both) * n / all_))
    least = 2 * math.log(max(2, counts.count())) + 4
    best = counts.filter("entry <> ''").withColumn("odds", odds).withColumn("ratio", ratio).filter((F.col("odds") >= TIERS[-1]) & (F.col("ratio") >= least)).orderBy(F.col("ratio").desc(), "entry")
    found = {r["entry"]: next(i for i, t in enumerate(TIERS) if r["odds"] >= t) for r in best.select("entry", "odds").collect()}
    return dict.fromkeys(GENERAL, 0) | found


@dataclass
class LabelModel:
    """Two latent classes over votes, and a tree of dependences between the voters.

    ``prior`` is the share of the toxic class, ``rates[y, i]`` how often voter i fires in class y,
    ``parent[i]`` the voter that i depends on (-1: none), ``given[y, a, i]`` how often i fires where its
    parent voted a, ``depends[i]`` the correlation of i and its parent within the classes.
    """

    prior: float
    rates: np.ndarray
    parent: np.ndarray
    given: np.ndarray
    depends: np.ndarray

    def log_odds(self, fires: np.ndarray) -> np.ndarray:
        out = np.full(len(fires), np.log(self.prior / (1 - self.prior)))
        for i, p in enumerate(self.parent):
            a = np.zeros(len(fires), int) if p < 0 else fires[:, p].astype(int)
            g1, g0 = self.given[1, a, i], self.given[0, a, i]
            out += np.where(fires[:, i] > 0, np.log(g1 / g0), np.log((1 - g1) / (1 - g0)))
        return out


def fires_of(masks: np.ndarray, voters: int = N_VOTERS) -> np.ndarray:
    return ((masks[:, None] >> np.arange(voters)) & 1).astype(float)


def best_tree(gain: np.ndarray) -> np.ndarray:
    """Parents of a spanning forest of greatest gain; edges without gain are left out."""
    n = len(gain)
    parent, inside = np.full(n, -1), np.zeros(n, bool)
    reach, by = np.zeros(n), np.full(n, -1)
    for _ in range(n):
        at = int(np.where(inside, -np.inf, reach).argmax())
        inside[at] = True
        parent[at] = by[at] if reach[at] > 0 else -1
        better = ~inside & (gain[at] > reach)
        reach[better], by[better] = gain[at][better], at
    return parent


def maximised(fires: np.ndarray, weight: np.ndarray, q: np.ndarray) -> LabelModel:
    """The model that fits the votes best, given how toxic each pattern is."""
    n_voters = fires.shape[1]
    mass = [float((weight * (1 - q)).sum()), float((weight * q).sum())]
    rates, tables, gain, cov = np.empty((2, n_voters)), [], np.zeros((n_voters, n_voters)), np.zeros((n_voters, n_voters))
    for y, w in enumerate((weight * (1 - q), weight * q)):
        one = w @ fires
        both = (fires * w[:, None]).T @ fires
        rates[y] = (one + 0.5) / (mass[y] + 1)
        # how often two voters vote (1,1), (1,0), (0,1), (0,0)
        cells = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both, (0, 0): mass[y] - one[:, None] - one[None, :] + both}
        tables.append((one, cells))
        for (a, b), n in cells.items():
            pa, pb = (rates[y] if a else 1 - rates[y])[:, None], (rates[y] if b else 1 - rates[y])[None, :]
            share = np.maximum(n, 0) / max(mass[y], 1e-9)
            gain += 2 * np.maximum(n, 0) * np.log(np.where(share > 0, share, 1) / np.where(share > 0, pa * pb, 1))
        cov += both - np.outer(one, one) / max(mass[y], 1e-9)
    np.fill_diagonal(gain, 0)
    parent = best_tree(np.where(gain > DEPENDS, gain, 0))
    given = np.repeat(rates[:, None, :], 2, axis=1)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    depends = np.zeros(n_voters)
    for i, p in enumerate(parent):
        if p >= 0:
            depends[i] = cov[p, i] / (sd[p] * sd[i])
            for y, (one, cells) in enumerate(tables):
                for a in (0, 1):
                    given[y, a, i] = (cells[a, 1][p, i] + rates[y, i]) / ((one[p] if a else mass[y] - one[p]) + 1)
    given = np.clip(given, 1e-6, 1 - 1e-6)
    return LabelModel(min(max((mass[1] + 1) / (sum(mass) + 2), 1e-6), 1 - 1e-6), rates, parent, given, depends)


def label_model(fires: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 100) -> LabelModel:
    """Expectation maximisation over distinct vote patterns and their counts.

    It starts from the share ``prior`` of the documents with the most votes being toxic.
    """
    weight = counts.astype(float)
    order = np.argsort(-fires.sum(1), kind="stable")
    before = np.cumsum(weight[order]) - weight[order]
    q = np.empty(len(fires))
    q[order] = np.where(before < prior * weight.sum(), 0.9, 0.02)
    q[fires.sum(1) == 0] = 0.001
    for _ in range(rounds):
        model = maximised(fires, weight, q)
        new = 1 / (1 + np.exp(-np.clip(model.log_odds(fires), -30, 30)))
        moved, q = np.abs(new - q).max(), new
        if moved < 1e-5:
            break
    return maximised(fires, weight, q)


def calibration(log_odds: np.ndarray, toxic: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and shift of log odds by which they fit labels best, held near 1 and 0; the slope is positive."""
    slope, shift, w = 1.0, 0.0, counts.astype(float)
    x = np.clip(log_odds, -15, 15)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        r, v = w * (toxic - p), w * p * (1 - p)
        grad = np.array([(r * x).sum() - (slope - 1), r.sum() - 0.1 * shift])
        hess = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 0.5 / max(np.abs(step).max(), 1e-12))
        slope, shift = max(0.05, slope + step[0]), shift + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return slope, shift


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    base: float

    def score(self, text: str) -> float:
        """Words and beginnings of the whole text against the lexicon."""
        get, z = self.weights.get, self.base
        for x in hits_of(text):
            w = get(x)
            if w is not None:
                z += w
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def voted(docs: DataFrame, lexicon: dict[str, int]) -> DataFrame:
    """held_out, draw (a number of the row from 0 to 1), mask and hits of every document. Written out."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            found = [entries_in(t, held.value) for t in texts]
            masks = pa.array([votes(t, f) for t, f in zip(texts, found, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([b["held_out"], b["draw"], masks, pa.array([sorted(f) for f in found], pa.list_(pa.string()))], names=["held_out", "draw", "mask", "hits"])

    draw = F.pmod(F.xxhash64(F.lit(10), "doc_id", text_of()), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.select(held_out(4).alias("held_out"), draw.alias("draw"), text_of().alias("text"))
    return stash(rows.mapInArrow(vote, "held_out boolean, draw double, mask long, hits array<string>"), "toxicity-votes")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    spark = docs.sparkSession
    batch_rows(spark)
    taught = stash(labelled(docs, labels, sample), "toxicity-sample")
    prior = taught.agg(F.avg("toxic")).first()[0]
    if not prior or prior >= 1:
        discard(taught)
        return ToxicityModel(dict.fromkeys(GENERAL, 3.0), -3.0)
    lexicon = mine(taught)
    every = voted(docs, lexicon)
    patterns = every.groupBy("mask").agg(F.count("*").alias("n"), F.sum((~F.col("held_out")).cast("int")).alias("open")).toPandas().sort_values("mask")
    model = label_model(fires_of(patterns["mask"].to_numpy()), patterns["n"].to_numpy(), prior)
    known = taught.mapInArrow(votes_of_labelled(lexicon), "mask long, toxic int").groupBy("mask", "toxic").agg(F.count("*").alias("n")).toPandas().sort_values(["mask", "toxic"])
    slope, shift = calibration(model.log_odds(fires_of(known["mask"].to_numpy())), known["toxic"].to_numpy(), known["n"].to_numpy())
    z = slope * model.log_odds(fires_of(patterns["mask"].to_numpy())) + shift
    patterns["p"] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    # half of the sample has votes, half has none
    loud = patterns["mask"] != 0
    share = [min(1.0, sample / 2 / max(1, int(patterns["open"][x].sum()))) for x in (~loud, loud)]
    posterior = spark.createDataFrame(patterns[["mask", "p"]], "mask long, p double")
    keep = F.when(F.col("mask") == 0, share[0]).otherwise(share[1])
    drawn = every.filter(~F.col("held_out")).filter(F.col("draw") < keep).join(F.broadcast(posterior), "mask").withColumn("w", 1 / keep)
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight"))))
    train = stash(drawn.select("hits", "w", sides.alias("s")).select("hits", "s.label", (F.col("w") * F.col("s.weight")).alias("weight")).filter("weight > 1e-4"), "toxicity-train")
    counted = CountVectorizerModel.from_vocabulary(sorted(lexicon), inputCol="hits", outputCol="features")
    got = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50, standardization=False).fit(counted.transform(train))
    w = got.coefficients.toArray()
    discard(taught, every, train)
    return ToxicityModel({x: float(w[i]) for i, x in enumerate(sorted(lexicon)) if w[i]}, float(got.intercept))


def votes_of_labelled(lexicon: dict[str, int]):
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = [votes(t, entries_in(t, lexicon)) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(masks, pa.int64()), b["toxic"]], names=["mask", "toxic"])

    return vote


def score_documents(docs: DataFrame, model: ToxicityModel, columns: list[str]) -> DataFrame:
    """``columns`` of every document, its score and whether that reaches the threshold."""
    batch_rows(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return text.map(held.value.score).astype("float64")

    return docs.select(*[F.col(f"`{c}`") for c in columns], score(text_of()).alias("_score")).withColumn("_predicted", (F.col("_score") >= THRESHOLD).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score_documents(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(4).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, all their columns."""
    return score_documents(docs, fit(docs, labels), docs.columns).filter("_predicted = 0").drop("_score", "_predicted")
