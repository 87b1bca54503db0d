"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers; these are the
seeds. Every candidate (a run of digits and their separators, or a token with an @) has up to three
lexical patterns: its two left words, its left word, its left and right word. The graph of distinct
(pattern, candidate) edges is then scored in rounds, for each kind: a pattern's confidence is the
sum of the scores of its candidates over their number (plus one), a candidate's score is the noisy-or
of its patterns. Patterns below ``min_confidence`` or with fewer than ``min_support`` scored
candidates count for nothing. Rounds go on until the patterns that count stay as they are, to a thousandth
of their confidence. Candidates outside the base spans whose score reaches ``accept`` and whose form fits
the kind become spans too; base spans always stay.

Copies of a text add no evidence, as edges are distinct. Sums over a frequent pattern are aggregated
before the shuffle, joins on it may be split by the skew join. Contexts reach ``CONTEXT`` characters.

Defined cases: null and empty texts have no spans; a null doc_id and repeated rows keep a result row
each; an empty table gives an empty result; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.llm.common import discard, stash, table, text_of

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Possessive groups and the anchors before them leave the matches as they are and
#: keep long runs from being tried again at each character.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap sign without which a kind can't occur.
SIGN = {"email": "@", "ip": ".", "phone": "+"}
CANDIDATE = r"(?:\G|(?<![^\x20\x09-\x0D@]))[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++|(?<![0-9])[+(]{0,2}[0-9](?:[\x20().:-]{0,2}[0-9]){6,}+"
CONTEXT = 64
#: Matches of a text that are located one after the other; blocks of them are, too.
BLOCK = 64
#: Characters of a tile, by which spans of a text that may overlap are brought together.
TILE = 256


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    at = F.split(F.reverse(number), "")
    values = F.transform(at, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        return luhn(digits(s))
    if kind == "phone":
        return F.length(digits(s)).between(9, 15)
    return F.lit(True)


def located(found: Column, gaps: Column) -> Column:
    """From the matches of a pattern and what lies between them: array of (s, start, end, before, after).

    before and after are up to CONTEXT characters. Places are running sums: first over the lengths of blocks of
    matches, then within each block, so many matches in a text cost little more than few.
    """
    n = F.size(found)
    pairs = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), n).alias("b"), F.slice(gaps, F.lit(2), n).alias("a"))
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    block = lambda k: F.slice(pairs, k * BLOCK + 1, F.lit(BLOCK))
    long_ = F.transform(blocks, lambda k: F.aggregate(block(k), F.lit(0), lambda a, x: a + F.length(x["b"]) + F.length(x["m"])))
    begun = F.from_json(F.lit('{"at":0,"out":[]}'), "at int, out array<int>")
    begins = F.aggregate(long_, begun, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
    none = F.from_json(F.lit("[]"), "array<struct<s:string,start:int,end:int,before:string,after:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        one = F.struct(x["m"].alias("s"), start.alias("start"), end.alias("end"), F.right(x["b"], F.lit(CONTEXT)).alias("before"), F.left(x["a"], F.lit(CONTEXT)).alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    within = F.transform(begins, lambda at, k: F.aggregate(block(k), F.struct(at.alias("at"), none.alias("out")), step)["out"])
    return F.when(n > 0, F.flatten(within))


def matched(docs: DataFrame, rid: Column | None = None) -> DataFrame:
    """rid, doc_id, f0.. the matches of each pattern (leftmost, non-overlapping), g0.. the gaps around them.

    Selects that use a column twice are not merged, so each pattern runs once over a text, and once
    more only where it matches.
    """
    patterns = [*((BASE[k], SIGN.get(k)) for k in KINDS), (CANDIDATE, None)]
    text, found = F.col("text"), []
    for k, (pattern, sign) in enumerate(patterns):
        may = F.contains(text, F.lit(sign)) if sign else text.rlike("[0-9@]")
        found.append(F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias(f"f{k}"))
    names = [f"f{k}" for k in range(len(patterns))]
    number = F.monotonically_increasing_id() if rid is None else rid
    seen = docs.select(number.alias("rid"), "doc_id", text_of().alias("text")).select("rid", "doc_id", "text", *found)
    gaps = [F.when(F.size(f) > 0, F.split(text, p, -1)).alias(f.replace("f", "g")) for f, (p, _) in zip(names, patterns, strict=True)]
    return seen.select("rid", "doc_id", *names, *gaps)


def checked(spans: Column, k: int) -> Column:
    spans = F.filter(spans, lambda x: valid(KINDS[k], x["s"]))
    return F.transform(spans, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def patterns_of(c: Column) -> Column:
    left = F.regexp_extract_all(F.lower(c["before"]), F.lit(r"\p{L}+"), F.lit(0))
    right = F.get(F.regexp_extract_all(F.lower(c["after"]), F.lit(r"\p{L}+"), F.lit(0)), F.lit(0))
    n = F.size(left)
    one, two = F.get(left, n - 1), F.get(left, n - 2)
    return F.array_compact(F.array(F.concat(two, F.lit(" "), one, F.lit(" _")), F.concat(one, F.lit(" _")), F.concat(one, F.lit(" _ "), right)))


def fits(kind: Column, s: Column) -> Column:
    """Whether a candidate's form allows a kind."""
    n = F.length(digits(s))
    return (
        F.when(kind == 0, F.contains(s, F.lit("@")))
        .when(kind == 1, s.rlike(r"^[0-9]+(?:[.:-][0-9]+){3,7}$"))
        .when(kind == 2, ~F.contains(s, F.lit("@")) & n.between(12, 19))
        .otherwise(~F.contains(s, F.lit("@")) & n.between(7, 15))
    )


def score_patterns(edges: DataFrame, scores: DataFrame, sizes: DataFrame, min_support: int, min_confidence: float) -> DataFrame:
    """(pattern, kind, confidence) from the scored candidates (s, kind, score)."""
    got = edges.join(scores, "s").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("support"))
    rated = got.filter(F.col("support") >= min_support).join(sizes, "pattern").withColumn("confidence", F.col("mass") / (F.col("n") + 1))
    return rated.filter(F.col("confidence") >= min_confidence).select("pattern", "kind", "confidence")


def score_candidates(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    got = edges.join(patterns, "pattern").groupBy("s", "kind").agg(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))).alias("miss"))
    return got.filter(fits(F.col("kind"), F.col("s"))).select("s", "kind", (1 - F.exp("miss")).alias("score"))


def tiles(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / TILE), F.floor((end - 1) / TILE))).alias("tile")


def occurrences(rows: DataFrame) -> DataFrame:
    """rid, s, start, end, patterns of every candidate, and the kinds of the base spans within or over it.

    Spans of a text meet by the tiles they stand in, not each with each.
    """
    cand = rows.select("rid", F.explode("cand").alias("c")).select("rid", "c.*")
    spans = rows.select("rid", F.explode("base").alias("b")).select("rid", "b.kind", F.col("b.start").alias("b_start"), F.col("b.end").alias("b_end"))
    near = cand.select("rid", "start", "end", tiles(F.col("start"), F.col("end"))).join(spans.select("rid", "kind", "b_start", "b_end", tiles(F.col("b_start"), F.col("b_end"))), ["rid", "tile"])
    hits = near.filter("b_start < end AND start < b_end").groupBy("rid", "start", "end").agg(F.collect_set("kind").alias("kinds"))
    return cand.join(hits, ["rid", "start", "end"], "left")


def find_pii(docs: DataFrame, rid: Column | None = None, min_support: int = 3, min_confidence: float = 0.5, accept: float = 0.75) -> DataFrame:
    """rid (a number of the row), doc_id, base and learned spans (arrays of kind, start, end) of every row.

    ``rid`` numbers the rows; without it they are numbered as they are read. Scores only rise from round to
    round and are at most 1, so the patterns settle; rounds go on until they have.
    """
    seen = matched(docs, rid)
    spots = [located(F.col(f"f{k}"), F.col(f"g{k}")).alias(f"b{k}") for k in range(len(KINDS) + 1)]
    seen = seen.select("rid", "doc_id", *spots)
    none = F.from_json(F.lit("[]"), "array<struct<kind:int,start:int,end:int>>")
    base = F.concat(*[F.coalesce(checked(F.col(f"b{k}"), k), none) for k in range(len(KINDS))])
    cand = F.transform(f"b{len(KINDS)}", lambda c: F.struct(c["s"].alias("s"), c["start"].alias("start"), c["end"].alias("end"), patterns_of(c).alias("patterns")))
    rows = stash(seen.select("rid", "doc_id", base.alias("base"), F.filter(cand, lambda c: F.size(c["patterns"]) > 0).alias("cand")), "pii-rows")

    occurs = stash(occurrences(rows), "pii-candidates")
    edges = stash(occurs.select("s", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    seeds = stash(occurs.select("s", F.explode("kinds").alias("kind")).distinct().withColumn("score", F.lit(1.0)), "pii-seeds")
    sizes = stash(edges.groupBy("pattern").agg(F.count("*").alias("n")), "pii-sizes")
    scores, state, spent = seeds, None, []
    while True:
        patterns = stash(score_patterns(edges, scores, sizes, min_support, min_confidence), "pii-patterns")
        spent.append(patterns)
        found = stash(score_candidates(edges, patterns), "pii-scores")
        spent.append(found)
        scores = found.unionByName(seeds).groupBy("s", "kind").agg(F.max("score").alias("score"))
        before, state = state, patterns.agg(F.count("*"), F.sum(F.round("confidence", 3).cast("decimal(9,3)")), F.sum(F.hash("pattern", "kind").cast("long"))).first()
        if state == before:
            break
    won = stash(found.filter(F.col("score") >= accept).groupBy("s").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind")), "pii-found")
    new = occurs.filter("kinds IS NULL").select("rid", "s", "start", "end").join(won, "s")
    new = stash(new.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("learned")), "pii-learned")
    discard(occurs, edges, seeds, sizes, won, *spent)
    return rows.select("rid", "doc_id", "base").join(new, "rid", "left").select("rid", "doc_id", "base", F.coalesce("learned", none).alias("learned"))


def of_kind(spans: str, k: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == k))


def digest(found: DataFrame) -> DataFrame:
    counts = [of_kind("base", k).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", "learned"))
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("learned").cast("long").alias("n_learned"))


def extract_pii(docs: DataFrame, **options) -> DataFrame:
    """The spans of every row with what stands there, one row a span: rid, doc_id, kind, start, end, value."""
    numbered = stash(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text_of().alias("text")), "pii-texts")
    found = find_pii(numbered, F.col("rid"), **options).select("rid", F.explode(F.concat("base", "learned")).alias("x"))
    names = F.array(*[F.lit(k) for k in KINDS])
    got = found.join(numbered, "rid")
    return got.select("rid", "doc_id", F.get(names, F.col("x.kind")).alias("kind"), F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.substring(F.col("text"), F.col("x.start") + 1, F.col("x.end") - F.col("x.start")).alias("value"))


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(table(spark, sf_dir, "documents")))
