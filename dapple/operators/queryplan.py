"""STR-17, STR-18: questions taken apart and rewritten by a table of aliases.

Aliases are found word by word with an automaton over the whole table, whatever its size; of matches that
overlap the leftmost counts, of those that begin together the longest. What stands in no alias stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dapple.functions import text as T
from dapple.operators.dictionary import term_hits

SPANS = "array<struct<start:bigint,end:bigint,kind:string,canonical:string>>"


def spaced(w: Column) -> Column:
    """Words with one space around each."""
    return F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))


def alias_spans(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """(key, words, spans) of every text: its lower-case words, one space around each, and the aliases in them.

    ``aliases`` has alias, kind, canonical; an alias of several rows counts for the first by kind and canonical
    form, one without words for none. A span's start and end are the spaces around it, counted from 1, so
    neighbours share one. Keys are unique and not null; a null text has no words.
    """
    known = aliases.withColumn("term", spaced(T.words(F.col("alias")))).filter("term <> '  '")
    known = known.groupBy("term").agg(F.min(F.struct("kind", "canonical")).alias("means"))
    held = texts.select(key, spaced(T.words(F.coalesce(text, F.lit("")))).alias("words"))
    hits = term_hits(held, key, "words", known, "term", places=True).join(known, "term")
    at = hits.select(key, F.explode("places").alias("start"), F.length("term").alias("n"), "means.*")
    # in order of start, the longest of a start first
    each = at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("n")).alias("n"), "kind", "canonical"))).alias("all"))

    def take(acc: Column, x: Column) -> Column:
        end = x["start"] - x["n"] - 1
        span = F.struct(x["start"].alias("start"), end.alias("end"), x["kind"].alias("kind"), x["canonical"].alias("canonical"))
        return F.when(x["start"] >= acc["end"], F.struct(end.alias("end"), F.concat(acc["out"], F.array(span)).alias("out"))).otherwise(acc)

    none = F.from_json(F.lit("[]"), SPANS)
    chosen = each.select(key, F.aggregate("all", F.struct(F.lit(0).cast("long").alias("end"), none.alias("out")), take)["out"].alias("spans"))
    return held.join(chosen, key, "left").select(key, "words", F.coalesce("spans", none).alias("spans"))


def rewritten(words: Column, spans: Column) -> Column:
    """The words with each span in its canonical form; one whose form is empty goes."""

    def put(acc: Column, x: Column) -> Column:
        between = F.substring(words, acc["end"], x["start"] - acc["end"] + 1)
        return F.struct(x["end"].alias("end"), F.concat(acc["text"], between, x["canonical"]).alias("text"))

    done = F.aggregate(spans, F.struct(F.lit(1).cast("long").alias("end"), F.lit("").alias("text")), put, lambda acc: F.concat(acc["text"], F.substring(words, acc["end"], F.length(words))))
    return F.trim(F.regexp_replace(done, " {2,}", " "))


def query_plan(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """(key, rewritten, projects, regions, subjects, excluded, years, variants) of every question.

    Kinds of aliases: project, region, subject; intent, whose canonical form is usually empty so that it is left
    out; exclude, a word that turns what follows it at once into an excluded term. Lists hold canonical forms,
    each once, in order; ``variants`` are the projects, each with the regions before it that it does not name
    itself, or else the rewritten question.
    """
    found = alias_spans(texts, key, text, aliases).join(texts.select(key, F.col(text).alias("_text")), key)
    s = F.col("spans")
    before = lambda i: F.get(s, i - 1)
    out = F.transform(s, lambda x, i: F.coalesce((i > 0) & (before(i)["kind"] == "exclude") & (before(i)["end"] == x["start"]), F.lit(False)))
    marked = found.withColumn("_x", F.arrays_zip(s.alias("s"), out.alias("out")))
    topic = ("project", "region", "subject")
    of = lambda *kinds, gone: F.array_distinct(F.transform(F.filter("_x", lambda x: x["s"]["kind"].isin(*kinds) & (x["out"] == gone)), lambda x: x["s"]["canonical"]))
    rows = marked.select(key, rewritten(F.col("words"), s).alias("rewritten"), *[of(k, gone=False).alias(f"{k}s") for k in topic], of(*topic, gone=True).alias("excluded"), T.years(F.coalesce("_text", F.lit(""))).alias("years"))
    named = F.transform("projects", lambda p: F.array_join(F.concat(F.filter("regions", lambda r: ~F.contains(p, r)), F.array(p)), " "))
    return rows.withColumn("variants", F.when(F.size("projects") > 0, F.array_distinct(named)).otherwise(F.array("rewritten")))
