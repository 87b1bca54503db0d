"""STR-15: the structure of a claim: nesting, alternatives, Markush groups, numeric ranges, figure markers.

Column functions without Python. Patterns are tables of forms by language; a caller may give others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPENING, CLOSING = "([{（【", ")]}）】"
SEPARATORS = "、,，或和及"

# The forms of alternatives, Markush groups, ranges and figure markers; then the same in English.
#: (group_type, pattern, group of the options, group of the selector or None)
ALTERNATIVES = (
    ("selection", r"选自(.{1,180}?)(?:中的|中)(一种或多种|至少一种|任一种|一种)", 1, 2),
    ("selection", r"(one or more|at least one|any one|one) selected from ([^;.]{1,180}?)(?=;|\.|$)", 2, 1),
    ("one_of", r"(.{1,120}?)(?:之一|中的任一种)", 1, None),
    ("one_of", r"any of ([^;.]{1,120}?)(?=;|\.|$)", 1, None),
)
IN_BRACKETS = r"[（(]([^（）()]{2,120}?(?:或者|或| or )[^（）()]{2,120}?)[）)]"
VARIABLE = r"R\d+|X\d*|Y\d*|Z\d*"
INDEPENDENT = rf"((?:{VARIABLE})(?:\s*(?:[、,，和及]|and)\s*(?:{VARIABLE}))+)\s*(?:各自独立地\s*(?:为|选自)|are each independently)(.{{2,220}}?)(?:；|。|;|\.|$)"
SINGLE = rf"\b({VARIABLE})\s*(?:为|表示|选自| is | denotes )(.{{2,160}}?)(?:；|。|;|\.|$)"
RANGE = r"(?i)(?<![A-Za-z0-9.])(-?\d+(?:\.\d+)?)\s*(?:-|～|~|至|到|to)\s*(-?\d+(?:\.\d+)?)\s*(%|wt%|质量份|份|℃|°C|MPa|kPa|Pa|nm|μm|mm|cm|mL|L|h|min|s)?"
FIGURE = r"(?:附图|图)\s*\d+[A-Za-z]?|附图标记\s*\d+|FIG\.\s*\d+[A-Za-z]?"


def found(c: Column, pattern: str) -> Column:
    """The matches of a pattern, whole."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def stacked(c: Column, sep: str | None = None) -> Column:
    """A fold over the brackets (and separators) of a text with a stack of the closing signs that are open.

    (stack, most, text): ``most`` is the greatest depth; ``text`` is the text with a unit separator for each
    separator outside brackets. A closing sign that is not the one due is an ordinary character.
    """
    pairs = F.create_map(*[F.lit(x) for pair in zip(OPENING, CLOSING, strict=True) for x in pair])

    def step(acc: Column, x: Column) -> Column:
        due = F.left(acc["stack"], F.lit(1))
        opens = F.try_element_at(pairs, x)
        stack = F.when(opens.isNotNull(), F.concat(opens, acc["stack"])).when((x == due) & (due != ""), F.right(acc["stack"], F.length(acc["stack"]) - 1)).otherwise(acc["stack"])
        out = acc["text"] if sep is None else F.concat(acc["text"], F.when((stack == "") & F.contains(F.lit(sep), x), F.lit("\x1f")).otherwise(x))
        return F.struct(stack.alias("stack"), F.greatest(acc["most"], F.length(stack)).alias("most"), out.alias("text"))

    signs = c if sep else F.regexp_replace(c, r"[^()\[\]{}（）【】]+", "")
    return F.aggregate(F.split(signs, ""), F.struct(F.lit("").alias("stack"), F.lit(0).alias("most"), F.lit("").alias("text")), step)


def nesting_depth(c: Column) -> Column:
    return stacked(F.coalesce(c, F.lit("")))["most"]


def options(c: Column) -> Column:
    """The options of a list: parts between separators outside brackets, without blanks and colons around them.

    The English words ``and`` and ``or`` separate too.
    """
    plain = F.regexp_replace(F.regexp_replace(c, r",? (?:and|or) (?![^(\[{]*[)\]}])", ","), r"\s+", " ")
    parts = F.split(stacked(plain, SEPARATORS)["text"], "\x1f")
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, r"^[ ：:；;]+|[ ：:；;]+$", ""))
    return F.filter(trimmed, lambda p: p != "")


def alternative_groups(c: Column) -> Column:
    """(group_type, selector, options, source_text) of groups with two options or more.

    What stands in brackets with an "or" is a group unless its options are all in another one.
    """
    groups = []
    for kind, pattern, at, by in ALTERNATIVES:
        selector = (lambda m, p=pattern, by=by: F.regexp_extract(m, p, by)) if by else (lambda m: F.lit("one"))

        def group(m: Column, kind=kind, pattern=pattern, at=at, selector=selector) -> Column:
            return F.struct(F.lit(kind).alias("group_type"), selector(m).alias("selector"), options(F.regexp_extract(m, pattern, at)).alias("options"), m.alias("source_text"))

        groups.append(F.transform(found(c, pattern), of_one(group)))
    listed = F.filter(F.concat(*groups), lambda g: F.size(g["options"]) >= 2)

    def bracketed(m: Column) -> Column:
        parts = F.transform(F.split(F.regexp_extract(m, IN_BRACKETS, 1), "或者|或| or "), lambda p: F.trim(p))
        return F.struct(F.lit("parenthetical_or").alias("group_type"), F.lit("one_or_more_requires_context").alias("selector"), F.filter(parts, lambda p: p != "").alias("options"), m.alias("source_text"))

    inner = F.filter(F.transform(found(c, IN_BRACKETS), of_one(bracketed)), lambda g: F.size(g["options"]) >= 2)

    def add(acc: Column, g: Column) -> Column:
        held = F.exists(acc, lambda have: F.size(F.array_except(g["options"], have["options"])) == 0)
        return F.when(held, acc).otherwise(F.concat(acc, F.array(g)))

    return F.aggregate(inner, listed, add)


def of_one(f):
    """A function of one column as Spark's transform counts its arguments."""
    return lambda x: f(x)


def markush_groups(c: Column) -> Column:
    """(variables, independent_selection, options, source_text): groups of several variables, then single ones not yet named."""

    def several(m: Column) -> Column:
        names = F.regexp_extract_all(F.regexp_extract(m, INDEPENDENT, 1), F.lit(VARIABLE), F.lit(0))
        return F.struct(names.alias("variables"), F.lit(True).alias("independent_selection"), options(F.regexp_extract(m, INDEPENDENT, 2)).alias("options"), m.alias("source_text"))

    def single(m: Column) -> Column:
        return F.struct(F.array(F.regexp_extract(m, SINGLE, 1)).alias("variables"), F.lit(False).alias("independent_selection"), options(F.regexp_extract(m, SINGLE, 2)).alias("options"), m.alias("source_text"))

    def add(acc: Column, g: Column) -> Column:
        named = F.exists(acc, lambda have: F.array_contains(have["variables"], F.get(g["variables"], F.lit(0))))
        return F.when(named | (F.size(g["options"]) < 2), acc).otherwise(F.concat(acc, F.array(g)))

    return F.aggregate(F.transform(found(c, SINGLE), of_one(single)), F.transform(found(c, INDEPENDENT), of_one(several)), add)


def numeric_ranges(c: Column) -> Column:
    """(lower, upper, unit, source_text) as they are written; no unit is ''."""
    part = lambda m, k: F.regexp_extract(m, RANGE, k)
    return F.transform(found(c, RANGE), lambda m: F.struct(part(m, 1).alias("lower"), part(m, 2).alias("upper"), part(m, 3).alias("unit"), m.alias("source_text")))


def figure_markers(c: Column) -> Column:
    return F.array_distinct(F.transform(found(c, FIGURE), lambda m: F.regexp_replace(m, r"\s+", "")))


def claim_structure(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, logic_type, nesting_depth, alternative_groups, markush_groups, numeric_ranges, figure_markers, review_reasons).

    MARKUSH where there is a Markush group, else ALTERNATIVE where there is a group of alternatives, else
    CONJUNCTION. A null text is an empty one. Reasons for a review: markush, several alternatives, depth of three.
    """
    c = F.col(text)
    parts = rows.select(key, nesting_depth(c).alias("nesting_depth"), alternative_groups(c).alias("alternative_groups"), markush_groups(c).alias("markush_groups"), numeric_ranges(c).alias("numeric_ranges"), figure_markers(c).alias("figure_markers"))
    markush, alternatives = F.size("markush_groups"), F.size("alternative_groups")
    logic = F.when(markush > 0, "MARKUSH").when(alternatives > 0, "ALTERNATIVE").otherwise("CONJUNCTION")
    reasons = F.array_compact(F.array(F.when(markush > 0, "markush"), F.when(alternatives > 1, "several_alternatives"), F.when(F.col("nesting_depth") >= 3, "depth")))
    return parts.select(key, logic.alias("logic_type"), *parts.columns[1:], reasons.alias("review_reasons"))
