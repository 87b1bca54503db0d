from pyspark.sql import functions as F

from dapple.functions import claims as C
from dapple.operators import queryplan as Q
from dapple.operators import relational as R
from dapple.operators import rules as U
from dapple.operators.evidence import validate_lineage
from dapple.sources import files


def test_claims_of_all_kinds(spark):
    texts = [
        (1, "一种轴承（由（钢或铝）制成），选自不锈钢、（镍，铬）合金和铜中的至少一种；长度5-12mm，见图 3a和图3a；R1、R2各自独立地为甲基、乙基或丙基。"),
        (2, "X2 is alkyl, aryl; X2 is none, other; made of any of steel, iron; ((("),
        (3, None), (4, ""), (5, "plain) text ]("), (6, "one or more selected from bolts (M3, M4), nuts and pins. (nuts or pins) at -3 to 4.5 kPa"),
    ]
    got = {r.id: r for r in C.claim_structure(spark.createDataFrame(texts, "id long, t string"), "id", "t").collect()}
    assert [got[i].logic_type for i in range(1, 7)] == ["MARKUSH", "MARKUSH", "CONJUNCTION", "CONJUNCTION", "CONJUNCTION", "ALTERNATIVE"]
    assert [got[i].nesting_depth for i in range(1, 7)] == [2, 3, 0, 0, 1, 1]
    one = got[1]
    # of what stands in brackets with an "or", each side has two characters at least
    assert [(g.group_type, list(g.options)) for g in one.alternative_groups] == [("selection", ["不锈钢", "（镍，铬）合金", "铜"])]
    assert [(list(g.variables), list(g.options), g.independent_selection) for g in one.markush_groups] == [(["R1", "R2"], ["甲基", "乙基", "丙基"], True)]
    assert [(r.lower, r.upper, r.unit) for r in one.numeric_ranges] == [("5", "12", "mm")] and list(one.figure_markers) == ["图3a"]
    two = got[2]
    assert [(list(g.variables), list(g.options)) for g in two.markush_groups] == [(["X2"], ["alkyl", "aryl"])] and list(two.review_reasons) == ["markush", "depth"]
    six = got[6]  # the options in brackets are all in the other group
    assert [(g.group_type, list(g.options)) for g in six.alternative_groups] == [("selection", ["bolts (M3, M4)", "nuts", "pins"])]
    assert [(r.lower, r.upper, r.unit) for r in six.numeric_ranges] == [("-3", "4.5", "kPa")]


def test_query_plans(spark):
    aliases = [("big apple", "region", "New York"), ("apple", "subject", "fruit"), ("small giant", "project", "Little Giants"), ("small giant firms", "project", "New York Giants"), ("tell me about", "intent", ""), ("not", "exclude", "not"), ("", "subject", "none"), ("--", "subject", "none"), (None, "subject", "none"), ("apple", "zzz", "later")]
    asked = [(1, "Tell me about SMALL giant firms, and small giant in the big apple: 2021, not apple; apple 2020?"), (2, "not a big apple pie"), (3, None), (4, ""), (5, "nothing here"), (6, "Not big apple big apple")]
    texts = spark.createDataFrame(asked, "id long, q string")
    rows = {r.id: r for r in Q.query_plan(texts, "id", "q", spark.createDataFrame(aliases, "alias string, kind string, canonical string")).collect()}
    one = rows[1]
    assert one.rewritten == "New York Giants and Little Giants in the New York 2021 not fruit fruit 2020"
    assert (list(one.projects), list(one.regions), list(one.subjects), list(one.excluded), list(one.years)) == (["New York Giants", "Little Giants"], ["New York"], ["fruit"], ["fruit"], [2020, 2021])
    assert list(one.variants) == ["New York Giants", "New York Little Giants"]
    assert rows[2].rewritten == "not a New York pie" and list(rows[2].excluded) == [] and list(rows[2].regions) == ["New York"]
    assert rows[3].rewritten == rows[4].rewritten == "" and rows[5].variants == ["nothing here"]
    assert list(rows[6].excluded) == ["New York"] and list(rows[6].regions) == ["New York"]
    none = Q.query_plan(texts, "id", "q", spark.createDataFrame([], "alias string, kind string, canonical string")).collect()
    assert len(none) == 6 and all(list(r.projects) == [] for r in none)


def test_routes_and_supersession(spark):
    registry = spark.createDataFrame([("f", "p", "old", "in_force", "new", "draft", True, True), ("f", "q", "old", "invalid", " ", "draft", True, True), ("f", "r", "old", None, "new", "draft", True, None)], "family string, place string, formal string, formal_status string, prospective string, prospective_status string, verified boolean, replaces boolean")
    asked = [(1, "f", "p", "forecast"), (2, "f", "p", "current-assessment"), (3, "f", "p", "historical-fact"), (4, "f", "q", "forecast"), (5, "f", "r", "forecast"), (6, "f", None, "forecast"), (7, "f", "p", None)]
    got = {r.id: (r.status, r.primary_policy, r.draft_used, r.formal_allowed) for r in U.transition_routes(registry, spark.createDataFrame(asked, "id long, family string, place string, mode string")).collect()}
    assert got == {1: ("resolved", "new", True, False), 2: ("resolved", "old", False, True), 3: ("resolved", "old", False, False), 4: ("resolved", "old", False, False), 5: ("resolved", "old", False, True), 6: ("unresolved", None, False, False), 7: ("resolved", "old", False, True)}
    docs = spark.createDataFrame([(1, "rule a of 2019", False), (2, "draft of rule a", True), (3, "rule b", None), (4, None, False), (5, "rule a and rule b", False)], "id long, t string, d boolean")
    rules = spark.createDataFrame([("rule a", 2, "9", "text"), ("rule b", 1, "3", "notice")], "term string, priority int, replacement string, basis string")
    have = {r.id: (r.validity, r.replacement) for r in U.supersession(docs, "id", "t", F.col("d"), rules).collect()}
    assert have == {1: ("superseded", "9"), 2: ("draft", None), 3: ("current", None), 4: ("current", None), 5: ("superseded", "3")}


def test_requests_and_lineage(spark):
    lists = spark.createDataFrame([("x", "b1", 1), ("x", "b1", 2), ("y", None, 2)], "fam string, brand string, size int")
    asked = [(1, "x", "brand", "b1", 1, 0), (2, "x", "brand", "b9", 5, -3), (3, "x", "colour", "red", 5, 0), (4, "z", "brand", "b1", 5, 0), (5, None, None, None, 900, 2), (6, "y", "size", "2", 0, 0)]
    got = {r.id: (r.status, r.total, r.page_size, r.first, r.has_more) for r in R.route_requests(spark.createDataFrame(asked, "id long, fam string, field string, wanted string, size int, start int"), lists, "fam", {"brand": "brand", "size": "size"}).collect()}
    assert got == {1: ("accepted", 2, 1, 0, True), 2: ("accepted", 0, 5, 0, False), 3: ("unsupported filter", None, 5, 0, None), 4: ("unknown list", None, 5, 0, None), 5: ("unknown list", None, 200, 2, None), 6: ("accepted", 1, 1, 0, False)}
    rows = spark.createDataFrame([(1, 5, 3), (1, 5, 4), (2, 6, 1), (None, 5, 9)], "k long, src long, at int")
    sources = spark.createDataFrame([(5, 4)], "s long, since int")
    found = sorted(map(str, map(tuple, validate_lineage(rows, ["k"], sources, F.col("src") == F.col("s"), "s", {"early": F.col("at") < F.col("since")}).collect())))
    assert found == ["(1, 'duplicate')", "(1, 'duplicate')", "(1, 'early')", "(2, 'no source')"]


def test_entities_in_tables_and_json(spark):
    html = "<h1>A <b>B</b></h1><table><tr><th>No</th></tr><TR><td> 7 </td><td>Acme\n Works</td></TR></table><h2></h2><tr><td>Old Works</td></tr><tr><td>x"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "no rows")], "page_id long, html string")
    got = sorted((r.page_id, r.place, r.sequence, r.name, r.context) for r in files.table_entities(pages, ".* Works").collect())
    assert got == [(1, 2, 7, "Acme Works", "A B"), (1, 4, None, "Old Works", "")]
    texts = [(1, '[{"name": " a "}, {"title": "b", "n": 5}, {"n": 1}, 3]'), (2, '{"items": [{"name": null, "title": "c"}], "data": []}'), (3, '{"name": "d", "items": 4}'), (4, "broken"), (5, None), (6, "[]")]
    fields = {"name": ("name", "title"), "n": ("n",)}
    found = sorted((r.k, r.place, r.name, r.n) for r in files.json_entities(spark.createDataFrame(texts, "k long, t string"), "k", "t", fields).collect())
    assert [f[:3] for f in found] == [(1, 0, "a"), (1, 1, "b"), (3, 0, "d")] and found[1][3] == "5"
