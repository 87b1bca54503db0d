"""Search, text, date, array, JSON and similarity queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dapple.functions import text as T
from dapple.operators import dictionary as D
from dapple.operators import evidence as E
from dapple.operators import graph as G
from dapple.operators import search as S
from dapple.operators.segments import SegmentedIndex
from dapple.operators.storage import cut, files_state, fresh_path
from dapple.plans.registry import Tables, query
from dapple.sources import files as src

_PARTS = r"""
parts AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk, substr(text, CAST(i * 1020 + 1 AS INTEGER), 1200) AS content FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(range(0, CAST(greatest(ceil((length(coalesce(text, '')) - 1200) / 1020.0), 0) AS BIGINT) + 1)) AS i FROM documents)),
held AS (SELECT doc_id, chunk, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM parts),
stats AS (SELECT count(*) AS n_all, avg(len(w)) AS mean_dl FROM held),
post AS (SELECT doc_id, chunk, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, chunk, w, unnest(w) AS term FROM held) GROUP BY ALL)"""


def _bm25_sql(*terms: str) -> str:
    names = ", ".join(f"'{x}'" for x in terms)
    return f"""WITH {_PARTS},
own AS (SELECT * FROM post WHERE term IN ({names})), df AS (SELECT term, count(*) AS df FROM own GROUP BY 1),
sc AS (SELECT doc_id, chunk, CASE WHEN ln((n_all - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_all - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_dl)) AS part FROM own JOIN df USING (term), stats),
hits AS (SELECT doc_id, chunk, sum(part) AS score, count(*) AS n_terms FROM sc GROUP BY 1, 2)
SELECT doc_id, chunk, round(score, 6) AS score, n_terms FROM hits WHERE n_terms = {len(terms)} OR (SELECT max(n_terms) FROM hits) < {len(terms)} ORDER BY round(score, 9) DESC, doc_id, chunk LIMIT 20"""


_STORED: dict[tuple, S.Index] = {}
_WRITTEN: set[tuple] = set()


def stored_index(t: Tables, *more: str) -> S.Index:
    """The index of the documents, its passages and what is asked for of ``words`` and ``trigrams``: each written once a session for a state of the table's files, and read from then on."""
    key = (t.spark.sparkContext.applicationId, t.folder, files_state(t.documents))
    if key not in _STORED:
        _STORED[key] = S.write_passages(t.documents, fresh_path(t.spark, "index"))
    for name, write in (("words", S.write_postings), ("trigrams", S.write_trigrams)):
        if name in more and (key, name) not in _WRITTEN:
            write(_STORED[key])
            _WRITTEN.add((key, name))
    return _STORED[key]


@query("fts_passage_search", _bm25_sql("license", "under"))
def _(t: Tables) -> DataFrame:
    """FTS-2, FTS-3, FTS-4, SRT-3: passages that hold all terms, by BM25, from the stored index."""
    i = stored_index(t, "words")
    return S.bm25(i.postings, i.statistics, ["license", "under"])


@query("fts4_any_fallback", _bm25_sql("idiot", "licensed", "qqqq"))
def _(t: Tables) -> DataFrame:
    """FTS-4: one term occurs nowhere, so any term counts."""
    i = stored_index(t, "words")
    return S.bm25(i.postings, i.statistics, ["idiot", "licensed", "qqqq"])


def _phrases_sql(*phrases: str) -> str:
    each = ", ".join(f"('{p}', {[*p.split()]!r})" for p in phrases)
    own = f"""asked(term, t) AS (VALUES {each}), own AS (SELECT doc_id, chunk, len(w) AS dl, term, len(list_filter(range(1, len(w) - len(t) + 2), lambda i: w[i:i + len(t) - 1] = t)) AS tf FROM held, asked)"""
    return _bm25_sql(*phrases).replace(f"own AS (SELECT * FROM post WHERE term IN ({', '.join(repr(x) for x in phrases)}))", f"{own}, got AS (SELECT * FROM own WHERE tf > 0)").replace("FROM own", "FROM got").replace("FROM got WHERE", "FROM own WHERE")


@query("fts4_phrases", _phrases_sql("licensed under the apache", "license"))
def _(t: Tables) -> DataFrame:
    """FTS-4: a quoted phrase and a word, both of which a passage must hold, from the stored places."""
    i = stored_index(t, "words")
    return S.search(i.postings, i.statistics, '"Licensed under the Apache" license')


@query("fts4_phrases_any", _phrases_sql("under the mit", "apache under the", "licensed under the gnu"))
def _(t: Tables) -> DataFrame:
    """FTS-4: no passage holds all phrases (the words of one stand nowhere in that order), so any counts."""
    i = stored_index(t, "words")
    return S.search(i.postings, i.statistics, '"under the MIT" "apache under the" "licensed under the GNU"')


@query("fts6_segments", _bm25_sql("license", "under").replace("coalesce(text, '') AS text, unnest(range(0, CAST(greatest(ceil((length(coalesce(text, '')) - 1200)", "x AS text, unnest(range(0, CAST(greatest(ceil((length(x) - 1200)").replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 8 THEN 'Under revision. ' || coalesce(text, '') ELSE coalesce(text, '') END AS x FROM documents WHERE doc_id % 50 <> 7))"))
def _(t: Tables) -> DataFrame:
    """FTS-6: an index of all documents, then a change of a fiftieth and the loss of another, each a segment; searched as one."""
    d = t.documents.select("doc_id", "text")
    index = SegmentedIndex(t.spark, fresh_path(t.spark, "segments"))
    index.apply(d)
    index.apply(d.filter("doc_id % 50 = 8").select("doc_id", F.concat(F.lit("Under revision. "), F.coalesce("text", F.lit(""))).alias("text")))
    index.apply(d.limit(0), d.filter("doc_id % 50 = 7"))
    return S.bm25(index.postings, index.statistics, ["license", "under"])


@query("fts1_trigram_index", f"WITH {_PARTS} SELECT g AS gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT DISTINCT doc_id, chunk, substr(x, CAST(i AS INTEGER), 3) AS g FROM (SELECT doc_id, chunk, lower(content) AS x, unnest(range(1, greatest(length(content) - 1, 1))) AS i FROM parts WHERE length(content) >= 3)) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """FTS-1: the stored trigram postings of all passages, counted."""
    docs = F.size(F.array_distinct(F.array_compact("doc_id"))).cast("long")  # a document is in one row of a trigram
    return stored_index(t, "trigrams").trigrams.groupBy("gram").agg(F.sum(F.size("doc_id").cast("long")).alias("n"), F.sum(docs).alias("docs"))


@query("fts1_trigram_search", f"WITH {_PARTS} SELECT doc_id, chunk FROM parts WHERE contains(lower(content), 'licens')")
def _(t: Tables) -> DataFrame:
    """FTS-1: passages that hold a part of a word, by their trigrams."""
    return S.passages_with(stored_index(t, "trigrams"), "Licens")


@query("fts7_short_term", f"WITH {_PARTS} SELECT doc_id, chunk FROM parts WHERE contains(lower(content), '@')")
def _(t: Tables) -> DataFrame:
    """FTS-7: a term too short for trigrams is looked for in all passages."""
    return S.passages_with(stored_index(t), "@")


@query("fts5_snippet", "SELECT doc_id, substr(text, greatest(p - 35, 1), p - greatest(p - 35, 1)) || '<mark>' || substr(text, p, 5) || '</mark>' || substr(text, p + 5, 65) AS snippet FROM (SELECT doc_id, text, strpos(lower(text), 'under') AS p FROM documents) WHERE p > 0")
def _(t: Tables) -> DataFrame:
    """FTS-5, STR-11: the text around a term."""
    return t.documents.filter(F.contains(F.lower("text"), F.lit("under"))).select("doc_id", T.snippet(F.col("text"), "under").alias("snippet"))


@query("fts6_index_update", _PARTS.join(["WITH ", ""]).replace("coalesce(text, '') AS text, unnest(range(0, CAST(greatest(ceil((length(coalesce(text, '')) - 1200)", "x AS text, unnest(range(0, CAST(greatest(ceil((length(x) - 1200)").replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 8 THEN 'Revised. ' || coalesce(text, '') ELSE coalesce(text, '') END AS x FROM documents WHERE doc_id % 50 <> 7))") + " SELECT term, count(*) AS n, CAST(sum(tf) AS BIGINT) AS tf FROM post GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """FTS-6: some documents leave the index and others come back changed; the postings of the rest stay as stored."""
    d = t.documents.select("doc_id", "text")
    changed = d.filter("doc_id % 50 = 8").select("doc_id", F.concat(F.lit("Revised. "), F.coalesce("text", F.lit(""))).alias("text"))
    new = S.replace_documents(stored_index(t, "words").postings, S.passages(changed), d.filter("doc_id % 50 IN (7, 8)"))
    return new.groupBy("term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))


@query("fts9_categories", "SELECT p_partkey, CAST(4 * (p_name = 'red ring')::INT + 2 * (p_type IN ('PROMO', 'SMALL'))::INT + (p_name ILIKE '%red%')::INT + (p_name ILIKE '%bolt%')::INT AS INT) AS score FROM part WHERE p_name = 'red ring' OR p_type IN ('PROMO', 'SMALL') OR p_name ILIKE '%red%' OR p_name ILIKE '%bolt%'")
def _(t: Tables) -> DataFrame:
    """FTS-9: identity 4, category 2, each feature 1; rows without any go."""
    score = (F.col("p_name") == "red ring").cast("int") * 4 + F.col("p_type").isin("PROMO", "SMALL").cast("int") * 2
    for feature in ("red", "bolt"):
        score = score + F.col("p_name").ilike(f"%{feature}%").cast("int")
    return t.part.select("p_partkey", score.alias("score")).filter("score > 0")


@query("fts8_weighted_keywords", "SELECT p_partkey, CAST((p_name ILIKE '%a%')::INT * 3 + (p_type ILIKE '%e%')::INT * 2 + (p_brand ILIKE '%2%')::INT AS INT) AS score FROM part")
def _(t: Tables) -> DataFrame:
    """FTS-8: weights of the fields that hold a keyword."""
    score = sum(F.col(c).ilike(p).cast("int") * w for c, p, w in (("p_name", "%a%", 3), ("p_type", "%e%", 2), ("p_brand", "%2%", 1)))
    return t.part.select("p_partkey", score.alias("score"))


@query("prj1_metadata", r"SELECT doc_id, nullif(regexp_extract(text, '(?i)version ([0-9]+(?:\.[0-9]+)?)', 1), '') AS version, CASE WHEN lang IN ('en') THEN 'main' ELSE 'other' END AS region, length(text) - length(replace(text, chr(10), '')) AS line_breaks FROM documents")
def _(t: Tables) -> DataFrame:
    """PRJ-1: columns derived from a text."""
    v = F.regexp_extract("text", r"(?i)version ([0-9]+(?:\.[0-9]+)?)", 1)
    return t.documents.select("doc_id", F.when(v != "", v).alias("version"), F.when(F.col("lang") == "en", "main").otherwise("other").alias("region"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("line_breaks"))


@query("prj2_first_rule", "SELECT doc_id, CASE WHEN text ILIKE '%license%' THEN 'legal' WHEN text LIKE '%@%' THEN 'contact' WHEN text LIKE '%$$$%' THEN 'junk' ELSE 'prose' END AS role, CASE WHEN text LIKE '%@%' OR text LIKE '%password%' THEN 'sensitive' ELSE 'public' END AS sensitivity FROM documents")
def _(t: Tables) -> DataFrame:
    """PRJ-2: ordered rules, the first that matches."""
    x = F.col("text")
    role = F.when(x.ilike("%license%"), "legal").when(x.contains("@"), "contact").when(x.contains("$$$"), "junk").otherwise("prose")
    return t.documents.select("doc_id", role.alias("role"), F.when(x.contains("@") | x.contains("password"), "sensitive").otherwise("public").alias("sensitivity"))


@query("prj3_alias_columns", "SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.k')), ''), nullif(trim(json_extract_string(props, '$.key')), ''), 'none') AS k FROM events")
def _(t: Tables) -> DataFrame:
    """PRJ-3: the first alias that is not empty."""
    alias = lambda p: F.nullif(F.trim(F.get_json_object("props", p)), F.lit(""))
    return t.events.select("event_id", F.coalesce(alias("$.k"), alias("$.key"), F.lit("none")).alias("k"))


_JSON = """
WITH j AS (SELECT o_orderkey AS id, o_orderkey % 3 AS a, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS b, o_orderpriority AS c, o_custkey AS d FROM orders)"""


def payloads(t: Tables, later: bool = False) -> DataFrame:
    """Nested JSON of each order; in its later form some leaves are new, gone or changed."""
    k = F.col("o_orderkey")
    status = F.when(k % 5 != 0, F.when(F.lit(later) & (k % 7 == 0), F.lit("X")).otherwise(F.col("o_orderstatus")))
    items = F.array(F.struct(F.col("o_orderpriority").alias("p")), F.struct(F.col("o_custkey").cast("string").alias("p")))
    items = F.when(F.lit(later) & (k % 11 == 0), F.slice(items, 1, 1)).otherwise(items)
    more = F.when(F.lit(later) & (k % 13 == 0), "new")
    return t.orders.select(k.alias("id"), F.to_json(F.struct((k % 3).alias("a"), F.struct(status.alias("b"), more.alias("n")).alias("s"), items.alias("items"))).alias("json"))


@query("prj4_jsn_flatten", f"""{_JSON}
SELECT id, 'a' AS path, CAST(a AS VARCHAR) AS value FROM j UNION ALL SELECT id, 's.b', '"' || b || '"' FROM j WHERE b IS NOT NULL
UNION ALL SELECT id, 'items[0].p', '"' || c || '"' FROM j UNION ALL SELECT id, 'items[1].p', '"' || d || '"' FROM j""")
def _(t: Tables) -> DataFrame:
    """PRJ-4, JSN-1: nested JSON as (path, value) rows."""
    return E.json_leaves(payloads(t), "id", "json")


@query("jn12_json_diff", f"""{_JSON}
SELECT id, 's.b' AS path, 'modified' AS kind, '"' || b || '"' AS old, '"X"' AS new FROM j WHERE b IS NOT NULL AND id % 7 = 0 AND b <> 'X'
UNION ALL SELECT id, 'items[1].p', 'deleted', '"' || d || '"', NULL FROM j WHERE id % 11 = 0
UNION ALL SELECT id, 's.n', 'added', NULL, '"new"' FROM j WHERE id % 13 = 0""")
def _(t: Tables) -> DataFrame:
    """JN-12: leaves added, deleted, modified between two states of nested JSON."""
    return E.json_diff(payloads(t), payloads(t, later=True), "id", "json")


@query("prj5_priority", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 99 END AS priority FROM events")
def _(t: Tables) -> DataFrame:
    """PRJ-5: rank by name, 99 for the rest."""
    rank = F.create_map(*[F.lit(x) for kv in (("purchase", 1), ("signup", 2), ("click", 3)) for x in kv])
    return t.events.select("event_id", F.coalesce(F.try_element_at(rank, F.col("event_type")), F.lit(99)).alias("priority"))


@query("src11_html_rows", r"SELECT page_id, len(regexp_extract_all(lower(html), '<tr[ >]')) AS n_rows, len(regexp_extract_all(lower(html), '<(td|th|li|p)[ >]')) AS n_cells, regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g') AS title FROM pages")
def _(t: Tables) -> DataFrame:
    """SRC-11: rows, cells and title of raw pages."""
    low = F.lower("html")
    title = F.regexp_replace(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), r"\s+", " ")
    return t.pages.select("page_id", F.regexp_count(low, F.lit("<tr[ >]")).cast("long").alias("n_rows"), F.regexp_count(low, F.lit("<(td|th|li|p)[ >]")).cast("long").alias("n_cells"), title.alias("title"))


def order_pages(t: Tables) -> DataFrame:
    """A page for each order, with a table of its lines under a heading."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.concat(F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("</td><td>Part <b>"), F.col("l_partkey").cast("string"), F.lit("</b>\nWorks </td><TD class='q'>"), F.col("l_returnflag"), F.lit("</TD></tr>")).alias("tr"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["tr"]), "\n").alias("trs"))
    html = F.concat(F.lit("<h1>Orders</h1><p>intro</p><h2 id='x'>Order <i>"), F.col("l_orderkey").cast("string"), F.lit("</i></h2><table><tr><th>No</th><th>Name</th></tr>"), "trs", F.lit("</table>"))
    return rows.select(F.col("l_orderkey").alias("page_id"), html.alias("html"))


@query("src11_table_cells", "SELECT l_orderkey AS page_id, l_linenumber::INTEGER AS row, l_linenumber || '|Part ' || l_partkey || ' Works|' || l_returnflag AS cells FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 0, 'No|Name' FROM lineitem")
def _(t: Tables) -> DataFrame:
    """SRC-11: the cells of all table rows, from pages that are written from the orders."""
    got = src.table_cells(order_pages(t))
    # a row's number in its page is its line's, as orders number their lines from 1 without gaps
    return got.select("page_id", F.when(F.col("row") == 0, 0).otherwise(F.get("cells", F.lit(0)).cast("int")).alias("row"), F.array_join("cells", "|").alias("cells"))


@query("str9_table_entities", "SELECT l_orderkey AS page_id, l_linenumber::INTEGER AS sequence, 'Part ' || l_partkey || ' Works' AS name, 'Order ' || l_orderkey AS context FROM lineitem")
def _(t: Tables) -> DataFrame:
    """STR-9, WIN-8: the names in the tables of pages, with their sequence and the heading they stand under."""
    return src.table_entities(order_pages(t), r"\S.* Works").drop("place")


@query("jsn2_entities", "SELECT l_orderkey AS k, 'Part ' || l_partkey AS name, CASE WHEN l_orderkey % 3 = 1 THEN l_shipdate::DATE::VARCHAR END AS day, l_returnflag AS flag, l_quantity::BIGINT::VARCHAR AS amount FROM lineitem")
def _(t: Tables) -> DataFrame:
    """JSN-2: records out of JSON texts of several shapes (lists, lists in an object), fields under several names."""
    n = F.col("l_orderkey") % 3
    none = F.lit(None).cast("string")
    name = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))
    record = F.struct(F.when(n == 0, name).alias("name"), F.when(n == 1, F.lit(" ")).otherwise(none).alias("title"), F.when(n != 0, name).alias("enterprise"), F.when(n == 1, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("long").alias("qty"))
    texts = t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.collect_list(record)).alias("x"))
    n = F.col("l_orderkey") % 3
    text = F.when(n == 2, F.concat(F.lit('{"total": 9, "data": '), "x", F.lit("}"))).otherwise(F.col("x"))
    fields = {"name": ("name", "title", "enterprise"), "day": ("day", "date"), "flag": ("flag",), "amount": ("amount", "qty")}
    return src.json_entities(texts.select(F.col("l_orderkey").alias("k"), text.alias("t")), "k", "t", fields).drop("place")


@query("str1_nfkc_names", r"SELECT c_custkey, lower(regexp_replace(c_name, '[^\p{L}\p{N}]+', '', 'g')) || 'kg1' AS name FROM customer")
def _(t: Tables) -> DataFrame:
    """STR-1: names in full-width letters, with compatibility signs, in their normal form."""
    narrow = "".join(chr(c) for c in range(0x21, 0x7F))
    wide = F.translate("c_name", narrow, "".join(chr(ord(c) + 0xFEE0) for c in narrow))
    return t.customer.select("c_custkey", T.compact_name(T.nfkc(F.concat(wide, F.lit(" \u338f\u00b9")))).alias("name"))


@query("str1_2_names", r"SELECT c_custkey, lower(regexp_replace(c_name, '[^\p{L}\p{N}]+', '', 'g')) AS name, sha256(c_name || chr(31) || c_mktsegment) AS id FROM customer")
def _(t: Tables) -> DataFrame:
    """STR-1, STR-2."""
    return t.customer.select("c_custkey", T.compact_name(F.col("c_name")).alias("name"), T.stable_id(F.col("c_name"), F.col("c_mktsegment")).alias("id"))


@query("str3_4_similar_names")
def _(t: Tables) -> DataFrame:
    """STR-3, STR-4, JN-13: similar names within a block; the ratio runs on distinct names of a block only.

    The ratio is at most 2 * shorter / (shorter + longer), so pairs whose lengths bound it below the threshold
    never reach it. It depends on the order of its texts, so both orders of two names are scored.
    """
    p = t.part.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"), "p_brand", "p_size")
    q = p.select(F.col("a").alias("b"), F.col("x").alias("y"), "p_brand", "p_size")
    most = F.round(2 * F.least(F.length("x"), F.length("y")) / (F.length("x") + F.length("y")), 4)
    names = p.drop("a").distinct().join(q.drop("b").distinct(), ["p_brand", "p_size"]).filter((F.col("x") == F.col("y")) | (most >= 0.6))
    score = D.material_score(F.col("x"), F.col("y"))
    names = names.withColumn("score", F.round(score, 4)).filter("score >= 0.6")
    return names.join(p, ["p_brand", "p_size", "x"]).join(q, ["p_brand", "p_size", "y"]).filter("a < b").select("a", "b", "score")


def titles(t: Tables) -> DataFrame:
    """page_id, lang, title of the pages that have a title."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), r"\s+", " "))
    return t.pages.select("page_id", F.regexp_extract("html", r'(?i)<html[^>]* lang="([a-z]+)"', 1).alias("lang"), title.alias("title")).filter("title <> ''")


@query("jn13_close_titles")
def _(t: Tables) -> DataFrame:
    """JN-13: titles of a language, of eight characters at least, that are nearly the same: pairs of distinct titles.

    ``jn13_title_groups`` has the pages behind them.
    """
    return D.close_names(titles(t), "lang", "title")


@query("jn13_title_groups")
def _(t: Tables) -> DataFrame:
    """JN-13, GRF-1: each page with its title's group, named by the smallest title that close titles lead to."""
    rows = cut(titles(t), "titles")
    node = lambda c: F.concat_ws("\x1f", "lang", c)
    pairs = D.close_names(rows, "lang", "title").select(node("x").alias("src"), node("y").alias("dst"))
    groups = G.connected_components(pairs)
    near = rows.join(groups, node("title") == F.col("node"), "left")
    return near.select("page_id", "lang", F.coalesce(F.element_at(F.split("component", "\x1f", 2), 2), "title").alias("title_group"))


@query("jn14_best_directory")
def _(t: Tables) -> DataFrame:
    """JN-14: for each name of a list and each type of the directory, all entries of the best score from 0.88 on."""
    misspelt = F.regexp_replace(F.regexp_replace("p_name", "ll", "l"), "bolt$", "bolts")
    return D.best_entries(t.part.select(misspelt.alias("item")), t.part.select("p_type", F.col("p_name").alias("entry")), "item", "p_type", "entry")


@query("sim1_3_jaccard", """
WITH p AS (SELECT DISTINCT p_brand, p_name AS x, list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, CAST(i AS INTEGER), 3))) AS g FROM part WHERE p_name <> ''),
j AS (SELECT a.p_brand, a.x, b.x AS y, CASE WHEN a.x = b.x THEN 100.0 WHEN contains(b.x, a.x) AND length(a.x) >= 3 THEN 85 + least(10.0, 10.0 * length(a.x) / length(b.x)) ELSE 80.0 * len(list_intersect(a.g, b.g)) / greatest(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)), 1) END AS s FROM p a JOIN p b ON a.p_brand = b.p_brand)
SELECT p_brand, x, y, round(CAST(s AS DOUBLE), 4) AS score FROM j WHERE s >= 20""")
def _(t: Tables) -> DataFrame:
    """SIM-1, SIM-3: tiered scores of all pairs of distinct names of a brand. ``sim1_3_name_parts`` has the parts of each name."""
    return D.similar_names(t.part, "p_brand", "p_name", 20.0)


@query("sim1_3_name_parts", "SELECT p_brand, p_name AS x, p_partkey AS a FROM part")
def _(t: Tables) -> DataFrame:
    """SIM-1, SIM-3: the parts behind each name of ``sim1_3_jaccard``."""
    return t.part.select("p_brand", F.col("p_name").alias("x"), F.col("p_partkey").alias("a"))


@query("str5_urls", r"""
WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g') AS p,
 array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(lower(q), '^(utm_[a-z]+|gclid|fbclid|ref|spm)(=|$)'))), '&') AS q FROM pages)
SELECT page_id, s || '://' || CASE s WHEN 'http' THEN regexp_replace(h, ':80$', '') WHEN 'https' THEN regexp_replace(h, ':443$', '') ELSE h END || CASE p WHEN '' THEN '/' ELSE p END || CASE q WHEN '' THEN '' ELSE '?' || q END AS url FROM u""")
def _(t: Tables) -> DataFrame:
    """STR-5."""
    return t.pages.select("page_id", T.normal_url(F.col("url")).alias("url"))


@query("str6_document_numbers", r"SELECT doc_id, list_transform(regexp_extract_all(text, '(?i)version ([0-9]+)', 1), lambda x: CAST(x AS INTEGER))::VARCHAR AS numbers FROM documents WHERE regexp_matches(text, '(?i)version [0-9]+')")
def _(t: Tables) -> DataFrame:
    """STR-6: numbers after a word, as integers."""
    found = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)version ([0-9]+)"), F.lit(1)), lambda x: x.cast("int").cast("string"))
    return t.documents.filter(F.col("text").rlike(r"(?i)version [0-9]+")).select("doc_id", F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("numbers"))


@query("str7_8_heads", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type), '\b(standard|small|medium|large|economy|promo)\b', '', 'g'), '\s+', ' ', 'g')) AS head FROM part")
def _(t: Tables) -> DataFrame:
    """STR-7, STR-8: the head of a name without broad modifiers."""
    head = F.regexp_replace(F.lower("p_type"), r"\b(standard|small|medium|large|economy|promo)\b", "")
    return t.part.select("p_partkey", F.trim(F.regexp_replace(head, r"\s+", " ")).alias("head"))


@query("str9_entities", r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
e AS (SELECT doc_id, line, 'mail' AS kind, unnest(m) AS entity, unnest(range(1, len(m) + 1)) AS seq FROM (SELECT doc_id, line, regexp_extract_all(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+') AS m FROM l)
 UNION ALL SELECT doc_id, line, 'name', unnest(m), unnest(range(1, len(m) + 1)) FROM (SELECT doc_id, line, regexp_extract_all(x, '\b[A-Z][a-z]+(?: [A-Z][a-z]+)+') AS m FROM l))
SELECT doc_id, CAST(line AS INTEGER) AS line, kind, CAST(seq AS INTEGER) AS seq, entity FROM e""")
def _(t: Tables) -> DataFrame:
    """STR-9: names of several capitalised words and mail addresses, by line and order in the line."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    kinds = {"mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "name": r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+"}

    def numbered(kind: str, found: Column) -> Column:
        return F.transform(found, lambda m, k: F.struct(F.lit(kind).alias("kind"), (k + 1).alias("seq"), m.alias("entity")))

    found = [numbered(kind, F.regexp_extract_all("x", F.lit(p), F.lit(0))) for kind, p in kinds.items()]
    return lines.select("doc_id", (F.col("i") + 1).alias("line"), F.explode(F.concat(*found)).alias("e")).select("doc_id", "line", "e.*")


@query("str10_lexical_units", r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS unit FROM documents")
def _(t: Tables) -> DataFrame:
    """STR-10."""
    return t.documents.select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("unit"))


@query("str12_clauses", r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?。！？；;])', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')) AS n FROM documents")
def _(t: Tables) -> DataFrame:
    """STR-12: sentences, split after their closing sign."""
    return t.documents.select("doc_id", F.size(T.clauses(F.col("text"))).cast("long").alias("n"))


@query("str13_boundary_chunks")
def _(t: Tables) -> DataFrame:
    """STR-13: overlapping chunks cut at boundaries."""
    return t.documents.select("doc_id", F.posexplode(T.boundary_chunks("text")).alias("chunk", "content")).select("doc_id", "chunk", F.length("content").alias("size"))


@query("str14_segments", r"SELECT doc_id, len(string_split(text, chr(10))) AS n, CAST(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS INTEGER) AS longest FROM documents")
def _(t: Tables) -> DataFrame:
    """STR-14: segments by a marker."""
    parts = F.split("text", "\n")
    return t.documents.select("doc_id", F.size(parts).cast("long").alias("n"), F.array_max(F.transform(parts, lambda x: F.length(x))).alias("longest"))


@query("str16_status_terms", "SELECT doc_id, CASE WHEN text ILIKE '%expired%' THEN 'expired' WHEN text ILIKE '%licensed%' THEN 'licensed' WHEN text ILIKE '%released%' THEN 'released' ELSE 'unknown' END AS status FROM documents")
def _(t: Tables) -> DataFrame:
    """STR-16, RUL-12: the first of ordered status terms."""
    status = F.lit("unknown")
    for term in ("released", "licensed", "expired"):
        status = F.when(F.col("text").ilike(f"%{term}%"), term).otherwise(status)
    return t.documents.select("doc_id", status.alias("status"))


@query("dt1_2_dates", """
WITH x AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders), y AS (SELECT k, [d, d + 30, CASE WHEN k % 3 = 0 THEN DATE '2024-02-29' END] AS l FROM x)
SELECT k, array_to_string(list_transform(list_sort(list_distinct(list_filter(l, lambda v: v IS NOT NULL))), lambda v: strftime(v, '%Y-%m-%d')), ',') AS dates, list_min(list_filter(list_transform(l, lambda v: year(v)), lambda v: v >= 2000)) AS first, list_max(list_filter(list_transform(l, lambda v: year(v)), lambda v: v >= 2000)) AS last FROM y""")
def _(t: Tables) -> DataFrame:
    """DT-1, DT-2: dates of several spellings in a text, what is no date left out; the years from 2000 on."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    note = F.concat(F.lit("Placed "), F.date_format(d, "yyyy/M/d"), F.lit(", void 1999-02-30 and 1999.13.01, due "), F.date_format(F.date_add(d, 30), "yyyy.MM.dd"), F.when(k % 3 == 0, " or 2024-2-29").otherwise(""), F.lit("."))
    rows = t.orders.select(k.alias("k"), note.alias("note")).select("k", T.iso_dates(F.col("note")).alias("dates"), T.years(F.col("note")).alias("y"))
    return rows.select("k", F.array_join("dates", ",").alias("dates"), F.array_min("y").alias("first"), F.array_max("y").alias("last"))


@query("dt3_deadlines", "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS INTEGER) AS days_left FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') BETWEEN 0 AND 370")
def _(t: Tables) -> DataFrame:
    """DT-3: what falls within the countdown window."""
    left = F.date_diff(F.lit("1998-08-02").cast("date"), F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", left.alias("days_left")).filter(F.col("days_left").between(0, 370))


@query("dt4_backfill", "WITH h AS (SELECT date_trunc('hour', ts) AS h, event_type FROM events), r AS (SELECT unnest(generate_series((SELECT min(h) FROM h), (SELECT max(h) FROM h), INTERVAL 1 HOUR)) AS h) SELECT strftime(h, '%Y-%m-%d %H') AS slot FROM r WHERE h NOT IN (SELECT h FROM h WHERE event_type = 'error')")
def _(t: Tables) -> DataFrame:
    """DT-4, WIN-7: hours without a run, to be done again, all of them."""
    e = t.events.select(F.date_trunc("hour", "ts").alias("h"), "event_type")
    span = e.agg(F.min("h").alias("a"), F.max("h").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("h"))
    missing = span.join(e.filter("event_type = 'error'").select("h").distinct(), "h", "left_anti")
    return missing.select(F.date_format("h", "yyyy-MM-dd HH").alias("slot"))


@query("dt5_cooldown", "SELECT user_id, strftime(max(ts) + INTERVAL 7 DAY, '%Y-%m-%d') AS next_day FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """DT-5."""
    return t.events.groupBy("user_id").agg(F.date_format(F.date_add(F.max("ts").cast("date"), 7), "yyyy-MM-dd").alias("next_day"))


@query("dt6_batches", "SELECT o_orderkey, year(o_orderdate) AS y, 'batch ' || (year(o_orderdate) - 1991) AS batch FROM orders")
def _(t: Tables) -> DataFrame:
    """DT-6: batch names by year."""
    y = F.year("o_orderdate").cast("long")
    return t.orders.select("o_orderkey", y.alias("y"), F.concat(F.lit("batch "), (y - 1991).cast("string")).alias("batch"))


@query("arr1_split", r"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(p_type, ' '), lambda x: trim(x)), lambda x: x <> ''))), '/') AS parts FROM part")
def _(t: Tables) -> DataFrame:
    """ARR-1: parts of a text list, each once."""
    return t.part.select("p_partkey", F.array_join(F.array_sort(T.split_list(F.replace("p_type", F.lit(" "), F.lit(",")))), "/").alias("parts"))


@query("arr2_json_arrays", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """ARR-2, JSN-2: values parsed from JSON; what does not parse is left out."""
    return t.events.select("event_id", (F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint") % 10).alias("k")).filter("k IS NOT NULL")


@query("map1_alias_index", "SELECT lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '', 'g')) AS alias, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """MAP-1: normal alias to the ids behind it."""
    return t.part.groupBy(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "")).alias("alias")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))


@query("hsh1_digest", "SELECT n_nationkey, sha256('{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}') AS digest FROM nation")
def _(t: Tables) -> DataFrame:
    """HSH-1: digest of a canonical JSON form."""
    return t.nation.select("n_nationkey", F.sha2(F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))), 256).alias("digest"))


@query("win8_carry_forward", """
WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)), m AS (SELECT *, max(CASE WHEN length(x) > 120 THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS head FROM l WHERE x <> '')
SELECT doc_id, CAST(i AS INTEGER) AS line, CASE WHEN i - head <= 3 THEN CAST(head AS INTEGER) END AS head FROM m""")
def _(t: Tables) -> DataFrame:
    """WIN-8: a heading holds for the lines that follow it, three at most."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).filter("x <> ''").withColumn("line", F.col("i") + 1)
    head = F.max(F.when(F.length("x") > 120, F.col("line"))).over(Window.partitionBy("doc_id").orderBy("line"))
    return lines.withColumn("h", head).select("doc_id", "line", F.when(F.col("line") - F.col("h") <= 3, F.col("h")).alias("head"))
