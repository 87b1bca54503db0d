from pyspark.sql import functions as F

from dapple.sources import files
from dapple.streaming import ingest


def test_inventory_and_texts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.TXT").write_text("hello")
    (tmp_path / "a/y.html").write_text("<html><script>no()</script><p>hi <b>you</b></p></html>")
    (tmp_path / "a/e.md").write_text("  ")
    (tmp_path / "a/p.png").write_bytes(b"\x89PNG....")
    (tmp_path / "a/z.bin").write_bytes(b"\0\1")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/config").write_text("x")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.inventory(spark, str(tmp_path)).collect()}
    assert set(rows) == {"x.TXT", "y.html", "e.md", "p.png", "z.bin"}
    assert rows["x.TXT"]["size"] == 5 and rows["x.TXT"]["mode"] == "text"
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["text"]) for r in files.texts(spark, str(tmp_path)).collect()}
    assert got["x.TXT"] == ("indexed", "hello")
    assert got["y.html"][1].split() == ["hi", "you"]
    assert [got[n][0] for n in ("e.md", "p.png", "z.bin")] == ["empty", "ocr_required", "not_text"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"title": "a", "id": 1}\n\n{"name": "b"}\n{broken\n{"title": " ", "name": "c"}\n')
    good, bad = files.json_lines(spark, str(tmp_path / "x.jsonl"), {"title": ["title", "name"], "key": ["id"]})
    assert sorted(map(tuple, good.collect())) == [("a", "1"), ("b", None), ("c", None)]
    assert [r[0] for r in bad.collect()] == ["{broken"]


def test_csv_html_markdown_json(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿a,b\n1,"x ""y"" z"\n', encoding="utf-8")
    assert files.csv_rows(spark, str(tmp_path / "x.csv")).collect()[0].asDict() == {"a": "1", "b": 'x "y" z'}
    pages = spark.createDataFrame([(1, "<table><tr><th>A</th><td> 1 <b>2</b></td></tr><tr><td>z</td></tr></table>")], "page_id long, html string")
    assert [r["cells"] for r in files.table_cells(pages).collect()] == [["A", "1 2"], ["z"]]
    text = spark.createDataFrame([("# X\n\n## Rules\n\n| a | b |\n|---|---|\n| 1 | 2 |\n",)], "t string")
    assert text.select(files.markdown_table(F.col("t"), "Rules")).first()[0] == [["a", "b"], ["1", "2"]]
    assert files.canonical_json(spark.createDataFrame([(1, None, "x")], "b int, a int, c string")).first()[0] == '{"b":1,"c":"x"}'


def test_stream_ingest_is_idempotent(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text('{"id": 1, "v": 2}\n{"id": null, "v": 3}\n')

    def run():
        s = ingest.file_stream(spark, str(inbox), "id int, v int")
        ingest.start_ingest(s, str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "cp"), "id IS NOT NULL").awaitTermination()

    run()
    run()
    (inbox / "2.json").write_text('{"id": 5, "v": 6}\n')
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 5]
    assert [r["v"] for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == [3]


def test_windows_drop_late_events(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text('{"at": "2024-01-01T00:10:00Z", "k": "a"}\n{"at": "2024-01-01T09:00:00Z", "k": "a"}\n')
    s = ingest.file_stream(spark, str(inbox), "at timestamp, k string")
    counts = ingest.windowed_counts(s, "at", "k")
    q = counts.writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["k"], r["n"]) for r in spark.table("win").collect()] == [("a", 1)]


def test_changed_cells(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None)], "k int, v string")
    assert sorted(r["k"] for r in ingest.changed_cells(a, b, ["k"], "v").collect()) == [2, 3]
