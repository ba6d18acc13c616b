"""Readers and sinks on inline fixtures."""

import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from oddsloom.sources import readers, sinks


def test_newest_document_wins_and_broken_ones_go(spark, tmp_path):
    for k, (name, text) in enumerate({"a.json": '{"id": "m1", "v": 1}', "b.json": '{"id": "m1", "v": 2}', "c.json": "{broken", "d.json": '{"id": "m2", "v": 3}'}.items()):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (time.time() + k, time.time() + k))
    found = {r["id"]: r["v"] for r in readers.newest_documents(spark, f"{tmp_path}/*.json", "id string, v int", "id").collect()}
    assert found == {"m1": 2, "m2": 3}


def test_logs_and_feeds(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in readers.json_lines(spark, f"{tmp_path}/log.jsonl", "a int").collect()) == [1, 2]
    (tmp_path / "feed.xml").write_text('<r><match id="1"><odds>1.5</odds></match><match id="2"><odds>2.5</odds></match></r>')
    assert {(r["_id"], r["odds"]) for r in readers.xml_rows(spark, f"{tmp_path}/feed.xml", "match", "_id long, odds double").collect()} == {(1, 1.5), (2, 2.5)}


def test_pages(spark):
    html = '<table><tr><th>2024-01-01</th></tr><tr><td>A&nbsp;<b>B</b></td><td>1.5</td></tr></table><a class="x" href="/q">to <i>q</i></a><script>A[0]=[\'x\',\'y, z\',3];A[1]=[\'\',2];</script><i data-value="3" data-price="1.5"></i><i data-value="0" data-price="4.2"></i>'
    page = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    assert [r["cells"] for r in readers.table_rows(page, "id", "html").orderBy("row").collect()] == [["2024-01-01"], ["A B", "1.5"]]
    assert [(r["href"], r["text"]) for r in readers.links(page, "id", "html").collect()] == [("/q", "to q")]
    assert [r["fields"] for r in readers.script_arrays(page, "id", "html").collect()] == [["x", "y, z", "3"], ["", "2"]]
    assert page.where("id = 1").select(readers.price_triples(F.col("html")).alias("m")).first()["m"] == {"home": 1.5, "away": 4.2}
    rows = spark.createDataFrame([(1, 1, "d1"), (1, 2, None), (1, 3, "d2"), (1, 4, None), (2, 1, None)], "k int, n int, d string")
    assert [r["d"] for r in readers.carry_forward(rows, "k", "n", "d").orderBy("k", "n").collect()] == ["d1", "d1", "d2", "d2", None]


def test_key_values_and_nested(spark):
    text = "Match: A vs B\nnonsense\nOdds: 1.9: new\nmatch: C vs D"
    assert spark.createDataFrame([(text,)], "t string").select(readers.key_values(F.col("t")).alias("m")).first()["m"] == {"match": "C vs D", "odds": "1.9: new"}
    raw = spark.read.json(spark.sparkContext.parallelize([json.dumps({"groups": [{"rows": [{"id": 1}, {"id": 2}]}, {"rows": []}]})]))
    assert [r["id"] for r in readers.nested_fixtures(raw, "groups", "rows", ["id"]).collect()] == [1, 2]


def test_sheets(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>odds</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c><c r="B2"><v>1.9</v></c></row><row r="3"/></sheetData></worksheet>')
    found = readers.sheet_rows(spark, f"{tmp_path}/b.xlsx").collect()
    assert [(r["row"], r["fields"]) for r in found] == [(2, {"id": "7", "odds": "1.9"})]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, t int")
    sinks.write_run(rows, f"{tmp_path}/runs", "r1")
    with pytest.raises(Exception, match="exists"):
        sinks.write_run(rows, f"{tmp_path}/runs", "r1")
    assert {(r["source"], r["rows"], r["status"]) for r in sinks.write_manifest({"x": rows, "y": rows.where("false")}, f"{tmp_path}/runs", "r1").collect()} == {("x", 3, "ok"), ("y", 0, "empty")}
    assert sinks.append_once(spark, rows, f"{tmp_path}/log", ["k", "t"]) == 3
    assert sinks.append_once(spark, rows.union(spark.createDataFrame([(3, "n", 1)], rows.schema)), f"{tmp_path}/log", ["k", "t"]) == 1
    assert {(r["k"], r["v"]) for r in sinks.current(rows, "k", ["t"]).collect()} == {(1, "b"), (2, "c")}
