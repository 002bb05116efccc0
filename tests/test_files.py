"""Sources, sinks and sequential parsers."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillspar.functions import parsing
from quillspar.operators import graph, linkage
from quillspar.sources import files


def test_json_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"doc_id": "d", "title": "t", "document_type": "x", "pages": [{"page": 1, "text": " a "}, {"page": 2, "text": " "}]}]))
    assert [tuple(r) for r in files.paged_documents(spark, str(tmp_path / "a.json")).collect()] == [("d", "t", "x", 1, "a")]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    assert [r.a for r in files.json_lines(spark, str(tmp_path / "b.jsonl"), "a int", skip_bad=True).collect()] == [1, 2]
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "b.jsonl"), "a int").collect()
    files.append_lines(spark.range(2), str(tmp_path / "out"))
    files.append_lines(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_csv_inventory_and_sqlite(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿id,v\n007,"a,b"\n', encoding="utf-8")
    assert [tuple(r) for r in files.csv_text(spark, str(tmp_path / "c.csv")).collect()] == [("007", "a,b")]
    folder = tmp_path / "f"
    folder.mkdir()
    for name, content in (("a.pdf", b"%PDF1"), ("b.pdf", b"%PDF1"), ("c.docx", b"PK\x03\x04x")):
        (folder / name).write_bytes(content)
    assert sorted((r.name, r.kind, r.copies) for r in files.inventory(spark, str(folder)).collect()) == [("a.pdf", "pdf", 2), ("b.pdf", "pdf", 2), ("c.docx", "zip", 1)]
    connection = sqlite3.connect(tmp_path / "x.sqlite")
    connection.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    connection.executemany("INSERT INTO t VALUES (?, ?)", [(1, "x"), (2, None)])
    connection.commit()
    got = files.sqlite_rows(spark, [str(tmp_path / "x.sqlite")], "SELECT a, b FROM t ORDER BY a", "a long, b string")
    assert [tuple(r) for r in got.collect()] == [(1, "x"), (2, None)]


def test_parsers(spark):
    assert parsing.pack(["a" * 5, "b" * 4, "c" * 25], 10) == ["aaaaa\nbbbb", "c" * 10, "c" * 10, "c" * 5]
    assert parsing.salvage('noise {"b": [1, {"a": 2}]} tail') == '{"b": [1, {"a": 2}]}'
    assert parsing.salvage("```json\n[1]\n```") == "[1]" and parsing.salvage("none {") is None and parsing.salvage(None) is None
    frame = spark.createDataFrame([("x10",), ("x9",), ("x9a2",)], "s string")
    assert [r.s for r in frame.orderBy(parsing.natural_key(F.col("s"))).collect()] == ["x9", "x9a2", "x10"]
    assert spark.createDataFrame([("ＡＢ①",), (None,)], "s string").select(parsing.nfkc("s")).collect()[0][0] == "AB1"


def test_ratios_and_assignment(spark):
    assert linkage.indel_ratio("abc", "abc") == 100 and linkage.indel_ratio("", "a") == 0 and linkage.indel_ratio("ab", "ba") == 50
    assert linkage.title_ratio("b a", "a b") == 100 and linkage.title_ratio("safety code", "safety code of plants") == 100
    pairs = [("d1", "p1", 90.0), ("d1", "p2", 95.0), ("d2", "p2", 95.0), ("d2", "p1", 70.0), ("d3", "p1", 70.0), ("d4", "p9", 50.0)]
    got = linkage.assign(spark.createDataFrame(pairs, "id string, rid string, score double"), 60.0)
    assert sorted((r.id, r.rid, r.level) for r in got.collect()) == [("d1", "p2", "high"), ("d2", "p1", "medium")]


def test_exports(spark):
    edges = spark.createDataFrame([("a,b", "p", 'c"d')], "src string, predicate string, dst string")
    assert edges.select(graph.csv_line("src", "dst").alias("line")).first().line == '"a,b","c""d"'
    assert graph.turtle_lines(edges, "urn:").first().line == "<urn:a%2Cb> <urn:p> <urn:c%22d> ."
    assert {r.line for r in graph.graphml_lines(edges).collect()} == {'<node id="a,b"/>', '<node id="c&quot;d"/>', '<edge source="a,b" target="c&quot;d"/>'}
