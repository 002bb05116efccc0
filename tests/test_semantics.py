"""Pinned cases of operators that small tables show best."""

import pytest
from pyspark.sql import functions as F

from quillspar.functions import text
from quillspar.operators import dashboard, graph, joins, profile, retrieval, windows
from quillspar.streaming import incremental


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("A", "标准", ["氨", "甲醇", "氨"], "2024-01-01"), ("B", "事故", ["甲醇"], "2024-02-01"), ("C", "docx", [], None)]
    return spark.createDataFrame(rows, "id string, type string, chemicals array<string>, date string")


def test_groups_and_totals(facts):
    got = {r.chemicals: r.value for r in dashboard.group_facts(facts, ["chemicals"], "id").collect()}
    assert got == {"氨": 1, "甲醇": 2, dashboard.UNLABELLED: 1}
    marginal = {(r.dimension, r.label): r.value for r in dashboard.marginals(facts, ["type", "chemicals"], "id").collect()}
    assert marginal["type", "标准"] == 1 and marginal["total", None] == 3 and marginal["chemicals", "甲醇"] == 2


def test_filters(facts):
    ask = lambda **more: [r.id for r in dashboard.select_facts(facts, dashboard.DashboardQuery(("type",), **more), date="date").orderBy("id").collect()]
    assert ask(filters={"chemicals": ("氨", "甲醇"), "type": ("标准",)}) == ["A"]
    february = {"first": "2024-02-01", "last": "2024-02-28"}
    assert ask(**february) == ["B", "C"] and ask(**february, unknown="exclude") == ["B"] and ask(unknown="only") == ["C"]
    for bad in ({"dimensions": ()}, {"dimensions": ("type", "type")}, {"dimensions": ("nothing",)}, {"dimensions": ("type",), "first": "2", "last": "1"}, {"dimensions": ("type",), "unknown": "x"}):
        with pytest.raises(ValueError):
            dashboard.DashboardQuery(**bad).checked(facts)


def test_histogram_and_box(spark):
    numbers = spark.range(1, 401).select(F.col("id"), F.lit("g").alias("g"))
    bins = dashboard.histogram(numbers, "id").orderBy("bin").collect()
    assert len(bins) == 8 and sum(r.n for r in bins) == 400
    four = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)], "g string, v int")
    box = dashboard.box_plot(four, "g", "v").first()
    assert (box.q1, box.low, box.high, box.outliers) == (1.75, 1, 4, 0)


def test_number_profile(spark):
    values = spark.createDataFrame([("0",), ("2",), ("x",), ("true",), (None,), (" ",), ("NaN",)], "v string")
    row = profile.number_profile(values, "v").first()
    assert (row.valid, row.mismatched, row.missing, row["mean"]) == (2, 3, 2, 1.0)
    assert [tuple(r) for r in profile.equal_bins(spark.createDataFrame([(3,), (3,)], "v int"), "v").collect()] == [(0, 2)]


def test_validity_and_conflicts(spark):
    rows = [(1, "s", "p", "o1", "d1", "2020-01-01", "2025-01-01"), (2, "s", "p", "o2", "d2", "2024-01-01", None), (3, "s", "p", "o3", "d3", "2025-01-01", None), (4, "s", "p", "o4", "d4", "2026-01-01", "2025-01-01")]
    facts = spark.createDataFrame(rows, "seq int, subject string, predicate string, object string, doc string, valid_from string, valid_to string")
    at = lambda day: [r.seq for r in facts.where(joins.active_at(F.col("valid_from"), F.col("valid_to"), F.lit(day))).orderBy("seq").collect()]
    assert at("2024-12-31") == [1, 2] and at("2025-01-01") == [2, 3]
    assert sorted((r["first"], r["second"]) for r in joins.conflicts(facts).collect()) == [(1, 2), (2, 3)]


def test_review_log(spark):
    log = [("A1", 1, "approved", "压力", None), ("A1", 2, "modified", "压力", "超压")]
    schema = "assertion_id string, seq int, decision string, original string, corrected string"
    now = windows.current_relations(spark.createDataFrame(log, schema))
    assert [(r.label, r.revision_count) for r in windows.approved(now).collect()] == [("超压", 2)]
    later = windows.current_relations(spark.createDataFrame([*log, ("A1", 3, "rejected", "压力", None)], schema))
    assert windows.approved(later).count() == 0 and later.first().status == "rejected"


def test_fusion(spark):
    hits = [("vector", "c2", 1), ("vector", "c1", 2), ("keyword", "c1", 1), ("keyword", "c1", 9)]
    frame = spark.createDataFrame(hits, "route string, key string, rank int")
    got = retrieval.fuse(frame).orderBy(F.desc("rrf_score"), "key").collect()
    assert [(r.key, r.routes) for r in got] == [("c1", "keyword,vector"), ("c2", "vector")]
    again = retrieval.fuse(frame.orderBy(F.desc("rank"))).orderBy(F.desc("rrf_score"), "key").collect()
    assert [r.rrf_score for r in got] == [r.rrf_score for r in again]


def test_han_terms_and_bm25(spark):
    docs = spark.createDataFrame([(1, "氯气泄漏应急处理"), (2, "甲醇储存 易燃液体 GB 123"), (3, "甲")], "doc_id int, text string")
    got = {r.doc_id: r.t for r in docs.select("doc_id", text.terms(F.col("text")).alias("t")).collect()}
    assert got[1] == ["氯气", "气泄", "泄漏", "漏应", "应急", "急处", "处理"] and got[2][:2] == ["gb", "123"] and got[3] == ["甲"]
    scores = retrieval.bm25(retrieval.postings(docs), ["氯气", "泄漏"], 3, 5.0).collect()
    assert [r.doc_id for r in scores] == [1]


def test_aliases(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "alias string, canonical string")
    assert {r.alias: r.canonical for r in graph.resolve_aliases(pairs([("a", "b"), ("b", "c"), ("x", "c")])).collect()} == {"a": "c", "b": "c", "x": "c"}
    for cycle in ([("a", "b"), ("b", "a")], [("a", "a")], [("a", "b"), ("b", "c"), ("c", "a")]):
        with pytest.raises(ValueError):
            graph.resolve_aliases(pairs(cycle), rounds=6)


def test_hops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 1)], "src int, dst int")
    start = spark.createDataFrame([(1,)], "node int")
    assert {r.node: r.hops for r in graph.hops(edges, start, 2).collect()} == {1: 0, 2: 1, 9: 1, 3: 2}
    assert {r.node: r.hops for r in graph.hops(edges, start, 9, directed=True).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_index_upsert(spark):
    index = spark.createDataFrame([("a", "氨")], "id string, body string")
    got = incremental.upsert(index, spark.createDataFrame([("b", "x"), ("b", "x"), ("a", "氨2")], "id string, body string"), "id", "body")
    assert {r.id: r.body for r in got.collect()} == {"a": "氨2", "b": "x"}
    with pytest.raises(ValueError):
        incremental.upsert(index, spark.createDataFrame([("b", "x"), ("b", "y")], "id string, body string"), "id", "body")


def test_cells_and_addresses(spark):
    cells = spark.createDataFrame([("=1+1", "http://a.b/c"), (" @x", "ftp://a"), ("plain", "https://u:p@h/")], "c string, u string")
    got = cells.select(text.spreadsheet_safe(F.col("c")).alias("c"), text.safe_url(F.col("u")).alias("u")).collect()
    assert [tuple(r) for r in got] == [("'=1+1", "http://a.b/c"), ("' @x", None), ("plain", None)]


def test_stream_equals_batch(spark, small, tmp_path):
    source = tmp_path / "in"
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    run = incremental.tumbling(stream, "6 hours", "60 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = incremental.tumbling(spark.read.parquet(str(source)), "6 hours", "60 days")
    key = lambda frame: sorted((str(r.w.start), r.event_type, r.n) for r in frame.collect())
    assert key(spark.table("windows")) == key(batch)


def test_stream_merge(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    schema = "id int, body string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).coalesce(1).write.parquet(str(source / "1"))
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
    incremental.merge_stream(stream(), str(target), "id", str(tmp_path / "mark")).start().awaitTermination(60)
    spark.createDataFrame([(2, "c"), (3, "d")], schema).coalesce(1).write.parquet(str(source / "2"))
    incremental.merge_stream(stream(), str(target), "id", str(tmp_path / "mark")).start().awaitTermination(60)
    got = spark.read.parquet(f"{target}/version=1")
    assert {r.id: r.body for r in got.collect()} == {1: "a", 2: "c", 3: "d"}
    spark.createDataFrame([(2, "e"), (2, "f"), (4, "g"), (4, "g")], schema).coalesce(1).write.parquet(str(source / "3"))
    with pytest.raises(Exception, match="name a sequence"):
        incremental.merge_stream(stream(), str(target), "id", str(tmp_path / "mark")).start().awaitTermination(60)
    incremental.merge_stream(stream(), str(target), "id", str(tmp_path / "mark"), sequence="body").start().awaitTermination(60)
    assert {r.id: r.body for r in spark.read.parquet(f"{target}/version=2").collect()} == {1: "a", 2: "f", 3: "d", 4: "g"}
    assert not (target / "version=0").exists()


def test_quotes_in_texts(spark):
    from quillspar.operators import joins

    docs = spark.createDataFrame([("a b c",), ("xab cx abc",), (None,), ("",), ("bc\n\td",)], "text string")
    quotes = spark.createDataFrame([(1, "ab\nc"), (2, "bcd"), (3, "a b c"), (4, "zz"), (5, " "), (6, None), (None, "c")], "item_id int, text string")
    for limit in (8 << 20, 3):
        assert {tuple(r) for r in joins.quoted(docs, quotes, limit).collect()} == {(1, 2), (2, 1), (3, 2), (None, 3)}
