"""The profile of a small table with all kinds of columns."""

from pyspark.sql import Row

from quillspar.operators import column_profile

SCHEMA = "doc_id long, char_count string, chunks int, published_at string, payload string, title string, flag boolean, tags array<string>, `odd.name` string, pdf_path string, ratio double"


def test_all_kinds(spark):
    nan = float("nan")
    rows = [
        (1, "7", 2, "2024-01-31T10:00:00Z", '{"a": 1}', "ab", True, ["x"], "p", "NaN", 1.0), (2, "x", 4, "2024-01-02", "{", " ", False, [], "q", "a.pdf", nan),
        (2, None, 6, "soon", None, "abcd", True, ["x", "y"], "q", "", 3.0), (None, "", None, "", "[1]", None, None, None, None, None, None),
    ]
    got = {r.name: r for r in column_profile.profile(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    counts = {name: (r.kind, r.total, r.valid, r.missing, r.mismatched, r.unique) for name, r in got.items()}
    assert counts == {
        "doc_id": ("identifier", 4, 3, 1, 0, 2), "char_count": ("number", 4, 0, 2, 2, 0), "chunks": ("number", 4, 3, 1, 0, 3), "published_at": ("date", 4, 2, 1, 1, 2), "payload": ("json", 4, 2, 1, 1, 2),
        "title": ("text", 4, 2, 2, 0, 2), "flag": ("boolean", 4, 3, 1, 0, 2), "tags": ("array", 4, 2, 2, 0, 2), "odd.name": ("category", 4, 3, 1, 0, 2), "pdf_path": ("text", 4, 1, 3, 0, 1), "ratio": ("number", 4, 2, 1, 1, 2),
    }
    chunks = got["chunks"]
    assert (chunks.mean, round(chunks.std, 6), chunks.quantiles) == (4.0, 1.632993, [2.0, 3.0, 4.0, 5.0, 6.0])
    assert chunks.histogram == [Row(bin=0, n=1), Row(bin=5, n=1), Row(bin=9, n=1)] and got["pdf_path"].histogram == [Row(bin=0, n=1)]
    assert got["published_at"].months == [Row(value="2024-01", n=2)] and got["chunks"].months is None
    assert (got["title"].shortest, got["title"].longest, got["tags"].shortest, got["tags"].longest, got["doc_id"].longest) == (2, 4, 5, 9, None)
    assert got["flag"].frequent == [Row(value="true", n=2), Row(value="false", n=1)] and got["odd.name"].frequent == [Row(value="q", n=2), Row(value="p", n=1)] and got["doc_id"].frequent == [Row(value="2", n=2)]
    empty = column_profile.profile(spark.createDataFrame([], SCHEMA)).collect()
    assert len(empty) == 11 and {(r.total, r.valid, r.unique) for r in empty} == {(0, 0, 0)}
