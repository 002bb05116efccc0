"""File sources and sinks: JSON, JSON lines, CSV, SQLite rows, binary inventories, and paged documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspar.registry import query
from quillspar.sources.tables import table

PAGED = "doc_id string, title string, document_type string, pages array<struct<page:int,text:string>>"


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON array or object a file; corrupt files fail."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, skip_bad: bool = False) -> DataFrame:
    """JSON lines; malformed ones are skipped or fail the read."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED" if skip_bad else "FAILFAST")


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text, nothing inferred."""
    return spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", multiLine=True, escape='"')


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def paged_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a page of parsed documents, blank pages left out."""
    pages = json_array(spark, path, PAGED).select("doc_id", "title", "document_type", F.explode("pages").alias("p"))
    return pages.select("doc_id", "title", "document_type", "p.page", F.trim("p.text").alias("text")).where("text <> ''")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, size, kind by magic bytes and digest of every file below a folder, with copies counted.

    Contents are read once, in the tasks; no content leaves them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    magic = F.hex(F.substring("content", 1, 4))
    kind = F.when(magic == "25504446", "pdf").when(magic == "504B0304", "zip").when(magic == "D0CF11E0", "ole").when(magic.startswith("FFD8FF"), "jpeg").when(magic == "89504E47", "png").otherwise("other")
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), kind.alias("kind"), F.md5("content").alias("digest"))
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies"))
    return rows.join(copies, "digest").select("name", "size", "kind", "digest", "copies")


def sqlite_rows(spark: SparkSession, paths: list[str], sql: str, schema: str) -> DataFrame:
    """The rows of one read-only statement over SQLite files that every executor can open; one task a file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        for batch in batches:
            for path in batch.column("path").to_pylist():
                connection = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
                try:
                    cursor = connection.execute(sql)
                    names = [c[0] for c in cursor.description]
                    while rows := cursor.fetchmany(4096):
                        yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in rows])
                finally:
                    connection.close()

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(read, schema)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Rows of several sources; columns that one lacks are null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


@query("s07_union_sources", "SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier")
def s07_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return union_sources(customers, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))


@query("s14_duplicate_content", "SELECT md5(html) AS digest, count(*) AS copies, min(page_id) AS first_page FROM pages GROUP BY 1 HAVING count(*) > 1")
def s14_duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "pages").groupBy(F.md5("html").alias("digest")).agg(F.count("*").alias("copies"), F.min("page_id").alias("first_page"))
    return grouped.where("copies > 1")


@query("s12_link_counts", "SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href='))::INT AS links, len(regexp_extract_all(html, '<p>'))::INT AS paragraphs FROM pages")
def s12_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.regexp_count("html", F.lit(p)).alias(n) for p, n in (("<a [^>]*href=", "links"), ("<p>", "paragraphs"))]
    return table(spark, sf_dir, "pages").select("page_id", *counts)


@query("s17_graph_sink", "SELECT DISTINCT 'customer:' || o_custkey AS id FROM orders UNION SELECT DISTINCT 'order:' || o_orderkey FROM orders")
def s17_graph_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the property graph, one an id, as a merge into a graph store would keep them."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.explode(F.array(F.concat(F.lit("customer:"), "o_custkey"), F.concat(F.lit("order:"), "o_orderkey"))).alias("id")).distinct()
