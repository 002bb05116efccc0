"""Parsers that need a sequential reading: packing, excerpts, JSON inside prose, natural order."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspar.functions.text import MENTIONS
from quillspar.registry import query
from quillspar.sources.tables import table

_CLAUSE = re.compile(r"(?m)^(?=(?:第[一二三四五六七八九十百零\d]+[章条]|\d+(?:\.\d+)*\s))")


def pack(pieces: list[str], size: int) -> list[str]:
    """Joins consecutive pieces while they fit into ``size`` signs; longer ones are cut."""
    out: list[str] = []
    for piece in pieces:
        if out and len(out[-1]) + 1 + len(piece) <= size:
            out[-1] += "\n" + piece
        else:
            out += [piece[k : k + size] for k in range(0, len(piece), size)]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def clause_chunks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts split before clause headings and packed to 1200 signs."""
    for batch in texts:
        yield batch.map(lambda t: pack([p.strip() for p in _CLAUSE.split(t or "") if p.strip()], 1200))


@F.pandas_udf(T.StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition, which Spark SQL does not have."""
    for batch in texts:
        yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def salvage(text: str | None) -> str | None:
    """The first JSON value of a text: all of it, a fenced block, or the longest balanced braces."""
    tries = [text or "", *re.findall(r"```(?:json)?\s*(.*?)```", text or "", re.DOTALL)]
    decoder = json.JSONDecoder()
    for candidate in tries:
        try:
            return json.dumps(json.loads(candidate), ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    for match in re.finditer(r"[\[{]", text or ""):
        try:
            return json.dumps(decoder.raw_decode(text, match.start())[0], ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def salvage_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(salvage)


def natural_key(text: Column) -> Column:
    """A sort key in which runs of digits compare as numbers: each is padded to twelve digits."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")


def context(paragraphs: DataFrame, budget: int) -> DataFrame:
    """Paragraphs (doc_id, p, text) in order while their lengths sum to ``budget`` at most."""
    order = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return paragraphs.withColumn("_sum", F.sum(F.length("text")).over(order)).where(F.col("_sum") <= budget).drop("_sum")


@query(
    "x18_context",
    """WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
       SELECT doc_id, count(*) AS paragraphs, sum(length(line))::BIGINT AS characters FROM (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM l) WHERE s <= 1500 GROUP BY doc_id""",
)
def x18_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "text"))
    return context(lines, 1500).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("characters"))


@query("x12_clause_chunks")
def x12_clause_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(clause_chunks("text")).alias("chunk", "piece"))
    return chunks.select("doc_id", "chunk", F.length("piece").alias("size"), F.md5("piece").alias("digest"))


@query(
    "t08_natural_order",
    "SELECT source, row_number() OVER (ORDER BY regexp_extract(source, '^\\D*'), regexp_extract(source, '\\d+')::INT) AS place FROM (SELECT DISTINCT source FROM documents)",
)
def t08_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    return sources.select("source", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(natural_key(F.col("source")))).cast("long").alias("place"))


@query(
    "x06_mentions",
    f"SELECT doc_id, m AS mention, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{MENTIONS}')) AS m FROM documents) GROUP BY ALL",
)
def x06_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(MENTIONS), F.lit(0))).alias("mention")
    return table(spark, sf_dir, "documents").select("doc_id", found).groupBy("doc_id", "mention").agg(F.count("*").alias("n"))
