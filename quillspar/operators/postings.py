"""A stored keyword index: postings in blocks that know their best weight, and top k by skipping blocks.

Documents are put in the order of their numbers of terms and cut into blocks of
BLOCK. A row of the index is a term in a block: the documents that hold it, and the
largest weight that any of them can give. Short documents weigh more, so the blocks
with large weights lie together. Rows are dealt into folders by the term's hash, so a
search opens the folders of its terms only.

A search reads the heads of its terms' rows (no documents), adds their bounds up for
every block, scores the k best-bounded blocks exactly, and then reads only blocks
whose bound reaches the k-th score. Nothing else can hold a better document. How much
that spares depends on the texts: where the question's words gather in few of them,
most blocks are skipped; where all words are dealt at random, hardly any.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.functions.text import terms
from quillspar.operators.retrieval import B, K1, MAX_TERMS
from quillspar.registry import query
from quillspar.sources.shared import dealt, shared_dir
from quillspar.sources.tables import table

#: Documents of a block, folders by the terms' hash, parts that the blocks of one folder are written in.
BLOCK, FOLDERS, PARTS = 16, 64, 8
#: What a bound may fall short of a score that is equal when rounded to six digits.
SLACK = 2e-6


@dataclass
class Index:
    """A folder with the tables ``placed`` (documents in their blocks), ``postings``, ``frequencies`` (documents of a term) and ``statistics``."""

    spark: SparkSession
    path: str

    def postings(self, wanted: list[str]) -> DataFrame:
        """The rows of some terms: folder, term, block, df, weight (the best of the block) and docs."""
        hashes = self.spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(term)), F.lit(FOLDERS)).alias(str(k)) for k, term in enumerate(wanted)]).first()
        kind = dict(self.spark.read.parquet(f"{self.path}/placed").dtypes)["doc_id"]
        schema = f"term string, block long, weight double, docs array<struct<doc_id: {kind}, weight: double>>, folder int"
        asked = F.col("folder").isin(sorted(set(hashes))) & F.col("term").isin(wanted)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/postings").where(asked)
        frequency = self.spark.read.schema("term string, df long, folder int").parquet(f"{self.path}/frequencies").where(asked)
        return rows.join(F.broadcast(frequency), ["folder", "term"])  # a row for each of the terms


def build(documents: DataFrame, path: str) -> Index:
    """Writes the index of (doc_id, text) below ``path``. A document holds each term once; one without terms is counted, no more."""
    spark = documents.sparkSession
    cut = documents.select("doc_id", terms(F.col("text")).alias("terms")).withColumn("dl", F.size("terms").cast("long"))
    placed = cut.repartitionByRange("dl", "doc_id").sortWithinPartitions("dl", "doc_id").withColumn("at", F.monotonically_increasing_id())
    placed.withColumn("block", F.floor(F.col("at") / BLOCK)).drop("at").write.parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    placed.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("average")).write.parquet(f"{path}/statistics")
    known = spark.read.parquet(f"{path}/statistics").first()
    weight = (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / F.lit(known.average or 1.0)))
    # A block's documents meet once, with their lists of terms; its rows are made there and shuffled once, to where they are written.
    met = dealt(placed.select("block", "doc_id", weight.alias("weight"), "terms"), known.n_docs, "block", each=20_000)
    found = met.select("block", "doc_id", "weight", F.explode("terms").alias("term"))
    blocks = found.groupBy("block", "term").agg(F.max("weight").alias("weight"), F.array_sort(F.collect_list(F.struct("doc_id", "weight"))).alias("docs"))
    rows = blocks.withColumns({"n": F.size("docs"), "folder": F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int")})
    # A frequent term's blocks are in all parts of its folder, so none of them waits for one task.
    rows = rows.repartition("folder", F.pmod("block", F.lit(PARTS))).sortWithinPartitions("folder", "term", "block")
    rows.write.partitionBy("folder").parquet(f"{path}/postings")
    written = spark.read.schema("term string, n int, folder int").parquet(f"{path}/postings")
    frequency = written.groupBy("folder", "term").agg(F.sum("n").alias("df"))
    frequency.repartition("folder").sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{path}/frequencies")
    return Index(spark, path)


def _bounded(index: Index, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """The terms' rows with their idf, and (block, bound) of all blocks that hold any of them."""
    n_docs = index.spark.read.parquet(f"{index.path}/statistics").first().n_docs
    idf = F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = index.postings(wanted).withColumn("idf", F.when(idf > 0, idf).otherwise(F.lit(1e-6)))
    return rows, rows.groupBy("block").agg(F.sum(F.col("idf") * F.col("weight")).alias("bound"))


def _scored(rows: DataFrame) -> DataFrame:
    each = rows.select("idf", F.explode("docs").alias("d"))
    return each.groupBy(F.col("d.doc_id").alias("doc_id")).agg(F.sum(F.col("idf") * F.col("d.weight")).alias("score"))


def survivors(index: Index, question: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """The rows that a search must read, and all rows of its terms."""
    wanted = list(dict.fromkeys(question))[:MAX_TERMS]
    rows, bounds = _bounded(index, wanted)
    # Every block holds a match, so the k best-bounded ones hold k candidates; k blocks are a broadcast of k rows.
    best = bounds.orderBy(F.desc("bound"), "block").limit(k).select("block")
    scores = _scored(rows.join(F.broadcast(best), "block", "left_semi")).orderBy(F.desc("score")).limit(k)
    least = scores.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    threshold = least.least - SLACK if least.n == k else 0.0
    reach = bounds.where(F.col("bound") >= threshold)
    ends = reach.agg(F.min("block").alias("first"), F.max("block").alias("last")).first()
    if ends.first is None:
        return rows.limit(0), rows
    # The range of the blocks prunes files and row groups, the join what is left.
    near = rows.where(F.col("block").between(ends.first, ends.last))
    return near.join(reach.select("block"), "block", "left_semi"), rows


def search(index: Index, question: list[str], k: int) -> DataFrame:
    """(doc_id, score): the k best documents for the first 24 distinct terms, ties to the smaller doc_id."""
    read, _ = survivors(index, question, k)
    return _scored(read).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


_QUESTION = (
    "license", "with", "this", "password", "token", "the", "software", "granted", "copy", "permission", "secret", "api", "key", "email", "warranty", "and", "under", "version", "free",
    "notice", "threat", "onth", "whonth", "ered",
)
_TERMS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@query(
    "k01_block_postings",
    f"""WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
        p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d), h AS (SELECT * FROM p WHERE term IN {_QUESTION}), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
        SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / a))) AS score
        FROM h JOIN f USING (term), s GROUP BY doc_id) ORDER BY round(score, 6) DESC, doc_id LIMIT 20""",
)
def k01_block_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents is written, and 24 terms are searched in it."""
    index = build(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    return search(index, list(_QUESTION), 20)
