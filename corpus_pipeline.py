"""A corpus pipeline of five stages; counted as part of the subpackage ``llm``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``docs``.

Defined results: null and empty texts are scored by the bias alone, have no
near duplicates, hold no passage, and are sampled as their cell is; rows with a
null doc_id stay through near duplicates and are compared otherwise like
others; rows that repeat one doc_id are one document, which stays or goes
whole; null languages and sources form the value ``unknown``; an empty table
gives no rows; further columns travel along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.llm import decontamination, lsh_forest, mixing, token_store, toxicity
from quillspar.llm.common import Scratch, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on the labels, calls toxic."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every group of near duplicates the document with the smallest doc_id."""
    scratch = Scratch(spark, "dedup")
    found = lsh_forest.near_duplicates(scratch, docs.select("doc_id", "text"))
    dropped = scratch.keep(found.where("NOT kept").select(F.col("doc_id").alias("_dropped")).distinct(), "dropped")
    scratch.drop_all_but("dropped")
    return docs.join(dropped.hint("merge"), docs["doc_id"] == dropped["_dropped"], "left_anti")


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontamination.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics meet their tempered token shares."""
    return mixing.sample(Scratch(spark, "mix"), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token ids as range-coded frames and returns what is read back, per document."""
    return token_store.read_store(spark, token_store.write_store(Scratch(spark, "tokens"), docs, token_store.tokenizer_file()))


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", duplicates_out),
    ("decontamination", benchmark_out),
    ("mixing", mixed),
    ("token_store", encoded),
]

#: SQL cannot state the stages; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    scratch.drop_all_but(STAGES[-1][0])
    return docs
