"""Column profiles and statistics tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.registry import query
from quillspar.sources.tables import table


def number_profile(frame: DataFrame, name: str) -> DataFrame:
    """Valid, mismatched, missing and unique values of a column of text that should hold numbers, and their statistics."""
    text = F.trim(F.col(name).cast("string"))
    number = F.expr(f"try_cast(trim(cast({name} AS string)) AS double)")
    valid = F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")), number)
    blank = text.isNull() | (text == "")
    quantiles = [F.percentile(valid, p).alias(f"q{round(100 * p)}") for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
    return frame.agg(
        F.count(valid).alias("valid"), F.count_if(~blank & valid.isNull()).alias("mismatched"), F.count_if(blank).alias("missing"),
        F.countDistinct(valid).alias("unique"), F.round(F.avg(valid), 6).alias("mean"), F.round(F.stddev_pop(valid), 6).alias("std"), *quantiles,
    )


def text_profile(frame: DataFrame, name: str) -> DataFrame:
    """Lengths and counts of a text column in one pass."""
    col = F.col(name)
    blank = col.isNull() | (F.trim(col) == "")
    return frame.agg(
        F.count_if(~blank).alias("valid"), F.count_if(blank).alias("missing"), F.countDistinct(F.when(~blank, F.sha2(col, 256))).alias("unique"),
        F.min(F.when(~blank, F.length(col))).alias("shortest"), F.max(F.when(~blank, F.length(col))).alias("longest"),
    )


def top_values(frame: DataFrame, name: str, n: int = 5) -> DataFrame:
    """The most common values, ties by value."""
    return frame.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(n)


def equal_bins(frame: DataFrame, name: str, count: int = 10) -> DataFrame:
    """Bins of equal width between the smallest and largest value; one bin if they are equal."""
    ends = frame.agg(F.min(name).cast("double").alias("lo"), F.max(name).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / count
    bin_ = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(count - 1), F.floor((F.col(name) - F.col("lo")) / F.nullif(width, F.lit(0.0)))))
    placed = frame.where(F.col(name).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(bin_.cast("int").alias("bin"))
    return placed.agg(F.count("*").alias("n"))


def duplicates(frame: DataFrame, key, id_col: str) -> DataFrame:
    """Groups of several rows with equal ``key``, with their sorted ids."""
    grouped = frame.groupBy(key.alias("digest")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(id_col)).alias("ids"))
    return grouped.where("n > 1").select("digest", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(
    "a13_number_profile",
    """WITH v AS (SELECT CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 'n/a' ELSE value::VARCHAR END AS x FROM events), n AS (SELECT x, try_cast(x AS DOUBLE) AS d FROM v)
       SELECT count(d) AS valid, count(*) FILTER (x IS NOT NULL AND d IS NULL) AS mismatched, count(*) FILTER (x IS NULL) AS missing, count(DISTINCT d) AS unique,
       round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, quantile_cont(d, 0) AS q0, quantile_cont(d, .25) AS q25, quantile_cont(d, .5) AS q50, quantile_cont(d, .75) AS q75, quantile_cont(d, 1) AS q100 FROM n""",
)
def a13_number_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "view", "n/a").otherwise(F.col("value").cast("string"))
    return number_profile(table(spark, sf_dir, "events").select(mixed.alias("x")), "x")


@query(
    "a13_text_profile",
    """SELECT count(*) FILTER (trim(text) <> '') AS valid, count(*) FILTER (text IS NULL OR trim(text) = '') AS missing, count(DISTINCT text) FILTER (trim(text) <> '') AS unique,
       min(length(text))::INT AS shortest, max(length(text))::INT AS longest FROM documents""",
)
def a13_text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_profile(table(spark, sf_dir, "documents"), "text")


@query("a13_top_values", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 5")
def a13_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_values(table(spark, sf_dir, "part"), "p_type")


@query(
    "a14_equal_bins",
    """WITH e AS (SELECT min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM events)
       SELECT least(9, floor((value - lo) / ((hi - lo) / 10)))::INT AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1""",
)
def a14_equal_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_bins(table(spark, sf_dir, "events"), "value")


@query("a15_roll_up", "SELECT conv_id, count(*) AS chunks, arg_min(text, turn) AS title FROM conversations GROUP BY conv_id")
def a15_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("chunks"), F.min_by("text", "turn").alias("title"))


@query(
    "a16_summary",
    "SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS rows FROM lineitem",
)
def a16_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (("l_orderkey", "orders"), ("l_partkey", "parts"), ("l_suppkey", "suppliers"))
    return table(spark, sf_dir, "lineitem").agg(*[F.countDistinct(c).alias(n) for c, n in names], F.count("*").alias("rows"))


@query("a17_status", "SELECT count(*) AS n, count(*) FILTER (toxic IS NULL) AS unlabelled, count(DISTINCT lang) AS langs FROM documents LEFT JOIN labels USING (doc_id)")
def a17_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("toxic").isNull()).alias("unlabelled"), F.countDistinct("lang").alias("langs"))


@query("a18_months", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1")
def a18_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query(
    "a19_queue_status",
    """SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS documents, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS urgent FROM orders GROUP BY 1""",
)
def a19_queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("documents"), urgent)


@query("a20_recount", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS items FROM orders")
def a20_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(counts, "o_orderkey", "left").select("o_orderkey", F.coalesce("items", F.lit(0).cast("long")).alias("items"))


@query(
    "a21_review_statistics",
    """SELECT CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'modified' END AS decision, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM labels GROUP BY 1""",
)
def a21_review_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("modified")
    counts = table(spark, sf_dir, "labels").groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))


@query("a24_type_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a24_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    "a25_merge_candidates",
    """WITH k AS (SELECT p_type, p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g')) AS norm FROM part)
       SELECT p_type, norm, count(DISTINCT p_partkey) AS n, min(p_partkey) AS first_id FROM k GROUP BY ALL HAVING count(DISTINCT p_partkey) > 1""",
)
def a25_merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "")).alias("norm")
    grouped = table(spark, sf_dir, "part").groupBy("p_type", norm).agg(F.countDistinct("p_partkey").alias("n"), F.min("p_partkey").alias("first_id"))
    return grouped.where("n > 1")


@query(
    "a27_shortest",
    "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 20",
)
def a27_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(20)


@query(
    "a28_duplicate_bodies",
    """SELECT sha256(regexp_replace(text, '\\s+', '', 'g')) AS digest, count(*) AS n, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS ids
       FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def a28_duplicate_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"), F.sha2(F.regexp_replace("text", r"\s+", ""), 256), "doc_id")


@query(
    "a29_numeric_conflicts",
    """WITH n AS (SELECT lang, doc_id, unnest(regexp_extract_all(text, '[0-9]+ ?(%|kg|km|GB)')) AS m FROM documents)
       SELECT lang, regexp_replace(m, '[0-9 ]', '', 'g') AS unit, count(DISTINCT regexp_extract(m, '[0-9]+')) AS n_values, count(DISTINCT doc_id) AS pages FROM n GROUP BY ALL HAVING count(DISTINCT regexp_extract(m, '[0-9]+')) > 1""",
)
def a29_numeric_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all("text", F.lit("[0-9]+ ?(%|kg|km|GB)"), F.lit(0))).alias("m")
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", found)
    value, unit = F.regexp_extract("m", "[0-9]+", 0), F.regexp_replace("m", "[0-9 ]", "").alias("unit")
    return rows.groupBy("lang", unit).agg(F.countDistinct(value).alias("n_values"), F.countDistinct("doc_id").alias("pages")).where("n_values > 1")


@query(
    "a31_coverage_gap",
    "SELECT lang, count(*) AS documents, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS gap FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang",
)
def a31_coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("c"))
    rows = table(spark, sf_dir, "documents").join(covered, "doc_id", "left").groupBy("lang")
    return rows.agg(F.count("*").alias("documents"), F.count("c").alias("covered"), (F.count("*") - F.count("c")).alias("gap"))


@query(
    "a33_answer_score",
    """WITH s AS (SELECT c_nationkey AS q, list_sort(list(DISTINCT c_mktsegment)) AS given FROM customer WHERE c_acctbal > 0 GROUP BY 1),
       r AS (SELECT c_nationkey AS q, list_sort(list(DISTINCT c_mktsegment)) AS want FROM customer GROUP BY 1) SELECT q, given = want AS correct FROM s JOIN r USING (q)""",
)
def a33_answer_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    answers = lambda rows, name: rows.groupBy(F.col("c_nationkey").alias("q")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias(name))
    return answers(customers.where("c_acctbal > 0"), "given").join(answers(customers, "want"), "q").select("q", (F.col("given") == F.col("want")).alias("correct"))


@query(
    "a35_integrity",
    "SELECT bool_and(n_chars = length(text)) AS lengths_hold, count(*) AS rows, count(DISTINCT doc_id) AS ids, count(DISTINCT sha256(text)) AS bodies FROM documents",
)
def a35_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(
        F.every(F.col("n_chars") == F.length("text")).alias("lengths_hold"), F.count("*").alias("rows"),
        F.countDistinct("doc_id").alias("ids"), F.countDistinct(F.sha2("text", 256)).alias("bodies"),
    )
