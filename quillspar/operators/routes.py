"""Further facts, retrieval routes and text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.functions.scalars import news_date
from quillspar.functions.text import status_of, windows
from quillspar.operators.evidence import grounding
from quillspar.operators.linkage import indel_ratio, part_titles, score_titles
from quillspar.operators.windows import cap_per_key
from quillspar.registry import query
from quillspar.sources.tables import table
from quillspar.streaming.incremental import snapshot_signature

#: Labels shown in place of codes.
LABELS = {"F": "fulfilled", "O": "open"}


def named(value: Column, names: dict[str, str]) -> Column:
    """The label of a code, or the code itself."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value), value)


def search_tokens(text: Column, most: int = 1000) -> Column:
    """The second tokenizer: runs of two signs or more of a-z and digits, and pairs of Han signs, 1000 at most."""
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit("[a-z0-9]{2,}"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(r"[一-鿿]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.slice(F.concat(latin, pairs), 1, most)


def standard_code(text: Column) -> Column:
    """The first standard code of a text: letters, number and year with single signs between."""
    found = F.regexp_extract(F.upper(F.translate(text, "—–－_", "----")), r"\b([A-Z]{2,4}(?:/T)?)[ -]*(\d{2,}(?:\.\d+)?)-(\d{4})\b", 0)
    return F.nullif(F.regexp_replace(found, r"[ -]+", " "), F.lit(""))


def clean_title(text: Column) -> Column:
    """A title without brackets' contents, extensions and punctuation."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"\([^)]*\)|\[[^\]]*\]|（[^）]*）", " "), r"\.(pdf|docx?|txt)$", " ")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def graph_route(question: str, nodes: DataFrame, evidence: DataFrame, most: int = 30) -> DataFrame:
    """Evidence (node, chunk) of nodes (node, label) whose label of two signs or more stands in the question, one a chunk."""
    hit = nodes.where((F.length("label") >= 2) & F.contains(F.lit(question.lower()), F.lower("label")))
    once = hit.join(evidence, "node").groupBy("chunk").agg(F.min("node").alias("node"))
    return once.orderBy("chunk").limit(most)


@query("f03_news_facts", "SELECT event_id, event_type, json_extract_string(props, '$.k') AS country, strftime(ts, '%Y-%m-%d') AS published FROM events WHERE event_type <> 'error'")
def f03_news_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return live.select("event_id", "event_type", F.get_json_object("props", "$.k").alias("country"), F.date_format("ts", "yyyy-MM-dd").alias("published"))


@query("f05_labels", "SELECT CASE o_orderstatus WHEN 'F' THEN 'fulfilled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS label, count(*) AS n FROM orders GROUP BY 1")
def f05_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(named(F.col("o_orderstatus"), LABELS).alias("label")).agg(F.count("*").alias("n"))


@query("f14_excluded_sources", "SELECT doc_id FROM documents WHERE coalesce(source, '') NOT IN ('src3', 'src7')")
def f14_excluded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(~F.coalesce("source", F.lit("")).isin("src3", "src7")).select("doc_id")


@query("a23_registry_statistics", "SELECT count(*) AS total, count(*) FILTER (c_acctbal > 0) AS active, count(DISTINCT c_nationkey) AS places FROM customer")
def a23_registry_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("active"), F.countDistinct("c_nationkey").alias("places"))


@query("a30_distribution", "SELECT lang, count(*) AS n, sum(CASE WHEN text IS NULL OR text = '' THEN 1 ELSE 0 END)::BIGINT AS empty FROM documents GROUP BY lang")
def a30_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.count_if(F.col("text").isNull() | (F.col("text") == ""))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), empty.alias("empty"))


@query("a34_sources_per_label", "SELECT p_type, p_brand, count(*) AS chapters FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') ON p_partkey = l_partkey GROUP BY ALL")
def a34_sources_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(returned, "p_partkey", "left_semi").groupBy("p_type", "p_brand").agg(F.count("*").alias("chapters"))


@query(
    "a36_progress",
    "SELECT 'orders' AS queue, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'items', l_linestatus, count(*) FROM lineitem GROUP BY ALL",
)
def a36_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lambda name, queue, column: table(spark, sf_dir, name).groupBy(F.lit(queue).alias("queue"), F.col(column).alias("status")).agg(F.count("*").alias("n"))
    return counted("orders", "orders", "o_orderstatus").unionByName(counted("lineitem", "items", "l_linestatus"))


@query("t04_details", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY coalesce(strftime(o_orderdate, '%Y-%m-%d'), '') DESC, o_orderkey DESC LIMIT 100")
def t04_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return rows.orderBy(F.desc(F.coalesce("day", F.lit(""))), F.desc("o_orderkey")).limit(100)


@query("t05_scatter", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 300")
def t05_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(300)


@query("x02_search_tokens", "SELECT doc_id, least(1000, len(regexp_extract_all(lower(text), '[a-z0-9]{2,}')))::INT AS tokens FROM documents")
def x02_search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(search_tokens(F.col("text"))).alias("tokens"))


@query("x08_standard_codes", "SELECT p_partkey, CASE WHEN p_size < 20 THEN 'GB/T ' || (p_partkey + 10) || ' 2010' END AS code FROM part")
def x08_standard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("see gb/t"), F.when(F.col("p_size") < 20, F.concat(F.lit(" "), F.col("p_partkey") + 10, F.lit("—2010"))).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", standard_code(title).alias("code"))


@query("x09_clean_titles", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS title FROM part")
def x09_clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", clean_title(F.concat(F.lit("(x) "), "p_name", F.lit(" [y].pdf"))).alias("title"))


@query("x17_ingest_chunks", "SELECT doc_id, (s // 1800)::INT AS chunk, md5(substr(text, s + 1, 1800)) AS digest FROM (SELECT doc_id, text, unnest(range(0, length(text), 1800)) AS s FROM documents WHERE length(text) > 0)")
def x17_ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(table(spark, sf_dir, "documents"), 1800, 0, tail=True).select("doc_id", "chunk", F.md5("piece").alias("digest"))


@query(
    "x23_grounding",
    "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'model_prior' WHEN role = 'user' OR NOT contains(trim(text, chr(10)), chr(10)) THEN 'grounded' ELSE 'mixed' END AS kind FROM conversations WHERE trim(text) <> ''",
)
def x23_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cite = F.lit("[Wiki证据1]")
    content = F.when(F.col("role") == "system", F.col("text")).when(F.col("role") == "user", F.concat(F.regexp_replace("text", "\n", " "), cite)).otherwise(F.concat(cite, F.ltrim("text")))
    return table(spark, sf_dir, "conversations").where("trim(text) <> ''").select("conv_id", "turn", grounding(content).alias("kind"))


@query("x26_status", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'repealed' WHEN 'O' THEN 'current' ELSE 'unknown' END AS status FROM orders")
def x26_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("o_orderstatus") == "F", "已废止").when(F.col("o_orderstatus") == "O", "现行有效").otherwise("?")
    return table(spark, sf_dir, "orders").select("o_orderkey", status_of(written).alias("status"))


@query("e03_news_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def e03_news_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    written = F.when(k == 0, F.date_format("o_orderdate", "yyyy年M月d日")).when(k == 1, F.date_format("o_orderdate", "MMMM d, yyyy")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(news_date(written), "yyyy-MM-dd").alias("day"))


@query("k04_graph_route", "SELECT c_custkey AS chunk, c_nationkey AS node FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains('urgent orders of nation_3 and nation_17', lower(n_name)) ORDER BY chunk LIMIT 30")
def k04_graph_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("label"))
    evidence = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("node"), F.col("c_custkey").alias("chunk"))
    return graph_route("Urgent orders of NATION_3 and NATION_17", nodes, evidence)


@query(
    "k10_published_search",
    "SELECT doc_id, hits FROM (SELECT doc_id, (contains(lower(text), 'with')::INT + contains(lower(text), 'from')::INT)::INT AS hits FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)) WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 50",
)
def k10_published_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    has = lambda w: F.contains(F.lower("text"), F.lit(w)).cast("int")
    rows = table(spark, sf_dir, "documents").join(published, "doc_id", "left_semi").select("doc_id", (has("with") + has("from")).alias("hits"))
    return rows.where("hits > 0").orderBy(F.desc("hits"), "doc_id").limit(50)


@query(
    "k30_static_audit",
    "SELECT d.doc_id, CASE WHEN length(text) < 30 THEN 'short' WHEN NOT regexp_matches(text, '[.!?]') THEN 'no_sentence' ELSE 'ok' END AS flag FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL",
)
def k30_static_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    flag = F.when(F.length("text") < 30, "short").when(~F.col("text").rlike("[.!?]"), "no_sentence").otherwise("ok")
    return open_.select("doc_id", flag.alias("flag"))


@query("s08_signature")
def s08_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_signature(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source", "n_chars")


@query("j13_best_title")
def j13_best_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_titles(*part_titles(spark, sf_dir), 70.0, indel_ratio)
    return scored.groupBy("id").agg(F.max_by("rid", F.struct("score", "rid")).alias("rid"), F.max("score").alias("score"))


@query("j14_repair", "SELECT l_orderkey, count(*) AS items, bool_or(o_orderkey IS NULL) AS failed FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey GROUP BY 1")
def j14_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("known"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"))
    return items.join(master, "l_orderkey", "left").select("l_orderkey", "items", F.col("known").isNull().alias("failed"))


@query(
    "k06_rerank",
    "SELECT event_type, event_id, score FROM (SELECT event_type, event_id, round(value * 2 + user_id % 10, 6) AS score, row_number() OVER (PARTITION BY event_type ORDER BY round(value * 2 + user_id % 10, 6) DESC, event_id) AS r FROM events) WHERE r <= 5",
)
def k06_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(F.col("value") * 2 + F.col("user_id") % 10, 6).alias("score")
    return cap_per_key(table(spark, sf_dir, "events").select("event_type", "event_id", score), ["event_type"], [F.desc("score"), F.col("event_id")], 5)


@query("k33_quiz_sample")
def k33_quiz_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten questions a nation, in an order drawn from a seed and the question's id; sampling is the feature."""
    drawn = F.xxhash64("c_custkey", F.lit(7))
    order = Window.partitionBy("c_nationkey").orderBy("drawn", "c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", drawn.alias("drawn")).withColumn("place", F.row_number().over(order))
    return rows.where("place <= 10").select("c_nationkey", "place", "c_custkey")
