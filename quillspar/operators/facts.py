"""Fact tables, registries and evidence: projections, routing, visibility, lookups and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.operators.joins import interval_pairs
from quillspar.operators.windows import cap_per_key, first_wins
from quillspar.registry import query
from quillspar.sources.tables import table


def fold_documents(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Facts of documents: chunks once each (the first wins), folded; the registry's title and date override.

    ``chunks`` (seq, chunk_id, doc_id, title, text), ``registry`` (doc_id, name, date).
    """
    once = first_wins(chunks.where("doc_id IS NOT NULL"), "chunk_id", "seq")
    folded = once.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"), F.min_by("title", "seq").alias("_title"))
    return folded.join(registry, "doc_id", "left").select("doc_id", "chunks", "characters", F.coalesce("name", "_title").alias("title"), "date")


def visible(status: Column, decision: Column, mode: str) -> Column:
    """Effective status under a review mode: people's decisions first, then a machine's, else pending; overridden ones are pending."""
    effective = F.when(status.isin("approved", "modified"), "approved").when(decision == "overridden", "pending").otherwise(F.coalesce(decision, F.lit("pending")))
    return {"approved": status.isin("approved", "modified"), "ai_preview": effective == "approved", "all": effective != "rejected"}[mode]


def route(frame: DataFrame) -> Column:
    """Document kind: declared type, else code prefix, else id prefix."""
    code = F.upper(F.coalesce("code", F.lit("")))
    by_code = F.when(code.rlike(r"^(GB|AQ|HG)"), "standard").when(code.rlike(r"^ORDER"), "regulation")
    by_id = F.when(F.col("doc_id").startswith("STD"), "standard").when(F.col("doc_id").startswith("ACC"), "accident")
    return F.coalesce(F.nullif(F.trim("kind"), F.lit("")), by_code, by_id, F.lit("unknown"))


def exact_quote(quote: Column, source: Column, target: Column, chunk: Column) -> Column:
    """The quote, white space aside, is at most 500 long, stands in the chunk and holds both ends."""
    plain = lambda c: F.regexp_replace(c, r"\s+", "")
    q = plain(quote)
    return (q != "") & (F.length(q) <= 500) & F.contains(plain(chunk), q) & F.contains(q, plain(source)) & F.contains(q, plain(target))


def insert_absent(registry: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return registry.unionByName(rows.join(registry.select(key), key, "left_anti"))


def set_status(registry: DataFrame, keys: DataFrame, key: str, status: str) -> DataFrame:
    marked = keys.select(key, F.lit(status).alias("_s")).distinct()
    return registry.join(marked, key, "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def best_source(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """For every wanted (id, name) the one file (file, title) of the highest score, if no other reaches it: equal names 3, prefixes 2."""
    joined = wanted.join(files.withColumn("p", F.lower(F.substring("title", 1, 4))), F.lower(F.substring("name", 1, 4)) == F.col("p"))
    score = F.when(F.lower("name") == F.lower("title"), 3).when(F.lower("title").startswith(F.lower("name")), 2).otherwise(1)
    order = Window.partitionBy("id").orderBy(F.desc("score"))
    ranked = joined.select("id", "file", score.alias("score")).withColumn("r", F.rank().over(order)).where("r = 1")
    return ranked.groupBy("id").agg(F.count("*").alias("n"), F.min("file").alias("file"), F.max("score").alias("score")).where("n = 1").drop("n")


@query(
    "f01_document_facts",
    """WITH c AS (SELECT conv_id AS doc_id, count(*) AS chunks, sum(length(text))::BIGINT AS characters, arg_min(role, turn) AS t FROM conversations GROUP BY 1)
       SELECT c.doc_id, chunks, characters, coalesce(CASE WHEN d.lang <> 'en' THEN d.source END, t) AS title, CASE WHEN d.lang <> 'en' THEN d.lang END AS date FROM c LEFT JOIN documents d USING (doc_id)""",
)
def f01_document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "conversations").select(F.col("turn").alias("seq"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("role").alias("title"), "text")
    registry = table(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id", F.col("source").alias("name"), F.col("lang").alias("date"))
    return fold_documents(chunks.unionByName(chunks), registry)


def holds_literally(text: Column, term: str) -> Column:
    """SQL LIKE for a term whose own ``%``, ``_`` and backslashes mean themselves."""
    escaped = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.like(text, F.lit(f"%{escaped}%"))


@query("f10_like", r"""SELECT event_id FROM events WHERE event_type LIKE '%\_%' ESCAPE '\' OR replace(props, ' ', '_') LIKE '%":\_1%' ESCAPE '\' OR replace(props, '3', '%') LIKE '%\%7%' ESCAPE '\'""")
def f10_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = holds_literally(F.replace("props", F.lit(" "), F.lit("_")), '":_1') | holds_literally(F.replace("props", F.lit("3"), F.lit("%")), "%7")
    return table(spark, sf_dir, "events").where(holds_literally(F.col("event_type"), "_") | marked).select("event_id")


@query("f11_optional_filters", "SELECT event_id FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k') = '3'")
def f11_optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = {"event_type": "click", "user_id": None, "k": "3"}
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    for name, value in asked.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.select("event_id")


@query(
    "f13_overlaps",
    """WITH i AS (SELECT o_custkey, o_orderkey, o_orderdate AS f, o_orderdate + INTERVAL 30 DAY AS t FROM orders)
       SELECT a.o_orderkey AS first, b.o_orderkey AS second FROM i a JOIN i b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.f < b.t AND b.f < a.t""",
)
def f13_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("f"), (F.col("o_orderdate") + F.expr("INTERVAL '30' DAY")).alias("t"))
    pairs = interval_pairs(spans, ["o_custkey"], "o_orderkey", "f", "t")
    return pairs.select(F.col("first.o_orderkey").alias("first"), F.col("second.o_orderkey").alias("second"))


@query(
    "f15_visibility",
    """SELECT count(*) FILTER (toxic = 0 AND quality = 1) AS approved, count(*) FILTER ((toxic = 0 AND quality = 1) OR lang = 'en') AS preview, count(*) FILTER ((toxic = 0 AND quality = 1) OR coalesce(lang <> 'fr', true)) AS every FROM documents LEFT JOIN labels USING (doc_id)""",
)
def f15_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when((F.col("toxic") == 0) & (F.col("quality") == 1), "approved").otherwise("none")
    machine = F.when(F.col("lang") == "en", "approved").when(F.col("lang") == "fr", "rejected").when(F.col("lang") == "de", "overridden")
    return rows.agg(*[F.count_if(visible(status, machine, mode)).alias(name) for mode, name in (("approved", "approved"), ("ai_preview", "preview"), ("all", "every"))])


@query("f17_exact_quote", "SELECT doc_id FROM documents WHERE length(regexp_replace(substr(text, 5, 60), '\\s+', '', 'g')) BETWEEN 1 AND 500 AND contains(regexp_replace(substr(text, 5, 60), '\\s+', '', 'g'), 'the') AND contains(regexp_replace(substr(text, 5, 60), '\\s+', '', 'g'), 'in')")
def f17_exact_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(exact_quote(F.substring("text", 5, 60), F.lit("the"), F.lit("in"), F.col("text"))).select("doc_id")


@query(
    "f22_routing",
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN p_type WHEN p_brand = 'Brand#1' THEN 'standard' WHEN p_brand = 'Brand#2' THEN 'accident' ELSE 'unknown' END AS kind FROM part""",
)
def f22_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") < 10, F.col("p_type")).otherwise(" ").alias("kind"), F.when(F.col("p_brand") == "Brand#1", "gb 12").alias("code"),
        F.when(F.col("p_brand") == "Brand#2", "ACC_1").otherwise("X").alias("doc_id"),
    )
    return rows.select("p_partkey", route(rows).alias("kind"))


@query(
    "f23_registry_edits",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'repealed' ELSE 'current' END AS status FROM customer""",
)
def f23_registry_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    keyed = lambda condition: rows.where(condition).select("c_custkey", F.lit("current").alias("status"))
    full = insert_absent(keyed("c_acctbal > 0"), keyed("c_acctbal > -100000"), "c_custkey")
    return set_status(full, rows.where("c_mktsegment = 'BUILDING'"), "c_custkey", "repealed")


@query("k15_node_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def k15_node_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("ring"))).select("p_partkey", "p_name")


@query(
    "k27_source_resolution",
    """WITH f AS (SELECT DISTINCT p_type || '/' || p_name AS file, p_name AS title FROM part), w AS (SELECT DISTINCT p_name AS id, p_name AS name FROM part),
       s AS (SELECT id, file, CASE WHEN lower(name) = lower(title) THEN 3 WHEN starts_with(lower(title), lower(name)) THEN 2 ELSE 1 END AS score FROM w JOIN f ON lower(substr(name, 1, 4)) = lower(substr(title, 1, 4))),
       r AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY score DESC) AS r FROM s) SELECT id, min(file) AS file, max(score)::INT AS score FROM r WHERE r = 1 GROUP BY id HAVING count(*) = 1""",
)
def k27_source_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    found = parts.select(F.concat_ws("/", "p_type", "p_name").alias("file"), F.col("p_name").alias("title")).distinct()
    return best_source(found, parts.select(F.col("p_name").alias("id"), F.col("p_name").alias("name")).distinct())


@query(
    "k11_two_hops",
    """WITH l AS (SELECT page, target FROM (SELECT page, target, row_number() OVER (PARTITION BY page ORDER BY target) AS r FROM (SELECT DISTINCT l_suppkey AS page, l_partkey % 200 + 1 AS target FROM lineitem WHERE l_discount = 0.1 AND l_suppkey <> l_partkey % 200 + 1)) WHERE r <= 8)
       SELECT page, target FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY target) AS r FROM (SELECT DISTINCT a.page, b.target FROM l a JOIN l b ON a.target = b.page WHERE a.page <> b.target)) WHERE r <= 8""",
)
def k11_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").where("l_discount = 0.1").select(F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 200 + 1).alias("target")).where("page <> target").distinct()
    capped = cap_per_key(links, ["page"], [F.col("target")], 8)
    second = capped.select(F.col("page").alias("target"), F.col("target").alias("further"))
    pairs = capped.join(second, "target").where("page <> further").select("page", F.col("further").alias("target")).distinct()
    return cap_per_key(pairs, ["page"], [F.col("target")], 8)


@query(
    "k21_rule_assertions",
    """WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9]+'))) AS object FROM documents)
       SELECT doc_id, 'mentions_contact' AS predicate, object, row_number() OVER (PARTITION BY doc_id ORDER BY object) AS seq FROM m
       UNION ALL SELECT doc_id, 'from_source', source, 1 FROM documents WHERE source IS NOT NULL""",
)
def k21_rule_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z0-9.]+@[a-z0-9]+"), F.lit(0)))).alias("object"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("object")).cast("long")
    mentions = found.select("doc_id", F.lit("mentions_contact").alias("predicate"), "object", number.alias("seq"))
    sources = docs.where("source IS NOT NULL").select("doc_id", F.lit("from_source").alias("predicate"), F.col("source").alias("object"), F.lit(1).cast("long").alias("seq"))
    return mentions.unionByName(sources)


@query(
    "k25_publish_gate",
    """SELECT conv_id, bool_and(length(text) >= 30) AND count(*) FILTER (role = 'assistant') > 0 AS publishable, count(*) FILTER (length(text) < 30) AS open FROM conversations GROUP BY conv_id""",
)
def k25_publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.length("text") >= 30
    ready = F.every(done) & (F.count_if(F.col("role") == "assistant") > 0)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(ready.alias("publishable"), F.count_if(~done).alias("open"))


@query(
    "j16_source_freshness",
    "SELECT d.doc_id, sha256(d.text) <> sha256(coalesce(b.text, '')) AS changed FROM documents d LEFT JOIN (SELECT doc_id, text FROM documents WHERE lang = 'en') b USING (doc_id)",
)
def j16_source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    now = docs.where("lang = 'en'").select("doc_id", F.sha2("text", 256).alias("now"))
    rows = docs.select("doc_id", F.sha2("text", 256).alias("cited")).join(now, "doc_id", "left")
    return rows.select("doc_id", (F.col("cited") != F.coalesce("now", F.sha2(F.lit(""), 256))).alias("changed"))


@query("a22_case_statistics", "SELECT count(*) FILTER (toxic = 1) AS failures, count(*) FILTER (toxic = 0) AS successes, count(*) FILTER (quality = 1 AND toxic = 0) AS verified FROM labels")
def a22_case_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad, good = F.col("toxic") == 1, F.col("toxic") == 0
    return table(spark, sf_dir, "labels").agg(F.count_if(bad).alias("failures"), F.count_if(good).alias("successes"), F.count_if(good & (F.col("quality") == 1)).alias("verified"))


@query("a26_review_counts", "SELECT conv_id, count(*) FILTER (role = 'assistant') AS approved, count(*) FILTER (role = 'system') AS rejected, count(*) - count(*) FILTER (role IN ('assistant', 'system')) AS pending FROM conversations GROUP BY 1")
def a26_review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda *roles: F.count_if(F.col("role").isin(*roles))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(n("assistant").alias("approved"), n("system").alias("rejected"), (F.count("*") - n("assistant", "system")).alias("pending"))


@query("a32_match_rates", "SELECT o_orderpriority AS method, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 4) AS rate FROM orders GROUP BY 1")
def a32_match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.count("*").alias("n"))
    return counts.withColumn("rate", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


@query(
    "t07_mixed_sort",
    """WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN event_type ELSE round(value, 2)::VARCHAR END AS v FROM events)
       SELECT event_id, row_number() OVER (ORDER BY v IS NULL, try_cast(v AS DOUBLE) IS NULL, try_cast(v AS DOUBLE), v, event_id) AS place FROM v ORDER BY place LIMIT 100""",
)
def t07_mixed_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a column of mixed kinds: numbers, then texts, then missing values."""
    n = F.col("event_id") % 4
    rows = table(spark, sf_dir, "events").select("event_id", F.when(n == 0, None).when(n == 1, F.col("event_type")).otherwise(F.round("value", 2).cast("string")).alias("v"))
    number = F.col("v").try_cast("double")
    top = rows.orderBy(F.col("v").isNull(), number.isNull(), number, "v", "event_id").limit(100)
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("v").isNull(), number.isNull(), number, "v", "event_id")
    return top.select("event_id", F.row_number().over(order).cast("long").alias("place"))
