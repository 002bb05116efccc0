"""Evidence and wiki texts: sections, citations, mentions, disambiguation, recovery of quotes."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspar.operators.windows import cap_per_key
from quillspar.registry import query
from quillspar.sources.tables import table


def sections(pages: DataFrame) -> DataFrame:
    """(page, section, heading, body) of texts with headings that begin with ``## ``; what stands before the first is left out."""
    parts = F.split(F.concat(F.lit("\n"), "text"), r"\n## ", -1)
    rows = pages.select("page", F.posexplode(parts).alias("section", "part")).where("section > 0")
    return rows.select("page", "section", F.substring_index("part", "\n", 1).alias("heading"), F.trim(F.regexp_replace("part", r"^[^\n]*\n?", "")).alias("body"))


def grounding(content: Column) -> Column:
    """grounded if every paragraph cites evidence, mixed if some does, model_prior if none."""
    paragraphs = F.filter(F.split(content, r"\n+"), lambda p: F.trim(p) != "")
    cites = lambda p: p.rlike(r"\[Wiki证据\d+\]")
    return F.when((F.size(paragraphs) > 0) & F.forall(paragraphs, cites), "grounded").when(F.exists(paragraphs, cites), "mixed").otherwise("model_prior")


def changed_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """(page, heading, change) of two versions of sections: added, removed or edited."""
    a = old.select("page", "heading", F.sha2("body", 256).alias("before"))
    b = new.select("page", "heading", F.sha2("body", 256).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "edited")
    return a.join(b, ["page", "heading"], "full").select("page", "heading", change.alias("change")).where("change IS NOT NULL")


@F.pandas_udf(T.StringType())
def unified_diff(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The unified diff of two texts (null: empty) by lines, with three lines of context and the names of both; empty if they are equal."""

    def one(before: str | None, after: str | None, old: str, new: str) -> str:
        return "".join(difflib.unified_diff((before or "").splitlines(True), (after or "").splitlines(True), fromfile=old, tofile=new))

    for batch in rows:
        yield pd.Series([one(*row) for row in zip(*batch)])


def compare(revisions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page, before, after, diff) of the stated pairs of revisions (page, revision, text); a revision that is not there is an empty text."""
    text = lambda side: revisions.select("page", F.col("revision").alias(side), F.col("text").alias(f"{side}_text"))
    both = pairs.select("page", "before", "after").join(text("before"), ["page", "before"], "left").join(text("after"), ["page", "after"], "left")
    return both.select("page", "before", "after", unified_diff("before_text", "after_text", F.col("before").cast("string"), F.col("after").cast("string")).alias("diff"))


def recovered(relations: DataFrame, bodies: DataFrame, gap: int = 500, keep: int = 5) -> DataFrame:
    """Passages that name both ends of a relation (rid, doc_id, source, target) within ``gap`` signs, the closest first.

    Relations name their document, so the join is by equality; both ends are then looked for in its text.
    """
    low = F.lower("text")
    a, b = F.instr(low, F.lower("source")), F.instr(low, F.lower("target"))
    rows = relations.join(bodies, "doc_id").select("rid", "doc_id", a.alias("a"), b.alias("b")).where("a > 0 AND b > 0")
    near = rows.withColumn("gap", F.abs(F.col("a") - F.col("b"))).where(F.col("gap") <= gap)
    return cap_per_key(near, ["rid"], [F.col("gap"), F.col("doc_id")], keep)


def mapped(predicate: Column, rules: list[tuple[str, Column, str]]) -> Column:
    """A predicate by the first rule (surface, condition, result) that holds, else itself."""
    out = F
    for surface, condition, result in rules:
        out = out.when((predicate == surface) & condition, F.lit(result))
    return out.otherwise(predicate)


@query(
    "x22_sections",
    """WITH p AS (SELECT conv_id AS page, string_agg('## ' || role || ' ' || turn || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1)
       SELECT page, len(string_split(chr(10) || text, chr(10) || '## ')) - 1 AS sections, md5(text) AS digest FROM p""",
)
def x22_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.concat(F.lit("## "), "role", F.lit(" "), "turn", F.lit("\n"), "text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]), "\n")
    pages = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("page")).agg(text.alias("text"))
    counted = sections(pages).groupBy("page").agg(F.count("*").alias("sections"))
    return pages.join(counted, "page").select("page", "sections", F.md5("text").alias("digest"))


@query(
    "x24_changed_sections",
    """WITH a AS (SELECT conv_id AS page, turn::VARCHAR AS heading, text AS body FROM conversations WHERE role <> 'system'), b AS (SELECT conv_id AS page, turn::VARCHAR AS heading, CASE WHEN role = 'user' THEN upper(text) ELSE text END AS body FROM conversations)
       SELECT coalesce(a.page, b.page) AS page, coalesce(a.heading, b.heading) AS heading, CASE WHEN a.body IS NULL THEN 'added' WHEN b.body IS NULL THEN 'removed' ELSE 'edited' END AS change FROM a FULL JOIN b ON a.page = b.page AND a.heading = b.heading WHERE a.body IS DISTINCT FROM b.body""",
)
def x24_changed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").cast("string").alias("heading"), F.col("text").alias("body"), "role")
    new = rows.withColumn("body", F.when(F.col("role") == "user", F.upper("body")).otherwise(F.col("body")))
    return changed_sections(rows.where("role <> 'system'"), new)


@query("x24_unified_diff")
def x24_unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a page with a line for each turn, against itself without system turns and with shouted questions."""
    rows = table(spark, sf_dir, "conversations")
    line = lambda body: F.concat(F.lit("## "), "role", F.lit("\n"), body, F.lit("\n"))
    page = lambda lines: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", lines.alias("line")))), lambda t: t["line"]), "")
    second = line(F.when((F.col("role") == "user") & (F.col("turn") < 4), F.upper("text")).otherwise(F.col("text")))
    first, later = rows.groupBy("conv_id").agg(page(line(F.col("text"))).alias("text")), rows.where("role <> 'system'").groupBy("conv_id").agg(page(second).alias("text"))
    shape = lambda frame, number: frame.select(F.col("conv_id").alias("page"), F.lit(number).alias("revision"), "text")
    pairs = rows.select(F.col("conv_id").alias("page")).distinct().select("page", F.lit(1).alias("before"), F.lit(2).alias("after"))
    return compare(shape(first, 1).unionByName(shape(later, 2)), pairs)


@query(
    "k29_recovery",
    """WITH r AS (SELECT doc_id AS rid, doc_id, lang AS source, CASE WHEN source = 'src1' THEN 'of' ELSE 'in' END AS target FROM documents),
       p AS (SELECT rid, doc_id, instr(lower(text), lower(r.source)) AS a, instr(lower(text), target) AS b FROM r JOIN (SELECT doc_id, text FROM documents) USING (doc_id))
       SELECT rid, doc_id, a::INT AS a, b::INT AS b, abs(a - b)::INT AS gap FROM p WHERE a > 0 AND b > 0 AND abs(a - b) <= 500""",
)
def k29_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    target = F.when(F.col("source") == "src1", "of").otherwise("in")
    relations = docs.select(F.col("doc_id").alias("rid"), "doc_id", F.col("lang").alias("source"), target.alias("target"))
    return recovered(relations, docs.select("doc_id", "text"))


@query(
    "e21_predicates",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'direct_cause' WHEN o_orderstatus = 'F' THEN 'indirect_cause' WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'governs' ELSE o_orderstatus END AS predicate FROM orders""",
)
def e21_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("F", F.col("o_totalprice") > 100000, "direct_cause"), ("F", F.lit(True), "indirect_cause"), ("O", F.col("o_orderpriority") == "1-URGENT", "governs")]
    return table(spark, sf_dir, "orders").select("o_orderkey", mapped(F.col("o_orderstatus"), rules).alias("predicate"))


@query(
    "j19_catalogue",
    """SELECT c_mktsegment AS name, r_name AS document, count(DISTINCT n_name) AS pages, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS listed FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def j19_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    names = F.array_sort(F.collect_set("n_name"))
    return rows.groupBy(F.col("c_mktsegment").alias("name"), F.col("r_name").alias("document")).agg(F.size(names).cast("long").alias("pages"), F.array_join(names, ",").alias("listed"))


@query(
    "j20_pattern_join",
    """SELECT n_name AS node, o_orderpriority AS edge, count(*) AS evidence FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE contains('which of NATION_3, NATION_7 has urgent orders', n_name) OR contains(lower(n_name), '1') GROUP BY ALL""",
)
def j20_pattern_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = F.lit("which of NATION_3, NATION_7 has urgent orders")
    nodes = table(spark, sf_dir, "nation").where(F.contains(question, F.col("n_name")) | F.contains(F.lower("n_name"), F.lit("1")))
    edges = nodes.join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return edges.groupBy(F.col("n_name").alias("node"), F.col("o_orderpriority").alias("edge")).agg(F.count("*").alias("evidence"))


@query(
    "t13_excerpts",
    """WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
       s AS (SELECT doc_id, p, contains(lower(line), 'with')::INT + contains(lower(line), 'from')::INT + contains(lower(line), 'token')::INT AS hits FROM l)
       SELECT doc_id, p::INT AS p, hits::INT AS hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, p) AS r FROM s) WHERE r = 1 AND hits > 0""",
)
def t13_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line with the most keywords, found inside each row; of equals the first."""
    words = F.array(*map(F.lit, ("with", "from", "token")))
    scored = F.transform(F.split("text", "\n", -1), lambda line, p: F.struct((-F.size(F.filter(words, lambda w: F.contains(F.lower(line), w)))).alias("h"), p.alias("p")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_min(scored).alias("best")).where("best.h < 0")
    return rows.select("doc_id", F.col("best.p").alias("p"), (-F.col("best.h")).alias("hits"))


@query(
    "t10_case_top",
    """SELECT case_type, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY case_type ORDER BY score DESC, doc_id) AS r FROM (SELECT CASE WHEN toxic = 1 THEN 'failure' ELSE 'success' END AS case_type, doc_id, round((n_chars % 100) / 100.0 + CASE WHEN source = 'src3' THEN 0.05 ELSE 0 END, 4) AS score FROM labels JOIN documents USING (doc_id) WHERE quality = 1)) WHERE r <= 3""",
)
def t10_case_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").where("quality = 1").join(table(spark, sf_dir, "documents"), "doc_id")
    score = F.round((F.col("n_chars") % 100) / 100.0 + F.when(F.col("source") == "src3", 0.05).otherwise(0.0), 4).alias("score")
    scored = rows.select(F.when(F.col("toxic") == 1, "failure").otherwise("success").alias("case_type"), "doc_id", score)
    return cap_per_key(scored, ["case_type"], [F.desc("score"), F.col("doc_id")], 3)


@query(
    "w07_preview",
    """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'""",
)
def w07_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last decision per assertion; an override as the last one hides it."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(newest)).where("r = 1 AND event_type <> 'error'")
    return last.select("user_id", "event_id")
