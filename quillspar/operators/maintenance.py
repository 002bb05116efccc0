"""Upkeep of graphs and wikis: merges into a property graph, lint findings, cases from reviews, selective copies, network summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.functions.extraction import _reports, annotations
from quillspar.operators.knowledge import _ASSERTIONS, assertions_of
from quillspar.registry import query
from quillspar.sources.tables import table

#: Links between wiki pages, and the marks of evidence that duplicates are compared without.
LINK, EVIDENCE_MARK = r"\[\[([^\]|\n]+)\]\]", r"\s+|\[Wiki证据\d+\]"


def graph_merge(nodes: DataFrame, edges: DataFrame, assertions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, type) and edges (assertion_id, src, predicate, dst, status) of a property graph after a merge.

    Nodes are one an id and edges one an assertion; of several statements the latest holds. An assertion without subject or predicate is
    skipped; one with a literal, or without an object, makes its subject's node alone. Edges of assertions that were withdrawn are deleted.
    ``assertions`` (seq, assertion_id, subject, subject_name, subject_type, predicate, object, object_name, object_type, object_kind, status).
    """
    usable = assertions.where((F.coalesce("subject", F.lit("")) != "") & (F.coalesce("predicate", F.lit("")) != "") & (F.col("status") != "withdrawn"))
    linked = usable.where((F.coalesce("object_kind", F.lit("")) != "literal") & (F.coalesce("object", F.lit("")) != ""))
    said = [rows.select(F.col(side).alias("id"), F.coalesce(f"{side}_name", side).alias("name"), F.col(f"{side}_type").alias("type"), "seq") for rows, side in ((usable, "subject"), (linked, "object"))]
    old = nodes.select("id", "name", "type", F.lit(-1).cast("long").alias("seq"))
    every = old.unionByName(said[0]).unionByName(said[1])
    # Of one statement the object is written after the subject; equal ones do not differ.
    merged = every.groupBy("id").agg(F.max_by(F.struct("name", "type"), F.struct("seq", "name", "type")).alias("n")).select("id", "n.*")
    last = linked.groupBy("assertion_id").agg(F.max_by(F.struct(F.col("subject").alias("src"), "predicate", F.col("object").alias("dst"), "status"), "seq").alias("e")).select("assertion_id", "e.*")
    touched = assertions.where("status = 'withdrawn'").select("assertion_id").union(last.select("assertion_id"))
    return merged, edges.join(touched, "assertion_id", "left_anti").unionByName(last)


_SINK = f"""{_ASSERTIONS}, x AS (SELECT seq, seq % 5000 AS assertion_id, subject, predicate, object, CASE WHEN ot = 'clause' THEN 'literal' ELSE 'entity' END AS kind,
  CASE WHEN status = 'rejected' THEN 'withdrawn' ELSE status END AS status FROM a), u AS (SELECT * FROM x WHERE coalesce(subject, '') <> '' AND status <> 'withdrawn'), l AS (SELECT * FROM u WHERE kind <> 'literal')"""


def _sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assertions_of(spark, sf_dir)
    kind = F.when(F.col("object_type") == "clause", "literal").otherwise("entity")
    status = F.when(F.col("status") == "rejected", "withdrawn").otherwise(F.col("status"))
    return rows.select("seq", (F.col("seq") % 5000).alias("assertion_id"), "subject", F.col("subject").alias("subject_name"), F.lit("t").alias("subject_type"), "predicate", "object", F.col("object").alias("object_name"), F.lit("t").alias("object_type"), kind.alias("object_kind"), status.alias("status"))


@query(
    "s17_graph_merge",
    f"""WITH {_SINK}, e AS (SELECT assertion_id, arg_max(subject, seq) AS src, arg_max(predicate, seq) AS predicate, arg_max(object, seq) AS dst FROM l GROUP BY 1),
        o AS (SELECT o_custkey AS assertion_id, 'old' AS src, 'kept' AS predicate, 'old' AS dst FROM orders GROUP BY o_custkey)
        SELECT * FROM e UNION ALL SELECT * FROM o WHERE assertion_id NOT IN (SELECT assertion_id FROM x WHERE status = 'withdrawn' UNION SELECT assertion_id FROM e)""",
)
def s17_graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after a merge into a graph that has one old edge a customer."""
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("assertion_id"), F.lit("old").alias("src"), F.lit("kept").alias("predicate"), F.lit("old").alias("dst"), F.lit("approved").alias("status")).distinct()
    nodes = spark.createDataFrame([], "id string, name string, type string")
    return graph_merge(nodes, old, _sink(spark, sf_dir))[1].drop("status")


@query("s17_graph_nodes", f"WITH {_SINK} SELECT subject AS id FROM u UNION SELECT object FROM l")
def s17_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], "id string, name string, type string"), spark.createDataFrame([], "assertion_id long, src string, predicate string, dst string, status string")
    return graph_merge(*empty, _sink(spark, sf_dir))[0].select("id")


def wiki_lint(pages: DataFrame, invalid: DataFrame, freshness: DataFrame, pending: DataFrame) -> DataFrame:
    """Findings (page, type, detail): invalid, stale or needs_check, pending, broken_link, duplicate of the first page with the same body, link_gap.

    ``pages`` (page, kind, markdown), ``invalid`` (page, error), ``freshness`` (page, state), ``pending`` (page, sections); source pages need no links.
    """
    links = pages.select("page", F.explode(F.array_distinct(F.regexp_extract_all("markdown", F.lit(LINK), F.lit(1)))).alias("target"))
    broken = links.join(pages.select(F.col("page").alias("target")), "target", "left_anti").select("page", F.lit("broken_link").alias("type"), F.col("target").alias("detail"))
    bodies = pages.select("page", F.sha2(F.regexp_replace("markdown", EVIDENCE_MARK, ""), 256).alias("body"))
    first = bodies.groupBy("body").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = bodies.join(first, "body").where("page <> first").select("page", F.lit("duplicate").alias("type"), F.col("first").alias("detail"))
    gap = pages.where((F.col("kind") != "source") & ~F.col("markdown").rlike(LINK)).select("page", F.lit("link_gap").alias("type"), F.lit("").alias("detail"))
    old = freshness.where("state <> 'fresh'").select("page", F.col("state").alias("type"), F.lit("").alias("detail"))
    wrong = invalid.select("page", F.lit("invalid").alias("type"), F.col("error").alias("detail"))
    waiting = pending.where("sections > 0").select("page", F.lit("pending").alias("type"), F.col("sections").cast("string").alias("detail"))
    found = wrong
    for more in (old, waiting, broken, same, gap):
        found = found.unionByName(more)
    return found


@query(
    "k20_wiki_lint",
    r"""WITH p AS (SELECT doc_id::VARCHAR AS page, CASE WHEN lang = 'en' THEN 'source' ELSE 'chemical' END AS kind, CASE WHEN n_chars % 3 = 0 THEN text ELSE text || ' [[' || (doc_id + n_chars) || ']] [Wiki证据1]' END AS markdown FROM documents),
        k AS (SELECT DISTINCT page, unnest(regexp_extract_all(markdown, '\[\[([^\]|\n]+)\]\]', 1)) AS target FROM p), b AS (SELECT page, sha256(regexp_replace(markdown, '\s+|\[Wiki证据[0-9]+\]', '', 'g')) AS body FROM p)
        SELECT page, 'broken_link' AS type, target AS detail FROM k WHERE target NOT IN (SELECT page FROM p) UNION ALL SELECT b.page, 'duplicate', f.first FROM b JOIN (SELECT body, min(page) AS first FROM b GROUP BY body) f USING (body) WHERE b.page <> f.first
        UNION ALL SELECT page, 'link_gap', '' FROM p WHERE kind <> 'source' AND NOT regexp_matches(markdown, '\[\[([^\]|\n]+)\]\]')
        UNION ALL SELECT doc_id::VARCHAR, 'stale', '' FROM labels WHERE quality = 0 UNION ALL SELECT doc_id::VARCHAR, 'pending', '1' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id::VARCHAR, 'invalid', 'short' FROM documents WHERE length(text) < 40""",
)
def k20_wiki_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    page = F.col("doc_id").cast("string").alias("page")
    linked = F.concat("text", F.lit(" [["), F.col("doc_id") + F.col("n_chars"), F.lit("]] [Wiki证据1]"))
    pages = docs.select(page, F.when(F.col("lang") == "en", "source").otherwise("chemical").alias("kind"), F.when(F.col("n_chars") % 3 == 0, F.col("text")).otherwise(linked).alias("markdown"))
    states = labels.select(page, F.when(F.col("quality") == 0, "stale").otherwise("fresh").alias("state"))
    return wiki_lint(pages, docs.where("length(text) < 40").select(page, F.lit("short").alias("error")), states, labels.select(page, F.col("toxic").alias("sections")))


def wiki_cases(reviews: DataFrame, test_only: bool = False) -> DataFrame:
    """Cases of section reviews (wiki_id, section, review_status, review_id, entity, content, reviewed_content, knowledge_source, error_type, review_comment).

    Approved ones are successes, modified and rejected ones failures; other rows make no case. The id is a digest of what was decided on what.
    """
    decided = reviews.where(F.col("review_status").isin("approved", "modified", "rejected"))
    text = lambda c: F.nullif(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(""))
    success = F.col("review_status") == "approved"
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("wiki_id", "section", "review_status", "review_id")])
    lead = [text("entity"), text("section"), F.lit("wiki_generation")]
    embedded = F.when(success, F.concat_ws("。", *lead, F.coalesce(text("reviewed_content"), text("content")))).otherwise(
        F.concat_ws("。", *lead, text("error_type"), text("content"), text("reviewed_content"), text("review_comment"))
    )
    return decided.select(
        F.concat(F.lit("W_"), F.substring(F.sha1(key), 1, 16)).alias("case_id"), F.when(success, "success").otherwise("failure").alias("case_type"), "entity", "section",
        (success & F.coalesce(F.col("knowledge_source") == "model_prior", F.lit(False))).alias("human_verified_model_knowledge"),
        F.lit("test" if test_only else "verified").alias("case_status"), embedded.alias("embedding_text"),
    )


_REVIEWS = "SELECT user_id AS entity, event_id AS review_id, event_type AS section, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'click' THEN 'modified' WHEN 'error' THEN 'rejected' ELSE 'open' END AS s, nullif(json_extract_string(props, '$.k'), '7') AS k FROM events"


@query(
    "k43_wiki_cases",
    f"""WITH r AS ({_REVIEWS}) SELECT 'W_' || substr(sha1(entity || '|' || section || '|' || s || '|' || review_id), 1, 16) AS case_id, CASE WHEN s = 'approved' THEN 'success' ELSE 'failure' END AS case_type, entity, section,
        s = 'approved' AND coalesce(k = '3', false) AS human_verified_model_knowledge, 'verified' AS case_status,
        CASE WHEN s = 'approved' THEN concat_ws('。', entity, section, 'wiki_generation', coalesce(k, 'old ' || review_id)) ELSE concat_ws('。', entity, section, 'wiki_generation', 'content_review', 'old ' || review_id, k) END AS embedding_text FROM r WHERE s <> 'open'""",
)
def k43_wiki_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k = F.col("event_type"), F.nullif(F.get_json_object("props", "$.k"), F.lit("7"))
    status = F.when(kind == "purchase", "approved").when(kind == "click", "modified").when(kind == "error", "rejected").otherwise("open")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("wiki_id"), F.col("user_id").alias("entity"), kind.alias("section"), status.alias("review_status"), F.col("event_id").alias("review_id"), F.concat(F.lit("old "), "event_id").alias("content"),
        k.alias("reviewed_content"), F.when(k == "3", "model_prior").otherwise("evidence").alias("knowledge_source"), F.lit("content_review").alias("error_type"), F.lit("").alias("review_comment"),
    )
    return wiki_cases(rows)


def rule_assertions(reports: DataFrame) -> DataFrame:
    """Assertions (doc, predicate, object, object_kind) that the rules find in reports (doc, text): counts as literals, standards, substances, clauses and days as entities."""
    found = annotations(F.col("text"))
    said = lambda predicate, x, kind: F.struct(F.lit(predicate).alias("predicate"), x.cast("string").alias("object"), F.lit(kind).alias("object_kind"))
    literals = [F.when(found[name].isNotNull(), said(f"has_{name}", found[name], "literal")) for name in ("death_count", "severe_injury_count", "minor_injury_count", "injury_count", "missing_count")]
    entities = {"references": "standard_codes", "involves_chemical": "cas_numbers", "violates": "clauses", "occurred_on": "dates"}
    none = F.array().cast("array<struct<predicate:string,object:string,object_kind:string>>")
    each = lambda predicate, name: F.coalesce(F.transform(found[name], lambda x: said(predicate, x, "entity")), none)
    listed = [each(*pair) for pair in entities.items()]
    # A report is read once, whatever is found in it.
    return reports.select("doc", F.explode(F.concat(F.array_compact(F.array(*literals)), *listed)).alias("a")).select("doc", "a.*")


@query(
    "k21_report_assertions",
    """SELECT o_orderkey AS doc, 'has_death_count' AS predicate, (o_orderkey % 11)::VARCHAR AS object, 'literal' AS object_kind FROM orders UNION ALL SELECT o_orderkey, 'has_injury_count', o_custkey::VARCHAR, 'literal' FROM orders
       UNION ALL SELECT o_orderkey, 'references', 'GB ' || o_orderkey || '-2018', 'entity' FROM orders UNION ALL SELECT o_orderkey, 'violates', '第' || o_custkey || '条', 'entity' FROM orders UNION ALL SELECT o_orderkey, 'occurred_on', strftime(o_orderdate, '%Y-%m-%d'), 'entity' FROM orders""",
)
def k21_report_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_assertions(_reports(spark, sf_dir).withColumnRenamed("o_orderkey", "doc"))


def public_rows(rows: DataFrame) -> DataFrame:
    """The columns that are for clients: those whose names do not begin with an underscore."""
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if not c.startswith("_")])


@query("f20_public_rows", "SELECT doc_id, lang FROM documents")
def f20_public_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return public_rows(table(spark, sf_dir, "documents").select("doc_id", "lang", F.lower("text").alias("_search"), F.col("source").alias("_source")))


def copy_selected(tables: dict[str, DataFrame], target: str) -> DataFrame:
    """Writes tables below ``target`` and returns its manifest (name, rows, checksum): the sum of the rows' digests, the same in whatever order they lie."""
    manifest = None
    for name, frame in tables.items():
        frame.write.parquet(f"{target}/{name}")
        digest = F.xxhash64(*[F.col(f"`{c}`") for c in frame.columns]).cast("decimal(38,0)")
        row = frame.sparkSession.read.parquet(f"{target}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("checksum"))
        manifest = row if manifest is None else manifest.unionByName(row)
    return manifest


def intent_match(text: Column, strong: list[str], weak: list[str], required: list[str] = (), least: int = 2) -> Column:
    """Whether a text means an intent: two for a strong word and one for a weak one make ``least``, and one of the required words occurs, if any are."""
    has = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))) if words else F.lit(0)
    enough = 2 * has(strong) + has(weak) >= least
    return enough & (has(required) > 0) if required else enough


@query("e09_intent_match", "SELECT doc_id, 2 * (contains(text, 'with')::INT + contains(text, 'from')::INT) + contains(text, 'this')::INT + contains(text, 'that')::INT >= 2 AND (contains(text, 'for') OR contains(text, 'der')) AS matched FROM documents")
def e09_intent_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", intent_match(F.col("text"), ["with", "from"], ["this", "that"], ["for", "der"]).alias("matched"))


def network_summary(relations: DataFrame, nodes: int = 200, links: int = 300) -> tuple[DataFrame, DataFrame, int]:
    """The first nodes and links of a relation network by their names, and the number of all distinct links; ``relations`` (src, predicate, dst)."""
    distinct = relations.select("src", "predicate", "dst").distinct()
    ends = distinct.select(F.col("src").alias("node")).union(distinct.select("dst")).distinct()
    return ends.orderBy("node").limit(nodes), distinct.orderBy("src", "predicate", "dst").limit(links), distinct.count()


@query(
    "a12_network_links",
    f"WITH {_ASSERTIONS} SELECT DISTINCT subject AS src, predicate, object AS dst FROM a WHERE status <> 'rejected' AND subject IS NOT NULL ORDER BY src, predicate, dst LIMIT 300",
)
def a12_network_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = assertions_of(spark, sf_dir).where("status <> 'rejected' AND subject IS NOT NULL")
    return network_summary(live.select(F.col("subject").alias("src"), "predicate", F.col("object").alias("dst")))[1]


@query("a12_network_nodes", f"WITH {_ASSERTIONS}, l AS (SELECT * FROM a WHERE status <> 'rejected' AND subject IS NOT NULL) SELECT subject AS node FROM l UNION SELECT object FROM l ORDER BY node LIMIT 200")
def a12_network_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = assertions_of(spark, sf_dir).where("status <> 'rejected' AND subject IS NOT NULL")
    return network_summary(live.select(F.col("subject").alias("src"), "predicate", F.col("object").alias("dst")))[0]


def outliers(rows: DataFrame, group: str, value: str, groups: int = 12, most: int = 80) -> DataFrame:
    """(group, value, place): of the first groups in order of their names, the values beyond 1.5 interquartile ranges, the smallest 80 of each."""
    quartiles = rows.groupBy(group).agg(F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"))
    first = quartiles.orderBy(F.col(group).asc_nulls_last()).limit(groups)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    far = rows.join(first, group).where((F.col(value) < F.col("q1") - reach) | (F.col(value) > F.col("q3") + reach))
    place = F.row_number().over(Window.partitionBy(group).orderBy(value))
    return far.select(group, value, place.alias("place")).where(F.col("place") <= most)


@query(
    "a08_outliers",
    """WITH q AS (SELECT source, quantile_cont(n_chars, .25) AS q1, quantile_cont(n_chars, .75) AS q3 FROM documents GROUP BY 1 ORDER BY source NULLS LAST LIMIT 12)
       SELECT source, n_chars, (row_number() OVER (PARTITION BY source ORDER BY n_chars))::INT AS place FROM documents JOIN q USING (source) WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1) QUALIFY place <= 80""",
)
def a08_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers(table(spark, sf_dir, "documents"), "source", "n_chars")


def sankey(rows: DataFrame, source: str, target: str, metric: str) -> DataFrame:
    """(source, target, value): for every pair of values that occurs the distinct facts behind it."""
    return rows.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(F.countDistinct(metric).alias("value"))


@query("a11_sankey", "SELECT o_orderpriority AS source, l_returnflag AS target, count(DISTINCT o_custkey) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def a11_sankey(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return sankey(rows, "o_orderpriority", "l_returnflag", "o_custkey")
