"""Composite reads over facts, graphs and registries: details, catalogues, histories, projections and review transitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.operators.knowledge import _ASSERTIONS, DOMAINS, assertions_of
from quillspar.operators.retrieval import cosine, fuse
from quillspar.operators.windows import cap_per_key
from quillspar.registry import query
from quillspar.sources.tables import table

#: Predicates of the preset analyses of a graph.
PRESETS = {
    "causal_chain": ("direct_cause", "indirect_cause", "leads_to"),
    "accident_to_standard": ("violates", "derived_from", "has_clause", "based_on", "applies_to", "governs"),
    "chemical_to_accidents": ("involves_chemical", "involves_equipment", "involves_process", "occurred_in", "occurred_at"),
    "chemical_to_requirements": ("applies_to", "governs", "handles"),
    "equipment_to_causes": ("involves_equipment", "direct_cause", "indirect_cause", "leads_to", "relates_to"),
    "measure_to_basis": ("based_on", "violates", "applies_to"),
}


class StaleSnapshot(Exception):
    """The client's snapshot is not the current one."""


class Conflict(Exception):
    """The caller's version is not the current one."""


# Facts of relations and wiki entries


def relation_facts(reviewed: DataFrame) -> DataFrame:
    """Facts of accepted relations, one an id: of rows with the same id the last holds.

    ``reviewed`` (seq, id, status, subject, predicate, object, subject_type, object_type, object_kind, doc, date).
    """
    live = reviewed.where(F.col("status").isin("approved", "modified") & (F.coalesce("id", F.lit("")) != ""))
    last = live.groupBy("id").agg(F.max_by(F.struct(*[c for c in live.columns if c != "id"]), "seq").alias("r")).select("id", "r.*")
    ends = F.array(*[F.when((F.col(f"{side}_type") == "chemical") & (F.col(side) != ""), F.col(side)) for side in ("subject", "object")])
    kind = F.when(F.col("object_kind") == "literal", "literal").otherwise("relation")
    title = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("subject", "predicate", "object")])
    return last.select("id", title.alias("title"), kind.alias("kind"), F.array_sort(F.array_distinct(F.array_compact(ends))).alias("chemicals"), "doc", "date")


def wiki_facts(entries: DataFrame) -> DataFrame:
    """Facts of wiki entries (id, entity, summary as JSON, published_revision, draft_revision, updated_at)."""
    return entries.select(
        F.col("id").cast("string").alias("id"), F.col("entity").alias("title"), F.coalesce(F.get_json_object("summary", "$.page_type"), F.lit("unknown")).alias("page_type"),
        F.when(F.coalesce("published_revision", F.lit("")) != "", "published").otherwise("draft").alias("status"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("date"), F.coalesce(F.nullif("published_revision", F.lit("")), "draft_revision").alias("revision"),
    )


_RELATIONS = f"""{_ASSERTIONS}, rel AS (SELECT seq, subject || '|' || object AS id, status, subject, predicate, object, st, ot, CASE WHEN ot = 'clause' THEN 'literal' ELSE 'entity' END AS object_kind, doc, strftime(f, '%Y-%m-%d') AS date FROM a)"""


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assertions_of(spark, sf_dir)
    kind = F.when(F.col("object_type") == "clause", "literal").otherwise("entity")
    return rows.select("seq", F.concat("subject", F.lit("|"), "object").alias("id"), "status", "subject", "predicate", "object", "subject_type", "object_type", kind.alias("object_kind"), "doc", F.date_format("valid_from", "yyyy-MM-dd").alias("date"))


@query(
    "f02_relation_facts",
    f"""WITH {_RELATIONS}, l AS (SELECT * FROM rel WHERE status <> 'rejected' AND coalesce(id, '') <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
        SELECT id, subject || ' ' || predicate || ' ' || object AS title, CASE WHEN object_kind = 'literal' THEN 'literal' ELSE 'relation' END AS kind,
        array_to_string(list_sort(list_distinct(list_filter([CASE WHEN st = 'chemical' THEN subject END, CASE WHEN ot = 'chemical' THEN object END], lambda x: x IS NOT NULL))), ',') AS chemicals, doc, date FROM l""",
)
def f02_relation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation_facts(_relations(spark, sf_dir)).withColumn("chemicals", F.array_join("chemicals", ","))


@query(
    "f04_wiki_facts",
    """SELECT event_id::VARCHAR AS id, 'user ' || user_id AS title, coalesce(json_extract_string(props, '$.page_type'), 'unknown') AS page_type, CASE WHEN event_type <> 'error' THEN 'published' ELSE 'draft' END AS status,
       strftime(ts, '%Y-%m-%d') AS date, coalesce(nullif(event_type, 'error'), 'draft-' || event_id) AS revision FROM (SELECT * REPLACE (replace(props, '"k"', '"page_type"') AS props) FROM events)""",
)
def f04_wiki_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("user "), "user_id").alias("entity"), F.replace("props", F.lit('"k"'), F.lit('"page_type"')).alias("summary"),
        F.nullif("event_type", F.lit("error")).alias("published_revision"), F.concat(F.lit("draft-"), "event_id").alias("draft_revision"), F.col("ts").alias("updated_at"),
    )
    return wiki_facts(entries)


# Details of one fact


def fact_detail(facts: DataFrame, fragments: DataFrame, relations: DataFrame, identity: object, offset: int = 0, size: int = 20, pinned: str | None = None, current: str | None = None) -> DataFrame:
    """Rows (kind, position, id, total) of one fact: a page of its fragments in the order they were met, and its accepted relations.

    No rows if there is no such fact. ``facts`` (id), ``fragments`` (doc, seq, id), ``relations`` (doc, id, status).
    """
    if pinned is not None and pinned != current:
        raise StaleSnapshot(pinned)
    known = facts.where(F.col("id") == identity).select(F.col("id").alias("doc")).limit(1)
    mine = fragments.where(F.col("doc") == identity).join(known, "doc", "left_semi")
    page = mine.orderBy("seq", "id").offset(offset).limit(size).withColumn("position", F.row_number().over(Window.orderBy("seq", "id")) - 1 + offset)
    page = page.crossJoin(mine.agg(F.count("*").alias("total"))).select(F.lit("fragment").alias("kind"), "position", F.col("id").cast("string").alias("id"), "total")
    accepted = relations.where((F.col("doc") == identity) & F.col("status").isin("approved", "modified")).join(known, "doc", "left_semi").select(F.col("id").cast("string").alias("id")).distinct()
    return page.unionByName(accepted.select(F.lit("relation").alias("kind"), F.lit(None).cast("int").alias("position"), "id", F.lit(None).cast("long").alias("total")))


@query(
    "k37_drill_through",
    """WITH m AS (SELECT conv_id AS doc, turn AS seq, conv_id || ':' || turn AS id FROM conversations UNION ALL SELECT o_custkey, o_orderkey, 'order ' || o_orderkey FROM orders WHERE o_orderstatus <> 'P'), f AS (SELECT * FROM m WHERE doc = 7)
       SELECT 'fragment' AS kind, (row_number() OVER (ORDER BY seq, id) - 1)::INT AS position, id, (SELECT count(*) FROM f) AS total FROM f QUALIFY position >= 2 AND position < 22
       UNION ALL SELECT 'relation', NULL, o_orderkey::VARCHAR, NULL FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'""",
)
def k37_drill_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, orders = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "orders")
    fragments = turns.select(F.col("conv_id").alias("doc"), F.col("turn").cast("long").alias("seq"), F.concat_ws(":", "conv_id", "turn").alias("id"))
    fragments = fragments.union(orders.where("o_orderstatus <> 'P'").select("o_custkey", F.col("o_orderkey").cast("long"), F.concat(F.lit("order "), "o_orderkey")))
    relations = orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"))
    return fact_detail(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), fragments, relations, 7, offset=2)


def article_versions(articles: DataFrame, versions: DataFrame, most: int = 20) -> DataFrame:
    """(article, version, rank): the latest ``most`` versions of every article that is not removed; articles without any have one row of nulls."""
    live = articles.where("removed = 0").select("article")
    rank = F.row_number().over(Window.partitionBy("article").orderBy(F.desc("version")))
    latest = versions.select("article", "version", rank.alias("rank")).where(F.col("rank") <= most)
    return live.join(latest, "article", "left")


@query(
    "k38_article_versions",
    """WITH v AS (SELECT user_id AS article, event_id AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM events QUALIFY rank <= 20)
       SELECT c_custkey AS article, version, rank::INT AS rank FROM customer LEFT JOIN v ON article = c_custkey WHERE c_acctbal >= 0""",
)
def k38_article_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("article"), (F.col("c_acctbal") < 0).cast("int").alias("removed"))
    return article_versions(articles, table(spark, sf_dir, "events").select(F.col("user_id").alias("article"), F.col("event_id").alias("version")))


def relation_source(assertions: DataFrame, chunks: DataFrame, reviews: DataFrame, identity: object) -> DataFrame:
    """Rows (kind, id, position) of one assertion: its chunk, all assertions of that chunk, and all its reviews in order.

    ``assertions`` (id, chunk), ``chunks`` (chunk, text), ``reviews`` (id, seq).
    """
    chunk = assertions.where(F.col("id") == identity).select("chunk").limit(1)
    none = F.lit(None).cast("long").alias("position")
    found = chunks.join(chunk, "chunk", "left_semi").select(F.lit("chunk").alias("kind"), F.col("chunk").cast("string").alias("id"), none)
    siblings = assertions.join(chunk, "chunk", "left_semi").select(F.lit("sibling").alias("kind"), F.col("id").cast("string").alias("id"), none)
    history = reviews.where(F.col("id") == identity).select(F.lit("review").alias("kind"), F.col("seq").cast("string").alias("id"), F.row_number().over(Window.orderBy("seq")).cast("long").alias("position"))
    return found.unionByName(siblings).unionByName(history)


@query(
    "k39_relation_source",
    """WITH c AS (SELECT o_custkey AS chunk FROM orders WHERE o_orderkey = 7) SELECT 'chunk' AS kind, c_custkey::VARCHAR AS id, NULL::BIGINT AS position FROM customer WHERE c_custkey IN (SELECT chunk FROM c)
       UNION ALL SELECT 'sibling', o_orderkey::VARCHAR, NULL FROM orders WHERE o_custkey IN (SELECT chunk FROM c)
       UNION ALL SELECT 'review', event_id::VARCHAR, row_number() OVER (ORDER BY event_id) FROM events WHERE user_id = 7""",
)
def k39_relation_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    assertions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("chunk"))
    chunks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk"), F.col("c_name").alias("text"))
    return relation_source(assertions, chunks, table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq")), 7)


# Catalogues


def file_catalogue(facts: DataFrame, chunks: DataFrame, classes: list[str]) -> DataFrame:
    """(class, available, rows, bytes, sample): one row a class, also for classes without documents; the sample is the first chunk of the class.

    ``facts`` (doc, class), ``chunks`` (doc, seq, text).
    """
    rows = facts.join(chunks, "doc", "left")
    found = rows.groupBy("class").agg(
        F.countDistinct("doc").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"), F.min_by(F.substring("text", 1, 40), F.struct("doc", "seq")).alias("sample")
    )
    wanted = facts.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    return wanted.join(found, "class", "left").select("class", F.col("rows").isNotNull().alias("available"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "sample")


@query(
    "k40_file_catalogue",
    """WITH f AS (SELECT lang AS class, count(DISTINCT doc_id) AS rows, sum(strlen(text))::BIGINT AS bytes, arg_min(substr(text, 1, 40), doc_id) AS sample FROM documents GROUP BY 1)
       SELECT c.class, rows IS NOT NULL AS available, coalesce(rows, 0) AS rows, coalesce(bytes, 0) AS bytes, sample FROM (VALUES ('en'), ('de'), ('fr'), ('es'), ('la')) AS c(class) LEFT JOIN f ON f.class = c.class""",
)
def k40_file_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return file_catalogue(docs.select(F.col("doc_id").alias("doc"), F.col("lang").alias("class")), docs.select(F.col("doc_id").alias("doc"), F.lit(0).alias("seq"), "text"), ["en", "de", "fr", "es", "la"])


def schema_items(spark: SparkSession, domains: dict[str, tuple] = DOMAINS) -> DataFrame:
    """(kind, name, text): one retrieval item an entity or relation type of the schema, with the text to embed."""
    relations = [("relation", name, f"{name}: {' or '.join(a)} to {' or '.join(b)}") for name, (a, b) in domains.items()]
    types = sorted({t for pair in domains.values() for side in pair for t in side})
    entities = [("entity", t, f"{t}: subject of {', '.join(sorted(p for p, (a, _) in domains.items() if t in a)) or 'none'}") for t in types]
    return spark.createDataFrame(relations + entities, "kind string, name string, text string")


_ITEMS = f"""WITH d AS (SELECT * FROM (VALUES {', '.join(f"('{p}', {list(x)}, {list(y)})" for p, (x, y) in DOMAINS.items())}) AS v(p, x, y)),
  t AS (SELECT DISTINCT unnest(list_concat(x, y)) AS t FROM d)
  SELECT 'relation' AS kind, p AS name, p || ': ' || array_to_string(x, ' or ') || ' to ' || array_to_string(y, ' or ') AS text FROM d
  UNION ALL SELECT 'entity', t, t || ': subject of ' || coalesce((SELECT string_agg(p, ', ' ORDER BY p) FROM d WHERE list_contains(x, t)), 'none') FROM t"""


@query("k41_schema_items", _ITEMS)
def k41_schema_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_items(spark)


def catalogue_findings(pages: DataFrame, links: DataFrame, sources: DataFrame, coverage: DataFrame) -> DataFrame:
    """(finding, subject): links to no page, pages without a source, and names that neither a page nor a link covers.

    ``pages`` (page), ``links`` (page, target), ``sources`` (page), ``coverage`` (name).
    """
    names = pages.select(F.col("page").alias("target")).distinct()
    missing = links.join(names, "target", "left_anti").select(F.lit("missing_link").alias("finding"), F.col("target").alias("subject")).distinct()
    bare = pages.join(sources, "page", "left_anti").select(F.lit("missing_source").alias("finding"), F.col("page").alias("subject")).distinct()
    covered = names.union(links.select("target")).select(F.col("target").alias("name")).distinct()
    open_ = coverage.join(covered, "name", "left_anti").select(F.lit("uncovered").alias("finding"), F.col("name").alias("subject")).distinct()
    return missing.union(bare).union(open_)


@query(
    "k36_catalogue_findings",
    """WITH p AS (SELECT s_suppkey::VARCHAR AS page FROM supplier), l AS (SELECT DISTINCT user_id::VARCHAR AS target FROM events), s AS (SELECT DISTINCT l_suppkey::VARCHAR AS page FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49),
       c AS (SELECT c_custkey::VARCHAR AS name FROM customer)
       SELECT 'missing_link' AS finding, target AS subject FROM l WHERE target NOT IN (SELECT page FROM p) UNION ALL SELECT 'missing_source', page FROM p WHERE page NOT IN (SELECT page FROM s)
       UNION ALL SELECT 'uncovered', name FROM c WHERE name NOT IN (SELECT page FROM p UNION SELECT target FROM l)""",
)
def k36_catalogue_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("page"))
    links = table(spark, sf_dir, "events").select(F.lit("").alias("page"), F.col("user_id").cast("string").alias("target"))
    sources = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_suppkey").cast("string").alias("page"))
    return catalogue_findings(pages, links, sources, table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name")))


def workspace(entity: str, evidence: DataFrame, relations: DataFrame, news: DataFrame) -> DataFrame:
    """One row on an entity: documents and pages of its evidence, relations that name it, news whose title holds it.

    ``evidence`` (entity, doc, page), ``relations`` (subject, object, quote), ``news`` (title).
    """
    mine = evidence.where((F.col("entity") == entity) & F.col("doc").isNotNull())
    docs = mine.agg(F.count("*").alias("evidence"), F.countDistinct("doc").alias("documents"), F.countDistinct("doc", "page").alias("pages"))
    named = F.contains(F.concat_ws(" ", "subject", "object", "quote"), F.lit(entity))
    return docs.crossJoin(relations.agg(F.count_if(named).alias("relations"))).crossJoin(news.agg(F.count_if(F.contains("title", F.lit(entity))).alias("news")))


@query(
    "k28_workspace",
    f"""WITH {_ASSERTIONS} SELECT (SELECT count(*) FROM conversations WHERE role = 'user') AS evidence, (SELECT count(DISTINCT conv_id) FROM conversations WHERE role = 'user') AS documents,
        (SELECT count(DISTINCT conv_id || ':' || turn) FROM conversations WHERE role = 'user') AS pages, (SELECT count(*) FROM a WHERE contains(concat_ws(' ', subject, object, quote), 'user')) AS relations,
        (SELECT count(*) FROM events WHERE contains('a ' || event_type || ' by user', 'user')) AS news""",
)
def k28_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = table(spark, sf_dir, "conversations").select(F.col("role").alias("entity"), F.col("conv_id").alias("doc"), F.col("turn").alias("page"))
    news = table(spark, sf_dir, "events").select(F.concat(F.lit("a "), "event_type", F.lit(" by user")).alias("title"))
    return workspace("user", evidence, assertions_of(spark, sf_dir), news)


def preset_graph(vertices: DataFrame, edges: DataFrame, preset: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of one preset analysis: edges of its predicates, and the vertices at their ends."""
    kept = edges.where(F.col("predicate").isin(*PRESETS[preset]))
    ends = kept.select(F.col("src").alias("id")).union(kept.select("dst")).distinct()
    return vertices.join(ends, "id", "left_semi"), kept


@query(
    "k46_preset_graphs",
    f"""WITH {_ASSERTIONS}, e AS (SELECT DISTINCT subject AS src, predicate, object AS dst FROM a WHERE status <> 'rejected' AND subject IS NOT NULL),
        p AS (SELECT * FROM (VALUES {', '.join(f"('{name}', '{p}')" for name, found in PRESETS.items() for p in found)}) AS v(preset, predicate)), k AS (SELECT * FROM e JOIN p USING (predicate))
        SELECT n.preset, (SELECT count(*) FROM k WHERE k.preset = n.preset) AS edges, (SELECT count(*) FROM (SELECT src FROM k WHERE k.preset = n.preset UNION SELECT dst FROM k WHERE k.preset = n.preset)) AS vertices FROM (SELECT DISTINCT preset FROM p) n""",
)
def k46_preset_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all preset graphs."""
    edges = assertions_of(spark, sf_dir).where("status <> 'rejected' AND subject IS NOT NULL").select(F.col("subject").alias("src"), "predicate", F.col("object").alias("dst")).distinct()
    vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    out = None
    for preset in PRESETS:
        nodes, links = preset_graph(vertices, edges, preset)
        row = links.agg(F.count("*").alias("edges")).crossJoin(nodes.agg(F.count("*").alias("vertices"))).select(F.lit(preset).alias("preset"), "edges", "vertices")
        out = row if out is None else out.unionByName(row)
    return out


# Keys, instants, canonical forms


def chunk_key(chunk_id: Column, doc_id: Column, page: Column, text: Column) -> Column:
    """The chunk's id, or else its document, page and the first 80 signs of its text."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.coalesce(F.nullif(chunk_id, F.lit("")), F.concat_ws(":", blank(doc_id), blank(page), F.substring(blank(text), 1, 80)))


@query("x04_chunk_key", "SELECT coalesce(nullif(CASE WHEN role = 'user' THEN conv_id || '-' || turn ELSE '' END, ''), conv_id || ':' || turn || ':' || substr(text, 1, 80)) AS key FROM conversations")
def x04_chunk_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("role") == "user", F.concat_ws("-", "conv_id", "turn")).otherwise("")
    return table(spark, sf_dir, "conversations").select(chunk_key(own, F.col("conv_id"), F.col("turn"), F.col("text")).alias("key"))


def instant(value: Column) -> Column:
    """A date or ISO time as an instant, its UTC wall clock: without a zone it is taken as UTC; null if blank or no time."""
    text = F.trim(value)
    day = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zoned = text.rlike(r"\d([Zz]|[+-]\d{2}:?\d{2})$")
    iso = F.when(day, F.concat(text, F.lit("T00:00:00Z"))).when(zoned, text).when(text != "", F.concat(text, F.lit("Z")))
    return F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(iso, "^(.{10}) ", "$1T")), F.current_timezone()).cast("timestamp_ntz")


@query(
    "e02_instant",
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN date_trunc('day', ts) WHEN event_type = 'purchase' THEN date_trunc('second', ts) ELSE date_trunc('second', ts) - INTERVAL 8 HOUR END AS at FROM events""",
)
def e02_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, times without a zone and times of UTC+8, all written as text first."""
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_type").isin("view", "click"), F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_type") == "purchase", time).otherwise(F.concat(time, F.lit("+08:00")))
    return table(spark, sf_dir, "events").select("event_id", instant(text).alias("at"))


def canonical_json(record: Column) -> Column:
    """A map as JSON with its keys in order, so that equal records have equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(record))))


@query(
    "e13_canonical_json",
    """SELECT '{"k":"' || json_extract_string(props, '$.k') || '","type":"' || event_type || '","user":"' || user_id || '"}' AS record, count(*) AS n FROM events GROUP BY 1""",
)
def e13_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose keys come in one order for some rows and in another for the rest."""
    pairs = [F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k")]
    either = F.when(F.col("value") > 100, F.create_map(*pairs)).otherwise(F.create_map(*pairs[4:], *pairs[:4]))
    return table(spark, sf_dir, "events").select(canonical_json(either).alias("record")).groupBy("record").agg(F.count("*").alias("n"))


# Cases, retrieval


def list_cases(cases: DataFrame, case_type: str | None = None, status: str | None = None) -> DataFrame:
    """Cases (case_id, case_type, case_status) of a type and a status; None asks for all."""
    for column, wanted in (("case_type", case_type), ("case_status", status)):
        cases = cases if wanted is None else cases.where(F.col(column) == wanted)
    return cases


def deprecate(cases: DataFrame, ids: DataFrame) -> DataFrame:
    """The cases with those of ``ids`` (case_id) marked deprecated."""
    marked = ids.select("case_id", F.lit(True).alias("_out")).distinct()
    return cases.join(marked, "case_id", "left").withColumn("case_status", F.when(F.col("_out"), "deprecated").otherwise(F.col("case_status"))).drop("_out")


@query("f24_cases", "SELECT doc_id AS case_id, 'failure' AS case_type, 'active' AS case_status FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def f24_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.when(F.col("toxic") == 1, "failure").otherwise("success").alias("case_type"), F.lit("active").alias("case_status"))
    german = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").alias("case_id"))
    return list_cases(deprecate(cases, german), "failure", "active")


def semantic_pages(pages: DataFrame, question: list[float], most: int = 8) -> DataFrame:
    """(page, score): the fresh, published pages nearest to the question by cosine; ``pages`` (page, vector, freshness, revision, published)."""
    live = pages.where((F.col("freshness") == "fresh") & (F.col("revision") == F.col("published")) & (F.size("vector") == len(question)))
    return live.select("page", cosine(F.col("vector"), F.lit(question)).alias("score")).orderBy(F.desc("score"), "page").limit(most)


@query(
    "t11_semantic_pages",
    """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS page, list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(v::DOUBLE[], v::DOUBLE[])) AS score FROM embeddings, q WHERE label <> 3)
       SELECT page, round(score, 6) AS score FROM s ORDER BY s.score DESC, page LIMIT 8""",
)
def t11_semantic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    question = [float(x) for x in vectors.where("vec_id = 0").first()["embedding"]]
    pages = vectors.select(F.col("vec_id").alias("page"), F.col("embedding").alias("vector"), F.when(F.col("label") != 3, "fresh").otherwise("stale").alias("freshness"), F.lit(1).alias("revision"), F.lit(1).alias("published"))
    return semantic_pages(pages, question).withColumn("score", F.round("score", 6))


def hybrid(hits: DataFrame, chunks: DataFrame, at: Column, rerank: Callable[[DataFrame], Column], pool: int = 50, most: int = 15, per_doc: int = 2) -> DataFrame:
    """The chain of a hybrid query: routes fused by reciprocal ranks, chunks active at an instant, reranked, at most two a document, the best.

    ``hits`` (route, key, rank), ``chunks`` (key, doc, valid_from, valid_to); ``rerank`` makes a score of the fused rows.
    """
    live = chunks.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))
    fused = fuse(hits.join(live.select("key"), "key", "left_semi")).orderBy(F.desc("rrf_score"), "key").limit(pool)
    scored = fused.join(live, "key").select("key", "doc", "rrf_score", rerank(fused).alias("score"))
    ranked = scored.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("rrf_score"), "key")))
    return cap_per_key(ranked, ["doc"], [F.col("position")], per_doc).orderBy("position").limit(most).select("key", "doc", "score")


@query(
    "k05_hybrid",
    """WITH r AS (SELECT event_type AS route, user_id AS key, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events WHERE event_type IN ('view', 'click', 'purchase')),
       l AS (SELECT c_custkey AS key, c_nationkey AS doc FROM customer WHERE c_acctbal < 6000), h AS (SELECT key, route, min(rank) AS rank FROM r WHERE key IN (SELECT key FROM l) GROUP BY ALL),
       f AS (SELECT key, sum(1.0 / (60 + rank)) AS rrf FROM h GROUP BY key ORDER BY rrf DESC, key LIMIT 50), s AS (SELECT key, doc, rrf, key % 10 AS score FROM f JOIN l USING (key)),
       p AS (SELECT *, row_number() OVER (ORDER BY score DESC, rrf DESC, key) AS position FROM s), c AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc ORDER BY position) <= 2)
       SELECT key, doc, score FROM c ORDER BY position LIMIT 15""",
)
def k05_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    hits = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "purchase")).select(F.col("event_type").alias("route"), F.col("user_id").alias("key"), rank.alias("rank"))
    chunks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("doc"), F.lit(None).cast("double").alias("valid_from"), (6000 - F.col("c_acctbal")).alias("valid_to"))
    return hybrid(hits, chunks, F.lit(0.0), lambda rows: F.col("key") % 10)


# Review transitions and projections


def review_sections(revisions: DataFrame, events: DataFrame) -> DataFrame:
    """(entity, seq, outcome, revision): what each review of a section did, in order.

    A review states the revision that it saw: if that is no longer the entity's, it is a conflict. A modification without a new text, and a
    modification or rejection without a comment, is invalid. A valid modification makes the next revision; so later reviews must have seen that.
    ``revisions`` (entity, revision), ``events`` (entity, seq, expected, decision, comment, content).
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = ~F.col("decision").isin("approved", "modified", "rejected") | ((F.col("decision") != "approved") & blank("comment")) | ((F.col("decision") == "modified") & blank("content"))
    steps = events.withColumn("bad", bad).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("seq", "expected", "decision", "bad"))).alias("steps")).join(revisions, "entity")
    start = F.struct(F.col("revision").cast("long").alias("now"), F.array().cast("array<struct<seq:bigint,outcome:string,revision:bigint>>").alias("out"))

    def step(state: Column, event: Column) -> Column:
        outcome = F.when(event["bad"], "invalid").when(event["expected"] != state["now"], "conflict").otherwise(event["decision"])
        now = state["now"] + (outcome == "modified").cast("long")
        return F.struct(now.alias("now"), F.array_append(state["out"], F.struct(event["seq"].cast("long").alias("seq"), outcome.alias("outcome"), now.alias("revision"))).alias("out"))

    return steps.select("entity", F.explode(F.aggregate("steps", start, step)["out"]).alias("o")).select("entity", "o.*")


@query(
    "k42_section_reviews",
    """WITH RECURSIVE v AS (SELECT user_id AS entity, event_id AS seq, floor(value / 60)::BIGINT AS expected, CASE event_type WHEN 'purchase' THEN 'modified' WHEN 'error' THEN 'rejected' ELSE 'approved' END AS decision,
       CASE WHEN json_extract_string(props, '$.k')::INT % 5 = 0 THEN '' ELSE 'comment' END AS comment, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
       s AS (SELECT entity, 0::BIGINT AS seq, ''::VARCHAR AS outcome, 0::BIGINT AS revision, 0::BIGINT AS n FROM (SELECT DISTINCT entity FROM v)
       UNION ALL SELECT entity, seq, outcome, before + (outcome = 'modified')::BIGINT, n FROM (SELECT v.entity, v.seq, v.n, s.revision AS before,
         CASE WHEN decision <> 'approved' AND comment = '' THEN 'invalid' WHEN expected <> s.revision THEN 'conflict' ELSE decision END AS outcome FROM s JOIN v ON v.entity = s.entity AND v.n = s.n + 1))
       SELECT entity, seq, outcome, revision FROM s WHERE n > 0""",
)
def k42_section_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    decision = F.when(F.col("event_type") == "purchase", "modified").when(F.col("event_type") == "error", "rejected").otherwise("approved")
    comment = F.when(F.get_json_object("props", "$.k").cast("int") % 5 == 0, "").otherwise("comment")
    events = rows.select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), F.floor(F.col("value") / 60).alias("expected"), decision.alias("decision"), comment.alias("comment"), F.lit("text").alias("content"))
    return review_sections(rows.select(F.col("user_id").alias("entity"), F.lit(0).alias("revision")).distinct(), events)


def checked_append(main: DataFrame, new: DataFrame) -> DataFrame:
    """The vectors of ``new`` (vec_id, embedding) that ``main`` lacks; ValueError unless all are of one dimension and unit length."""
    shape = lambda frame: frame.agg(F.min(F.size("embedding")), F.max(F.size("embedding")), F.max(F.abs(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)) - 1))).first()
    (low, high, off), (low_new, high_new, off_new) = shape(main), shape(new)
    if low is not None and low_new is not None and (low, high) != (low_new, high_new):
        raise ValueError("vectors of another dimension")
    if max(off or 0, off_new or 0) >= 0.01:
        raise ValueError("vectors are not normalised")
    return new.dropDuplicates(["vec_id"]).join(main.select("vec_id"), "vec_id", "left_anti")


@query("i04_checked_append", "SELECT DISTINCT vec_id * 2 AS vec_id FROM embeddings WHERE vec_id * 2 NOT IN (SELECT vec_id FROM embeddings)")
def i04_checked_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return checked_append(main, main.withColumn("vec_id", F.col("vec_id") * 2)).select("vec_id")


def published_projection(entries: DataFrame, sections: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """(entity, section, terms): the search rows of published revisions only; ``entries`` (entity, published), ``sections`` (entity, revision, section, content)."""
    live = entries.where(F.col("published").isNotNull()).select("entity", F.col("published").alias("revision"))
    return sections.join(live, ["entity", "revision"]).select("entity", "section", tokens(F.concat_ws(" ", F.col("entity").cast("string"), "section", "content")).alias("terms"))


@query(
    "i07_published_projection",
    """SELECT d.doc_id AS entity, source AS section, len(regexp_extract_all(lower(d.doc_id || ' ' || source || ' ' || text), '[a-z0-9]+'))::INT AS n_terms FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 WHERE lang = 'en'""",
)
def i07_published_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entity"), F.when(F.col("quality") == 1, "en").alias("published"))
    sections = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity"), F.col("lang").alias("revision"), F.col("source").alias("section"), F.col("text").alias("content"))
    found = published_projection(entries, sections, lambda text: F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    return found.select("entity", "section", F.size("terms").alias("n_terms"))


def stamp_changes(stamps: DataFrame, entries: DataFrame) -> DataFrame:
    """(entity, action): what a reader's index must do to follow the entries: insert, replace or delete; unchanged ones are left out.

    ``stamps`` (entity, stamp) of the index, ``entries`` (entity, draft, published).
    """
    now = entries.select("entity", F.sha2(F.concat_ws("|", F.coalesce("draft", F.lit("")), F.coalesce("published", F.lit(""))), 256).alias("now"))
    action = F.when(F.col("now").isNull(), "delete").when(F.col("stamp").isNull(), "insert").when(F.col("now") != F.col("stamp"), "replace")
    return stamps.join(now, "entity", "full").select("entity", action.alias("action")).where("action IS NOT NULL")


@query(
    "i09_stamp_changes",
    """WITH s AS (SELECT c_custkey AS entity, c_mktsegment || '|' || 'x' AS stamp FROM customer WHERE c_acctbal > 0), n AS (SELECT o_custkey AS entity, CASE WHEN min(o_orderpriority) = '1-URGENT' THEN any_value(c_mktsegment) ELSE 'new' END || '|x' AS now FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
       SELECT coalesce(s.entity, n.entity) AS entity, CASE WHEN now IS NULL THEN 'delete' WHEN stamp IS NULL THEN 'insert' ELSE 'replace' END AS action FROM s FULL JOIN n ON s.entity = n.entity WHERE now IS DISTINCT FROM stamp""",
)
def i09_stamp_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment", "c_acctbal")
    stamps = customers.where("c_acctbal > 0").select("entity", F.sha2(F.concat("c_mktsegment", F.lit("|x")), 256).alias("stamp"))
    urgent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg((F.min("o_orderpriority") == "1-URGENT").alias("urgent")).join(customers, "entity")
    return stamp_changes(stamps, urgent.select("entity", F.when(F.col("urgent"), F.col("c_mktsegment")).otherwise("new").alias("draft"), F.lit("x").alias("published")))
