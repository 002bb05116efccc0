"""Text retrieval: postings, BM25, dense scores, reciprocal rank fusion, evidence scores and validation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.functions.text import terms
from quillspar.operators.graph import checkpointed
from quillspar.operators.windows import cap_per_key
from quillspar.registry import query
from quillspar.sources.tables import table

K1, B, RRF_K, MAX_TERMS, BLOCKS = 1.2, 0.75, 60, 24, 64
#: Rows of a tile's sides, queries of one product, and what a product may differ from a score that is equal when rounded to six digits.
TILE, QUERIES_AT_ONCE, SLACK = 16_384, 256, 2e-6
#: Weights of the routes in the fusion.
ROUTE_WEIGHTS = {"vector": 1.0, "keyword": 1.0, "graph": 0.8}


def postings(documents: DataFrame) -> DataFrame:
    """(term, doc_id, dl): every distinct term of every document, with the document's number of them."""
    found = documents.select("doc_id", terms(F.col("text")).alias("terms"))
    return found.select("doc_id", F.size("terms").cast("long").alias("dl"), F.explode("terms").alias("term"))


def bm25(index: DataFrame, question: list[str], n_docs: int, average: float) -> DataFrame:
    """Scores of the documents that hold any of the first 24 distinct terms.

    Term frequencies are one, as an index row holds a term once. Query terms
    are few by construction, so they are a filter on the postings.
    """
    wanted = list(dict.fromkeys(question))[:MAX_TERMS]
    hits = index.where(F.col("term").isin(wanted))
    df = hits.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.log((F.lit(n_docs) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weight = F.when(idf > 0, idf).otherwise(F.lit(1e-6)) * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / F.lit(average)))
    return hits.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.sum(weight).alias("score"))


def search(documents: DataFrame, question: list[str]) -> DataFrame:
    """BM25 over texts that have no index yet: each is cut into terms once, and only the question's are kept."""
    wanted = list(dict.fromkeys(question))[:MAX_TERMS]
    found = documents.select("doc_id", terms(F.col("text")).alias("t"))
    rows = checkpointed(found.select("doc_id", F.size("t").cast("long").alias("dl"), F.array_intersect("t", F.array(*map(F.lit, wanted))).alias("hits")))
    n_docs, average = rows.agg(F.count("*"), F.avg("dl")).first()
    return bm25(rows.select("doc_id", "dl", F.explode("hits").alias("term")), wanted, n_docs, average)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def normalised(a: Column) -> Column:
    size = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(F.lit(0.0)))


def _tile_top(k: int):
    """What may be among the k nearest of each query in a tile of vectors and queries, with exact scores."""

    def matrix(table: pa.Table, name: str) -> np.ndarray:
        return np.asarray(table[name].combine_chunks().flatten(), "float64").reshape(table.num_rows, -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": right["query_id"].slice(0, 0), "vec_id": left["vec_id"].slice(0, 0), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        order = pc.sort_indices(left["vec_id"])
        left, found = left.take(order), [empty]
        vectors, asked = matrix(left, "embedding"), matrix(right, "asked")
        ids, queries = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        for start in range(0, len(queries), QUERIES_AT_ONCE):
            some = slice(start, start + QUERIES_AT_ONCE)
            near = asked[some] @ vectors.T
            near[queries[some, None] == ids] = -np.inf
            least = np.partition(near, max(len(ids) - k, 0), axis=1)[:, max(len(ids) - k, 0)]
            row, column = np.nonzero((near >= least[:, None] - SLACK) & (near > -np.inf))
            score = np.zeros(len(row))
            for at in range(vectors.shape[1]):  # in the order of the components, as ``dot`` adds them up
                score += asked[start + row, at] * vectors[column, at]
            # Of copies, which score the same, k with the smallest ids are enough.
            rank = np.lexsort((column, -score, row))
            fresh = np.r_[True, (row[rank][1:] != row[rank][:-1]) | (score[rank][1:] != score[rank][:-1])]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(rank)), 0)) if len(rank) else rank
            rank = rank[np.arange(len(rank)) - first < k]
            found.append(pa.table([right["query_id"].take(start + row[rank]), left["vec_id"].take(column[rank]), pa.array(score[rank])], names=empty.column_names))
        return pa.concat_tables(found)

    return run


def dense_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k vectors of largest inner product for a stated set of queries, exactly.

    Vectors and queries are dealt into tiles of TILE rows a side, of which each is one product of matrices; what can be
    among a query's k nearest is scored again in the order of the components. Null vectors, and those with other widths or
    components that are null or not finite, are scored one by one.
    """
    width = vectors.agg(F.mode(F.size("embedding"), True)).first()[0]
    kind = dict(vectors.dtypes)
    e = F.col("embedding")
    whole = F.coalesce((F.size(e) == F.lit(width)) & (F.size(e) > 0) & F.forall(e, lambda x: F.coalesce(F.abs(x) < 1e100, F.lit(False))), F.lit(False))
    marked, asking = vectors.where("vec_id IS NOT NULL").select("vec_id", "embedding", whole.alias("whole")), queries.where("vec_id IS NOT NULL").select("vec_id", "embedding", whole.alias("whole"))
    n, odd = marked.agg(F.count("*"), F.count_if(~F.col("whole"))).first()
    m, odd_queries = asking.agg(F.count("*"), F.count_if(~F.col("whole"))).first()
    down, across = max(1, -(-n // TILE)), max(1, -(-m // TILE))
    dealt = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    placed = marked.where("whole").select("vec_id", "embedding", dealt("vec_id", down).alias("block"), each(across).alias("part"))
    asked = asking.where("whole").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"), dealt("vec_id", across).alias("part"), each(down).alias("block"))
    schema = f"query_id {kind['vec_id']}, vec_id {kind['vec_id']}, score double"
    pairs = placed.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(_tile_top(k), schema)
    if odd or odd_queries:
        left, right = marked.withColumn("block", dealt("vec_id", BLOCKS)), asking.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"), F.col("whole").alias("also"), each(BLOCKS).alias("block"))
        single = left.join(right.hint("merge"), "block").where("vec_id <> query_id AND NOT (whole AND also)")
        pairs = pairs.unionByName(single.select("query_id", "vec_id", dot(e, F.col("asked")).alias("score")))
    return cap_per_key(pairs.withColumn("score", F.round("score", 6)), ["query_id"], [F.desc("score"), F.col("vec_id")], k)


def fuse(hits: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of (route, key, rank); the best rank counts once a route."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROUTE_WEIGHTS.items() for x in kv]), F.col("route")), F.lit(1.0))
    best = hits.groupBy("key", "route").agg(F.min("rank").alias("rank"))
    parts = F.array_sort(F.collect_list(F.struct("route", (weight / (RRF_K + F.col("rank"))).alias("part"))))
    return best.groupBy("key").agg(parts.alias("p")).select(
        "key", F.aggregate("p", F.lit(0.0), lambda s, x: s + x["part"]).alias("rrf_score"), F.array_join(F.transform("p", lambda x: x["route"]), ",").alias("routes")
    )


def quality_score(rerank: Column, authority: Column, length: Column, on_intent: Column) -> Column:
    """Evidence quality out of 100: rerank 40, authority 20, length up to 20, intent 20 or 10."""
    by_length = F.when(length > 1000, 20).when(length > 500, 15).when(length > 200, 10).otherwise(0)
    return F.round(F.least(rerank / 3, F.lit(1.0)) * 40 + authority * 20 + by_length + F.when(on_intent, 20).otherwise(10), 4)


def validate(hits: DataFrame, least: float = 0.2) -> DataFrame:
    """Accepted, or the first reason to reject: empty, short, low score, entity or intent missing."""
    text = F.trim(F.coalesce("text", F.lit("")))
    reason = F.when(text == "", "empty").when(F.length(text) < 30, "short").when(F.col("score") < least, "low_score").when(~F.col("has_entity"), "entity").when(~F.col("has_intent"), "intent").otherwise("accepted")
    return hits.withColumn("reason", reason)


_TERMS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@query("x01_term_frequency", f"SELECT term, count(*) AS documents FROM (SELECT unnest({_TERMS}) AS term FROM documents) GROUP BY 1")
def x01_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(table(spark, sf_dir, "documents")).groupBy("term").agg(F.count("*").alias("documents"))


_QUESTION = ("license", "with", "this", "password", "token", "the")


@query(
    "k02_bm25",
    f"""WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
        p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d), h AS (SELECT * FROM p WHERE term IN {_QUESTION}), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
        SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / a))) AS score
        FROM h JOIN f USING (term), s GROUP BY doc_id) ORDER BY round(score, 6) DESC, doc_id LIMIT 20""",
)
def k02_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = search(table(spark, sf_dir, "documents"), list(_QUESTION))
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(
    "t02_dense_top",
    """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
       SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p) WHERE r <= 10""",
)
def t02_dense_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return dense_top(vectors, vectors.where("vec_id % 100 = 0"), 10)


@query(
    "e05_cosine",
    """SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS square, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS mirrored FROM embeddings""",
)
def e05_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(dot(e, e), 6).alias("square"), F.round(cosine(e, F.reverse(e)), 6).alias("mirrored"))


@query(
    "k05_fusion",
    """WITH r AS (SELECT event_type, user_id AS key, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events WHERE event_type IN ('view', 'click', 'purchase')),
       h AS (SELECT key, CASE event_type WHEN 'view' THEN 'vector' WHEN 'click' THEN 'keyword' ELSE 'graph' END AS route, min(rank) AS rank FROM r GROUP BY ALL)
       SELECT key, round(sum(CASE WHEN route = 'graph' THEN 0.8 ELSE 1.0 END / (60 + rank)), 9) AS rrf_score, string_agg(route, ',' ORDER BY route) AS routes FROM h GROUP BY key ORDER BY rrf_score DESC, key LIMIT 50""",
)
def k05_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.when(F.col("event_type") == "view", "vector").when(F.col("event_type") == "click", "keyword").otherwise("graph")
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    hits = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "purchase")).select(route.alias("route"), F.col("user_id").alias("key"), rank.alias("rank"))
    return fuse(hits).withColumn("rrf_score", F.round("rrf_score", 9)).orderBy(F.desc("rrf_score"), "key").limit(50)


@query(
    "k07_validation",
    """SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) < 30 THEN 'short' WHEN (n_chars % 10) / 10.0 < 0.2 THEN 'low_score' WHEN NOT contains(lower(text), 'the') THEN 'entity'
       WHEN NOT contains(lower(text), 'with') THEN 'intent' ELSE 'accepted' END AS reason, count(*) AS n FROM documents GROUP BY 1""",
)
def k07_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    hits = table(spark, sf_dir, "documents").select("text", ((F.col("n_chars") % 10) / 10.0).alias("score"), F.contains(low, F.lit("the")).alias("has_entity"), F.contains(low, F.lit("with")).alias("has_intent"))
    return validate(hits).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "e08_quality_score",
    """SELECT doc_id, round(least((doc_id % 5) / 3.0, 1.0) * 40 + (doc_id % 3) / 2.0 * 20 + CASE WHEN n_chars > 1000 THEN 20 WHEN n_chars > 500 THEN 15 WHEN n_chars > 200 THEN 10 ELSE 0 END + CASE WHEN lang = 'en' THEN 20 ELSE 10 END, 4) AS score FROM documents""",
)
def e08_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = quality_score((F.col("doc_id") % 5).cast("double"), (F.col("doc_id") % 3) / 2.0, F.col("n_chars"), F.col("lang") == "en")
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"))


@query(
    "t09_top_per_kind",
    "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= CASE WHEN event_type = 'view' THEN 8 ELSE 12 END",
)
def t09_top_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    order = [F.desc("value"), F.col("event_id")]
    return cap_per_key(rows.where("event_type = 'view'"), ["event_type"], order, 8).unionByName(cap_per_key(rows.where("event_type <> 'view'"), ["event_type"], order, 12))


@query(
    "t06_nulls_last",
    "SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events) ORDER BY value DESC NULLS LAST, event_id DESC LIMIT 40",
)
def t06_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    return table(spark, sf_dir, "events").select("event_id", value).orderBy(F.desc_nulls_last("value"), F.desc("event_id")).limit(40)


@query(
    "t12_weighted_search",
    """SELECT doc_id, score FROM (SELECT doc_id, (CASE WHEN contains(lower(source), 'src1') THEN 4 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'token') THEN 1 ELSE 0 END)::INT AS score FROM documents)
       WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 30""",
)
def t12_weighted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda c, word, weight: F.when(F.contains(F.lower(c), F.lit(word)), weight).otherwise(0)
    score = has("source", "src1", 4) + has("text", "license", 1) + has("text", "token", 1)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(30)
