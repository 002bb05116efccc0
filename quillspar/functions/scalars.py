"""Scalar rules: dates, decision lists, scores and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.registry import query
from quillspar.sources.tables import table

#: Article types in the order of their rules, with the words that decide.
ARTICLE_RULES = (
    ("investigation", "source_id = 'aria_fr'", ""),
    ("policy", "source_id = 'nite_chem'", ""),
    ("investigation", "source_id = 'ntsb_news'", "investigation|report|recommends|recommendation|finds|caused"),
    ("policy", "source_id = 'worksafe_vic'", "fined|charges|charged|prosecut|sentenced"),
    ("historical", "source_id = 'mem_history'", ""),
    ("investigation", "source_id = 'mem_report'", ""),
    ("investigation", "true", "调查报告|investigation report|final report"),
    ("incident", "true", "事故|泄漏|爆炸|火灾|fatal|explosion|leak|fire|killed|incident"),
    ("policy", "true", "条例|法规|办法|征求意见|标准|处罚|fined|prosecut|regulation|enforcement|sentenced"),
    ("education", "true", "科普|安全提示|宣传|awareness|safety tips"),
)


def local_day(value: Column, zone: str = "Asia/Shanghai") -> Column:
    """A strict date, or an ISO time: with a zone the day there, without one its own day; else null."""
    iso = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    zoned = value.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    instant = F.try_to_timestamp(F.regexp_replace(value, " ", "T"))
    shifted = F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(instant, F.current_timezone()), zone), "yyyy-MM-dd")
    plain = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("1")).isNotNull()
    strict = lambda v: F.date_format(F.try_to_date(v, "yyyy-MM-dd"), "yyyy-MM-dd")
    return F.when(plain, strict(value)).when(iso & zoned, shifted).when(iso, strict(F.substring(value, 1, 10)))


def news_date(value: Column) -> Column:
    """The first format that fits: year-month-day in Chinese, three English forms, an ISO prefix."""
    han = F.regexp_extract(value, r"(\d{4})年(\d{1,2})月(\d{1,2})日", 0)
    made = F.try_to_date(F.when(han != "", F.regexp_replace(han, r"(\d{4})年(\d{1,2})月(\d{1,2})日", "$1-$2-$3")), "yyyy-M-d")
    english = [F.try_to_date(value, f) for f in ("MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy")]
    return F.coalesce(made, *english, F.try_to_date(F.regexp_extract(value, r"^\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd"))


def article_type(title: Column, summary: Column, source_id: Column) -> Column:
    """The first rule whose source and words fit an article; news if none does."""
    low = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))))
    out = F
    for kind, source, words in ARTICLE_RULES:
        name = source.split("'")[1] if "'" in source else None
        fits = (F.coalesce(source_id, F.lit("")) == name if name else F.lit(True)) & (low.rlike(words) if words else F.lit(True))
        out = out.when(fits, F.lit(kind))
    return out.otherwise(F.lit("news"))


def intent_score(text: Column, strong: list[str], weak: list[str]) -> Column:
    """Two for every strong word that occurs, one for every weak one."""
    has = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))
    return 2 * has(strong) + has(weak)


def wiki_quality(coverage: Column, citations: Column, length: Column) -> tuple[Column, Column]:
    """Score out of 100 and its level."""
    score = F.round(100 * (0.5 * coverage + 0.3 * citations + 0.2 * length), 4)
    return score, F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").otherwise("D")


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def requirement_id(doc: Column, clause: Column, number: Column) -> Column:
    return F.format_string("%s_%s_R%02d", doc.cast("string"), clause.cast("string"), number.cast("int"))


def canonical_id(kind: Column, surface: Column, doc: Column, known: Column) -> Column:
    """A dictionary id, a code's own id, or a provisional one that names type, surface and document."""
    code = F.regexp_extract(surface, r"^([A-Z]{2,4})[ -]?(\d{3,})", 0)
    return F.coalesce(known, F.when(code != "", F.concat(F.lit("code:"), F.regexp_replace(code, "[ -]", ""))), F.concat_ws("::", kind, F.lower(surface), doc.cast("string")))


def value_kind(value: Column) -> Column:
    """Kind of a value of text: missing, number, date, boolean, json or text."""
    trimmed = F.trim(value)
    return (
        F.when(trimmed.isNull() | (trimmed == ""), "missing")
        .when(trimmed.try_cast("double").isNotNull(), "number")
        .when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}") & F.try_to_date(F.substring(trimmed, 1, 10), "yyyy-MM-dd").isNotNull(), "date")
        .when(F.lower(trimmed).isin("true", "false"), "boolean")
        .when(trimmed.rlike(r"^[\[{]") & F.try_parse_json(trimmed).isNotNull(), "json")
        .otherwise("text")
    )


@query("e01_local_day", "SELECT event_id, strftime(CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 8 HOUR ELSE ts END, '%Y-%m-%d') AS day FROM events")
def e01_local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", local_day(written).alias("day"))


#: Sources and words that the query puts into the articles it makes of documents.
_SOURCES, _SAID = ("aria_fr", "nite_chem", "ntsb_news", "worksafe_vic", "mem_history", "mem_report", "agency"), ("", "The final report", "a LEAK and fire", "Fined, he was", "safety tips", "a fire caused it", "事故")


@query(
    "e11_article_type",
    f"""WITH a AS (SELECT doc_id, {list(_SOURCES)}[length(text) % 7 + 1] AS source_id, lower({list(_SAID)}[length(text) // 7 % 7 + 1] || ' ' || text) AS t FROM documents)
       SELECT doc_id, CASE {' '.join(f"WHEN {source} AND regexp_matches(t, '{words}') THEN '{kind}'" for kind, source, words in ARTICLE_RULES)} ELSE 'news' END AS kind FROM a""",
)
def e11_article_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % 7 + 1).cast("int"))
    size = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", article_type(pick(_SAID, F.floor(size / 7)), F.col("text"), pick(_SOURCES, size)).alias("kind"))


@query("e09_intent_score", "SELECT doc_id, (2 * (contains(text, 'with')::INT + contains(text, 'from')::INT) + contains(text, 'this')::INT)::INT AS score FROM documents")
def e09_intent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", intent_score(F.col("text"), ["with", "from"], ["this"]).alias("score"))


@query(
    "e10_wiki_quality",
    """SELECT doc_id, s AS score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 75 THEN 'B' WHEN s >= 60 THEN 'C' ELSE 'D' END AS level FROM (SELECT doc_id, round(100 * (0.5 * (doc_id % 5) / 4 + 0.3 * (doc_id % 3) / 2 + 0.2 * least(1.0, n_chars / 2000)), 4) AS s FROM documents)""",
)
def e10_wiki_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, level = wiki_quality((F.col("doc_id") % 5) / 4, (F.col("doc_id") % 3) / 2, F.least(F.lit(1.0), F.col("n_chars") / 2000))
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"), level.alias("level"))


@query("e17_clamp", "SELECT c_custkey, greatest(0.0, least(1.0, round(c_acctbal / 5000, 6))) AS confidence FROM customer")
def e17_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", clamp(F.round(F.col("c_acctbal") / 5000, 6)).alias("confidence"))


@query(
    "e19_canonical_ids",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'dict:' || p_size WHEN p_partkey % 4 = 1 THEN 'code:GB' || (p_partkey + 100) ELSE 'part::' || lower(p_name) || '::' || p_size END AS id FROM part""",
)
def e19_canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface = F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("GB "), F.col("p_partkey") + 100)).otherwise(F.col("p_name"))
    known = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("dict:"), "p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", canonical_id(F.lit("part"), surface, F.col("p_size"), known).alias("id"))


@query("e20_requirement_ids", "SELECT l_orderkey, l_linenumber, l_orderkey || '_' || l_returnflag || '_R' || lpad(l_linenumber::VARCHAR, 2, '0') AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag")
def e20_requirement_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = requirement_id(F.col("l_orderkey"), F.col("l_returnflag"), F.col("l_linenumber")).alias("id")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", made).agg(F.count("*").alias("n"))


@query("e14_value_kinds", "SELECT kind, count(*) AS n FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'number' WHEN 2 THEN 'date' WHEN 3 THEN 'text' ELSE 'missing' END AS kind FROM events) GROUP BY 1")
def e14_value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    value = F.when(k == 0, F.col("props")).when(k == 1, F.col("value").cast("string")).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).when(k == 3, F.col("event_type")).otherwise(" ")
    return table(spark, sf_dir, "events").groupBy(value_kind(value).alias("kind")).agg(F.count("*").alias("n"))
