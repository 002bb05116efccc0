"""Multi-label dashboard analytics: filters, groups, totals, marginals and chart tables.

Facts have an id, labels (plain or arrays of several) and metrics. Filters are
joined by AND, the values of one filter by OR. Groups count distinct facts, so
a total is computed on the facts and never as the sum of its groups.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.registry import query
from quillspar.sources.tables import table

#: Fixed value: the label of facts without one.
UNLABELLED = "未标注"
MAX_DIMENSIONS, MAX_FILTERS, MAX_VALUES, MAX_SEARCH, MAX_GROUPS = 2, 12, 250, 200, 500


@dataclass(frozen=True)
class DashboardQuery:
    """A request; ``checked`` raises ValueError on anything outside the allowed shape."""

    dimensions: tuple[str, ...]
    metric: str | None = None
    filters: dict[str, tuple[str, ...]] = field(default_factory=dict)
    search: str = ""
    first: str | None = None
    last: str | None = None
    unknown: str = "include"

    def checked(self, facts: DataFrame) -> DashboardQuery:
        known = set(facts.columns)
        if not self.dimensions or len(set(self.dimensions)) != len(self.dimensions) or len(self.dimensions) > MAX_DIMENSIONS:
            raise ValueError("one or two different dimensions are needed")
        if not {*self.dimensions, *self.filters, *([self.metric] if self.metric else [])} <= known:
            raise ValueError("unknown column")
        if len(self.filters) > MAX_FILTERS or any(len(v) > MAX_VALUES for v in self.filters.values()) or len(self.search) > MAX_SEARCH:
            raise ValueError("the request is too large")
        if self.unknown not in ("include", "exclude", "only") or self.first and self.last and self.first > self.last:
            raise ValueError("bad date range")
        return self


def labels(frame: DataFrame, name: str) -> Column:
    """The labels of a column as an array without blanks and repeats; UNLABELLED if none is left."""
    if dict(frame.dtypes)[name].startswith("array"):
        found = F.array_distinct(F.filter(F.col(name), lambda x: F.trim(x) != ""))
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(UNLABELLED)))
    text = F.col(name).cast("string")
    return F.array(F.when(F.trim(text) != "", text).otherwise(F.lit(UNLABELLED)))


def select_facts(facts: DataFrame, asked: DashboardQuery, date: str | None = None, text: str | None = None) -> DataFrame:
    """The facts that pass all filters, the search and the date range with its policy on unknown dates."""
    asked.checked(facts)
    kept = [F.arrays_overlap(labels(facts, name), F.array(*map(F.lit, values))) for name, values in asked.filters.items()]
    if asked.search and text:
        kept.append(F.contains(F.lower(F.col(text)), F.lit(asked.search.lower())))
    if date:
        known = F.col(date).isNotNull()
        inside = reduce(lambda a, b: a & b, [F.col(date) >= F.lit(asked.first)] * bool(asked.first) + [F.col(date) <= F.lit(asked.last)] * bool(asked.last), F.lit(True))
        kept.append({"include": ~known | inside, "exclude": known & inside, "only": ~known}[asked.unknown])
    return reduce(lambda rows, keep: rows.where(keep), kept, facts)


def group_facts(facts: DataFrame, keys: list[str], id_col: str, metric: str | None = None) -> DataFrame:
    """Groups by ``keys``: value is the number of distinct facts, or the sum of ``metric`` over them."""
    for key in keys:
        facts = facts.withColumn(key, F.explode(labels(facts, key)))
    if metric is None:
        return facts.groupBy(*keys).agg(F.countDistinct(id_col).alias("value"), F.count("*").alias("records"))
    once = facts.groupBy(*keys, id_col).agg(F.max(metric).alias("_m"), F.count("*").alias("_n"))
    return once.groupBy(*keys).agg(F.sum("_m").alias("value"), F.sum("_n").alias("records"))


def marginals(facts: DataFrame, dimensions: list[str], id_col: str) -> DataFrame:
    """Exact distinct counts per value of every dimension, and of all facts, in one pass of grouping sets."""
    for name in dimensions:
        facts = facts.withColumn(name, F.explode(labels(facts, name)))
    sets = [[F.col(name)] for name in dimensions] + [[]]
    level = reduce(lambda a, b: a.when(F.grouping(b) == 0, F.lit(b)), dimensions[1:], F.when(F.grouping(dimensions[0]) == 0, F.lit(dimensions[0])))
    return (
        facts.groupingSets(sets, *dimensions)
        .agg(F.countDistinct(id_col).alias("value"), level.otherwise(F.lit("total")).alias("dimension"))
        .select("dimension", F.coalesce(*dimensions).alias("label"), "value")
    )


def box_plot(facts: DataFrame, group: str, metric: str) -> DataFrame:
    """Quartiles by linear interpolation, whiskers at the last values within 1.5 ranges, and outliers."""
    facts = facts.where(F.col(group).isNotNull() & F.col(metric).isNotNull())
    q = facts.groupBy(group).agg(*[F.percentile(metric, p).alias(n) for p, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))], F.count("*").alias("n"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(metric).between(F.col("q1") - reach, F.col("q3") + reach)
    ends = facts.join(q, group).groupBy(group).agg(
        F.min(F.when(inside, F.col(metric))).alias("low"), F.max(F.when(inside, F.col(metric))).alias("high"), F.count_if(~inside).alias("outliers")
    )
    return q.join(ends, group)


def histogram(facts: DataFrame, metric: str, bins: int = 8) -> DataFrame:
    """Bins of equal whole width from zero, the last one closed; empty bins are listed."""
    step = facts.agg(F.greatest(F.lit(1), F.ceil(F.max(metric) / bins)).cast("long").alias("step"))
    placed = facts.where(F.col(metric).isNotNull()).crossJoin(F.broadcast(step)).select(F.least(F.lit(bins - 1), F.floor(F.col(metric) / F.col("step"))).alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    every = step.select("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.col("bin") * F.col("step")).alias("start"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def coverage(facts: DataFrame, names: list[str]) -> DataFrame:
    """Missing values and coverage per column, one scan for all."""
    missing = [F.count_if(F.col(n).isNull() | (F.trim(F.col(n).cast("string")) == "")).alias(n) for n in names]
    row = facts.agg(F.count("*").alias("_all"), *missing)
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("missing")) for n in names])).alias("s")
    return row.select("_all", stacked).select("s.dimension", "s.missing", F.round(100 * (1 - F.col("s.missing") / F.col("_all")), 1).alias("coverage"))


#: Fixed value: the words that stand in for chemical names on the driver's texts.
LEXICON = ("with", "this", "which", "und", "der", "que", "las", "les", "une")
MENTION = "|".join(sorted(LEXICON, key=lambda w: (-len(w), w)))


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of documents with several labels: the lexicon's words that the text mentions."""
    mentions = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(MENTION), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text", mentions.alias("labels"))


_FACTS = f"""facts AS (SELECT doc_id, lang, source, n_chars, text,
  CASE WHEN len(l) > 0 THEN l ELSE ['{UNLABELLED}'] END AS labels
  FROM (SELECT *, list_distinct(regexp_extract_all(lower(text), '{MENTION}')) AS l FROM documents))"""


@query("agg_multi_label", "SELECT lang, source, count(DISTINCT doc_id) AS value, count(*) AS records FROM documents GROUP BY lang, source")
def agg_multi_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_facts(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id")


@query("a01_label_groups", f"WITH {_FACTS} SELECT unnest(labels) AS labels, count(DISTINCT doc_id) AS value, count(*) AS records FROM facts GROUP BY 1")
def a01_label_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_facts(document_facts(spark, sf_dir), ["labels"], "doc_id")


@query(
    "a01_label_metric",
    f"""WITH {_FACTS} SELECT lang, label AS labels, sum(n_chars)::BIGINT AS value, count(*) AS records
        FROM (SELECT lang, n_chars, unnest(labels) AS label FROM facts) GROUP BY ALL""",
)
def a01_label_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_facts(document_facts(spark, sf_dir), ["lang", "labels"], "doc_id", "n_chars")


@query("a02_grand_total", "SELECT count(DISTINCT doc_id) AS facts, sum(n_chars)::BIGINT AS characters FROM documents")
def a02_grand_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.countDistinct("doc_id").alias("facts"), F.sum("n_chars").alias("characters"))


@query(
    "a03_marginals",
    f"""WITH {_FACTS}, e AS (SELECT doc_id, lang, unnest(labels) AS label FROM facts)
        SELECT 'lang' AS dimension, lang AS label, count(DISTINCT doc_id) AS value FROM e GROUP BY lang
        UNION ALL SELECT 'labels', label, count(DISTINCT doc_id) FROM e GROUP BY label
        UNION ALL SELECT 'total', NULL, count(DISTINCT doc_id) FROM e""",
)
def a03_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marginals(document_facts(spark, sf_dir), ["lang", "labels"], "doc_id")


@query(
    "a04_ordered_groups",
    f"""SELECT * FROM (SELECT source, count(DISTINCT doc_id) AS value, count(*) AS records, count(*) OVER () AS groups FROM documents GROUP BY source)
        ORDER BY value DESC, source LIMIT {MAX_GROUPS}""",
)
def a04_ordered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = group_facts(table(spark, sf_dir, "documents"), ["source"], "doc_id")
    total = groups.agg(F.count("*").alias("groups"))
    return groups.crossJoin(F.broadcast(total)).orderBy(F.desc("value"), "source").limit(MAX_GROUPS)


@query(
    "a05_facets",
    """SELECT 'lang' AS facet, lang AS label, count(DISTINCT doc_id) AS value FROM documents GROUP BY lang
       UNION ALL SELECT * FROM (SELECT 'source' AS facet, source AS label, count(DISTINCT doc_id) AS value FROM documents GROUP BY source ORDER BY value DESC, label LIMIT 100)""",
)
def a05_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    facet = lambda name: (
        group_facts(docs, [name], "doc_id").orderBy(F.desc("value"), name).limit(100).select(F.lit(name).alias("facet"), F.col(name).alias("label"), "value")
    )
    return facet("lang").unionByName(facet("source"))


@query(
    "a06_coverage",
    """SELECT 'toxic' AS dimension, count(*) FILTER (toxic IS NULL) AS missing, round(100 * (1 - count(*) FILTER (toxic IS NULL) / count(*)), 1) AS coverage FROM documents LEFT JOIN labels USING (doc_id)
       UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL), round(100 * (1 - count(*) FILTER (lang IS NULL) / count(*)), 1) FROM documents LEFT JOIN labels USING (doc_id)""",
)
def a06_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), ["toxic", "lang"])


@query(
    "a08_box_plot",
    """WITH q AS (SELECT lang, quantile_cont(n_chars, .25) AS q1, quantile_cont(n_chars, .5) AS q2, quantile_cont(n_chars, .75) AS q3, count(*) AS n FROM documents GROUP BY lang)
       SELECT lang, any_value(q1) AS q1, any_value(q2) AS q2, any_value(q3) AS q3, any_value(n) AS n,
         min(n_chars) FILTER (n_chars BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low,
         max(n_chars) FILTER (n_chars BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high,
         count(*) FILTER (NOT n_chars BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
       FROM documents JOIN q USING (lang) GROUP BY lang""",
)
def a08_box_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_plot(table(spark, sf_dir, "documents"), "lang", "n_chars")


@query("a07_quantiles", "SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2, quantile_cont(o_totalprice, 0.9) AS q9 FROM orders GROUP BY 1")
def a07_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [F.percentile("o_totalprice", p).alias(n) for p, n in ((0.25, "q1"), (0.5, "q2"), (0.9, "q9"))]
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(*at)


@query(
    "a09_histogram",
    """WITH s AS (SELECT greatest(1, ceil(max(n_chars) / 8))::BIGINT AS step FROM documents),
       c AS (SELECT least(7, n_chars // step) AS bin, count(*) AS n FROM documents, s GROUP BY 1)
       SELECT b AS bin, b * step AS start, coalesce(n, 0) AS n FROM (SELECT unnest(range(8)) AS b), s LEFT JOIN c ON c.bin = b""",
)
def a09_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "documents"), "n_chars")


@query("a10_timeline", "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(DISTINCT o_orderkey) AS value, count(*) AS records FROM orders GROUP BY ALL")
def a10_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return group_facts(dated, ["month", "o_orderpriority"], "o_orderkey")


@query(
    "a11_tree",
    """SELECT lang AS parent, source AS child, count(DISTINCT doc_id) AS value FROM documents GROUP BY lang, source
       UNION ALL SELECT NULL, lang, count(DISTINCT doc_id) FROM documents GROUP BY lang""",
)
def a11_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaves = group_facts(docs, ["lang", "source"], "doc_id").select(F.col("lang").alias("parent"), F.col("source").alias("child"), "value")
    roots = group_facts(docs, ["lang"], "doc_id").select(F.lit(None).cast("string").alias("parent"), F.col("lang").alias("child"), "value")
    return leaves.unionByName(roots)


@query(
    "a12_network_summary",
    """WITH e AS (SELECT DISTINCT c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey)
       SELECT count(*) AS links, count(DISTINCT c_nationkey) AS sources, count(DISTINCT o_orderpriority) AS targets FROM e""",
)
def a12_network_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    edges = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderpriority").distinct()
    return edges.agg(F.count("*").alias("links"), F.countDistinct("c_nationkey").alias("sources"), F.countDistinct("o_orderpriority").alias("targets"))


@query("f07_and_or_filter", f"WITH {_FACTS} SELECT doc_id, lang FROM facts WHERE list_has_any(labels, ['with', 'und']) AND lang IN ('en', 'de')")
def f07_and_or_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = DashboardQuery(("lang",), filters={"labels": ("with", "und"), "lang": ("en", "de")})
    return select_facts(document_facts(spark, sf_dir), asked).select("doc_id", "lang")


@query(
    "f08_date_range",
    """SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS day FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS d FROM orders)
       WHERE d IS NULL OR strftime(d, '%Y-%m-%d') BETWEEN '1996-02-01' AND '1996-02-28'""",
)
def f08_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd"))
    facts = table(spark, sf_dir, "orders").withColumn("day", day)
    asked = DashboardQuery(("o_orderstatus",), first="1996-02-01", last="1996-02-28")
    return select_facts(facts, asked, date="day").select("o_orderkey", "day")


@query("f09_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def f09_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_facts(table(spark, sf_dir, "documents"), DashboardQuery(("lang",), search="License"), text="text").select("doc_id")


@query("f19_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def f19_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey"), 100, 50)


def page(ordered: DataFrame, offset: int, size: int) -> DataFrame:
    """One page of an ordered table; at most 100 rows."""
    if offset < 0 or not 1 <= size <= 100:
        raise ValueError("a page has 1 to 100 rows")
    return ordered.offset(offset).limit(size)
