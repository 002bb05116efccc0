"""Column expressions over texts: terms, normalisers, chunkers, extraction and parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.registry import query
from quillspar.sources.tables import table


#: Names to look for; an alternation takes the first that fits, so longer ones stand first.
NAMES = ("license", "licensed", "token", "password", "secret", "with", "without", "from")
MENTIONS = "|".join(sorted(NAMES, key=lambda name: (-len(name), name)))


def terms(text: Column) -> Column:
    """Distinct search terms: runs of a-z and digits first, then Han runs as pairs of neighbours (a single sign stays)."""
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(r"[一-鿿]+"), F.lit(0))
    pairs = F.flatten(
        F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    )
    return F.array_distinct(F.concat(latin, pairs))


def canonical_label(text: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def windows(frame: DataFrame, size: int, overlap: int, tail: bool) -> DataFrame:
    """Pieces of ``size`` code points every ``size - overlap``; ``tail`` keeps a last piece that holds overlap only."""
    step = size - overlap
    last = F.length("text") - 1 if tail else F.greatest(F.lit(0), F.length("text") - overlap - 1)
    rows = frame.where("length(text) > 0").select("doc_id", "text", F.posexplode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).alias("chunk", "start"))
    return rows.select("doc_id", "chunk", "start", F.expr(f"substring(text, start + 1, {size})").alias("piece"))


def status_of(text: Column) -> Column:
    """Status words to an enumeration."""
    return F.when(F.contains(text, F.lit("废止")), "repealed").when(F.contains(text, F.lit("失效")), "expired").when(F.contains(text, F.lit("现行")), "current").otherwise("unknown")


def spreadsheet_safe(value: Column) -> Column:
    """A quote before cells that a spreadsheet would take for a formula."""
    return F.when(F.ltrim(value).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def safe_url(url: Column) -> Column:
    """The address if it is http(s) with a host and without credentials, else null."""
    return F.when(url.rlike(r"^https?://[^/?#@\s]+([/?#]|$)"), url)


@query("x03_canonical_label", "SELECT p_partkey, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g') AS label FROM part")
def x03_canonical_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", canonical_label(F.col("p_name")).alias("label"))


@query(
    "x13_windows",
    """SELECT doc_id, ((s) // 700)::INT AS chunk, s::INT AS start, md5(doc_id || '_' || (s // 700)) AS chunk_id, length(substr(text, s + 1, 800))::INT AS size
       FROM (SELECT doc_id, text, unnest(range(0, length(text), 700)) AS s FROM documents WHERE length(text) > 0)""",
)
def x13_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = windows(table(spark, sf_dir, "documents"), 800, 100, tail=True)
    return pieces.select("doc_id", "chunk", "start", F.md5(F.concat_ws("_", "doc_id", "chunk")).alias("chunk_id"), F.length("piece").alias("size"))


@query(
    "x14_body_windows",
    """SELECT doc_id, (s // 1200)::INT AS chunk, s::INT AS start, sha256(substr(text, s + 1, 1800)) AS digest
       FROM (SELECT doc_id, text, unnest(range(0, greatest(1, length(text) - 600), 1200)) AS s FROM documents WHERE length(text) > 0)""",
)
def x14_body_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = windows(table(spark, sf_dir, "documents"), 1800, 600, tail=False)
    return pieces.select("doc_id", "chunk", "start", F.sha2("piece", 256).alias("digest"))


@query(
    "x11_rule_extraction",
    """SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(text, '[A-Za-z0-9.]+@[a-z0-9.]+')), ',') AS addresses, len(regexp_extract_all(text, '[0-9]{4,}'))::INT AS numbers
       FROM documents WHERE regexp_matches(text, '[0-9]{4,}|@')""",
)
def x11_rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9.]+@[a-z0-9.]+"), F.lit(0)))
    rows = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]{4,}|@"))
    return rows.select("doc_id", F.array_join(found, ",").alias("addresses"), F.regexp_count("text", F.lit("[0-9]{4,}")).alias("numbers"))


@query(
    "x15_sections",
    """WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
       s AS (SELECT *, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS section FROM l)
       SELECT doc_id, section::BIGINT AS section, count(*) AS lines, sum(length(line))::BIGINT AS characters FROM s GROUP BY ALL""",
)
def x15_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    order = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.length("line") < 40, 1).otherwise(0)
    return lines.withColumn("section", F.sum(heading).over(order)).groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"))


@query("x21_links", "SELECT page_id, count(*) AS links, count(DISTINCT u) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS u FROM pages) GROUP BY 1")
def x21_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("u")
    return table(spark, sf_dir, "pages").select("page_id", found).groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("u").alias("targets"))


@query("x27_clean", "SELECT doc_id, CASE WHEN length(c) < 200 THEN 'short' ELSE 'normal' END AS quality, length(c)::INT AS size FROM (SELECT doc_id, trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g')) AS c FROM documents)")
def x27_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.trim(F.regexp_replace("text", r"\n{3,}", "\n\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", clean.alias("c"))
    return rows.select("doc_id", F.when(F.length("c") < 200, "short").otherwise("normal").alias("quality"), F.length("c").alias("size"))


@query("f21_safe_url", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#@\\s]+([/?#]|$)') THEN url END AS url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def f21_safe_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", safe_url(F.col("url")).alias("url"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"))


@query("e12_digests", "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents")
def e12_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"), F.md5("text").alias("md5"))


@query("e18_json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def e18_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("e04_truncations", "SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y') AS year, count(*) AS n FROM events GROUP BY ALL")
def e04_truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy").alias("year")).agg(F.count("*").alias("n"))


@query("s16_spreadsheet_safe", "SELECT event_id, CASE WHEN regexp_matches(v, '^\\s*[=+\\-@]') THEN '''' || v ELSE v END AS cell FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '=' WHEN 1 THEN ' -' ELSE '' END || event_type AS v FROM events)")
def s16_spreadsheet_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.when(F.col("event_id") % 4 == 0, "=").when(F.col("event_id") % 4 == 1, " -").otherwise(""), "event_type")
    return table(spark, sf_dir, "events").select("event_id", spreadsheet_safe(raw).alias("cell"))
