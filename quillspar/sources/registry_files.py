"""Files of a registry: inventory by path and name, resolution of documents to files, defaults for what cannot be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.functions.parsing import nfkc
from quillspar.registry import query
from quillspar.sources.shared import Steps, dealt
from quillspar.sources.tables import table

#: Patterns of standard codes in the names of files, tried in this order.
CODES = (
    r"GB[_\s]?/?T[_\s]*\d+[\.\d]*[-_]\d{4}", r"DB\d+[_\s]?T[_\s]*\d+[\.\d]*[-_]\d{4}", r"AQ[_\s]?T[_\s]*\d+[\.\d]*[-_]\d{4}", r"AQ[_\s]*\d+[\.\d]*[-_]\d{4}", r"GA[_\s]*\d+[\.\d]*[-_]\d{4}",
    r"HG[_\s]?T[_\s]*\d+[\.\d]*[-_]\d{4}", r"JT[_\s]?T[_\s]*\d+[\.\d]*[-_]\d{4}", r"SY[_\s]*\d+[\.\d]*[-_]\d{4}", r"T[_\s]*\d+[\.\d]*[-_]\d{4}",
)
YEAR = r"(19\d{2}|20\d{2})"
#: Scores of a file by what of a document its name holds, and signs that a part of a title must have.
SCORES, TITLE, CODE, TAIL, QUOTED = {"same": 100, "code": 95, "title": 90, "quoted": 85, "tail": 80}, 8, 7, 12, 8


def json_or_default(spark: SparkSession, path: str, schema: str, default: DataFrame) -> DataFrame:
    """A JSON array or object a file, or ``default`` where there is no file or any of them is corrupt."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
        return default
    marked = spark.read.schema(f"{schema}, _bad string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    broken = marked.where("_bad IS NOT NULL").limit(1).collect()  # with the other columns: the mark alone cannot be read
    return default if broken else marked.drop("_bad")


def numbered(frame: DataFrame, *keys: str) -> DataFrame:
    """Adds ``number``, from 1 in the order of ``keys``: sorted by ranges over all tasks, whose sizes alone are added up in one place."""
    steps = Steps(frame.sparkSession, "numbered")
    placed = steps.keep(frame.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = sizes.select("_range", "_first", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_range").withColumn("number", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_range", "_at", "_first", "_before")


def name_code(name: Column) -> Column:
    """The standard code in a file's name, by the first pattern that is found: strokes for low lines, no spaces, capitals; empty if none."""
    stem = F.replace(name, F.lit(".pdf"), F.lit(""))
    found = F.coalesce(*[F.nullif(F.regexp_extract(stem, f"(?i){pattern}", 0), F.lit("")) for pattern in CODES], F.lit(""))
    return F.upper(F.regexp_replace(F.replace(F.replace(F.replace(found, F.lit("_"), F.lit("/")), F.lit(" "), F.lit("")), F.lit("//"), F.lit("/")), r"\.+$", ""))


def pdf_inventory(files: DataFrame) -> DataFrame:
    """The inventory of PDF files (path below the root, size in bytes): kind and status by path, code and year by name, numbered by path."""
    name = F.element_at(F.split("path", "/"), -1)
    law, old = F.col("path").startswith("法规"), F.contains("path", F.lit("已废止地方标准"))
    years = F.regexp_extract_all(name, F.lit(YEAR), F.lit(1))
    rows = files.where(F.lower("path").endswith(".pdf")).select(
        "path", name.alias("filename"), F.when(law, "法规").otherwise("标准").alias("document_type"), F.when(~law & old, "ABOLISHED").otherwise("ACTIVE").alias("document_status"),
        F.when(law, "").when(old, "废止").otherwise("现行").alias("standard_status"), name_code(name).alias("standard_code"), F.coalesce(F.get(years, F.size(years) - 1), F.lit("")).alias("year"),
        F.round(F.col("size") / 1024 / 1024, 2).alias("size_mb"), F.lit("WAIT").alias("parse_status"),
    )
    return numbered(rows, "path")


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder) and size of all files; their contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    root = folder.split("://")[-1].rstrip("/") + "/"
    return listed.select(F.substring_index("path", root, -1).alias("path"), "size")


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+", "")


def _patterns(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, pattern, years): what names are searched for."""
    short = F.when(F.col("doc_id").startswith("STD_"), _plain(F.substring("doc_id", 5, 1 << 20))).otherwise("")
    own = _plain(F.col("code"))
    title = F.coalesce("title", F.lit(""))
    rows = documents.select(
        "doc_id", _plain(title).alias("title"), F.when((short != "") & ((own == "") | (F.length(short) > F.length(own))), short).otherwise(own).alias("code"),
        F.array_join(F.regexp_extract_all(F.coalesce("code", F.lit("")), F.lit("(?:19|20)\\d{2}"), F.lit(0)), ",").alias("years"), F.split(title, "关于|印发", -1).alias("tails"),
        F.transform(F.regexp_extract_all(title, F.lit("《([^》]+)》"), F.lit(1)), lambda q: F.regexp_replace(q, "^全省", "")).alias("quoted"),
    )
    part = lambda kind, frame, text, least: frame.select("doc_id", F.lit(kind).alias("kind"), text.alias("pattern"), "years").where(F.length("pattern") >= least)
    tails, quoted = (rows.select("doc_id", "years", F.explode(name).alias("raw")) for name in ("tails", "quoted"))
    found = part("title", rows, F.col("title"), TITLE).unionByName(part("code", rows, F.col("code"), CODE))
    return found.unionByName(part("tail", tails, _plain(F.col("raw")), TAIL)).unionByName(part("quoted", quoted, _plain(F.col("raw")), QUOTED)).distinct()


def _grams(text: Column) -> Column:
    """The distinct runs of CODE signs of a text; every pattern has one."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - CODE + 1), lambda k: F.substring(text, k, F.lit(CODE))))


def _held(names: DataFrame, patterns: DataFrame, limit: int) -> DataFrame:
    """(pattern, plain): which names (plain) hold which of the distinct patterns, of CODE signs or more.

    A pattern is looked for in the names that have its rarest run of signs, so signs that most names share are no one's clue.
    A task takes about ``limit`` patterns. Runs are many times the names that they are made of, which no estimate tells, so all is merge-joined.
    """
    runs = names.select("plain").where(F.length("plain") >= CODE).distinct().select("plain", F.explode(_grams(F.col("plain"))).alias("gram"))
    wanted = dealt(patterns.select("pattern").distinct(), patterns.count(), "pattern", each=limit)
    asked = wanted.select("pattern", F.explode(_grams(F.col("pattern"))).alias("gram"))
    known = runs.groupBy("gram").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    rarest = asked.join(known.hint("merge"), "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.struct(n.alias("n"), "gram")).alias("gram"), F.min(n).alias("n"))
    return rarest.where("n > 0").select("pattern", "gram").join(runs.hint("merge"), "gram").where(F.contains("plain", F.col("pattern"))).select("pattern", "plain")


def resolve_sources(documents: DataFrame, files: DataFrame, limit: int = 100_000) -> DataFrame:
    """(doc_id, path, score) of the documents (doc_id, title, code) whose best-scored file (path) is the only one with that score.

    Scores: the name is the title 100, holds the code 95, the title 90, a quoted title 85 (and begins with a year of the
    code, if it has any), a part of the title 80. Names and patterns are compared without marks, white space and case.
    """
    steps = Steps(documents.sparkSession, "resolve")
    name = F.element_at(F.split("path", "/"), -1)
    # Files whose names compare alike are one row: what holds of one holds of all, and a year has four signs.
    named = files.select("path", F.substring(name, 1, 4).alias("begin"), _plain(F.regexp_replace(name, r"\.[^.]*$", "")).alias("plain")).distinct()
    named = steps.keep(named.groupBy("plain", "begin").agg(F.count("*").alias("n"), F.min("path").alias("path")))
    patterns = steps.keep(_patterns(documents))
    found = ("doc_id", "plain", "begin", "n", "path")
    same = documents.select("doc_id", _plain(F.col("title")).alias("plain")).where("plain <> ''").distinct().join(named.hint("merge"), "plain").select(*found, F.lit(SCORES["same"]).alias("score"))
    hits = patterns.join(_held(named, patterns, limit).hint("merge"), "pattern").join(named.hint("merge"), "plain")
    begins = (F.col("years") == "") | F.exists(F.split("years", ","), lambda y: F.col("begin") == y)
    score = F.element_at(F.create_map(*[F.lit(x) for pair in SCORES.items() for x in pair]), F.col("kind"))
    same = same.unionByName(hits.where((F.col("kind") != "quoted") | begins).select(*found, score.alias("score")))
    best = same.groupBy("doc_id", "plain", "begin").agg(F.max("score").alias("score"), F.first("n").alias("n"), F.first("path").alias("path"))
    scored = best.groupBy("doc_id", "score").agg(F.sum("n").alias("n"), F.min("path").alias("path"))
    winners = scored.groupBy("doc_id").agg(F.max(F.struct("score", "n", "path")).alias("top")).select("doc_id", "top.*")
    return winners.where("n = 1").select("doc_id", "path", "score")


def cache_key(name: Column, url: Column) -> Column:
    """The key under which a page is kept: the digest of name and address as a JSON list."""
    escaped = name, url
    for sign, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = tuple(F.replace(text, F.lit(sign), F.lit(written)) for text in escaped)
    return F.sha2(F.concat(F.lit('["'), escaped[0], F.lit('", "'), escaped[1], F.lit('"]')), 256)


def cached_articles(requests: DataFrame, cache: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Requests (name, url) with ``key`` and ``hit``: whether the cache (key, name, status, fetched) holds that name's page, fetched within ``days``."""
    keyed = requests.withColumn("key", cache_key(F.col("name"), F.col("url")))
    held = cache.where(F.col("status") == "fetched").select("key", F.col("name").alias("_name"), "fetched")
    young = (F.col("fetched") > now - F.make_interval(days=F.lit(days))) & (F.col("_name") == F.col("name"))
    return keyed.join(held, "key", "left").groupBy(*[F.col(c) for c in keyed.columns]).agg(F.coalesce(F.bool_or(young), F.lit(False)).alias("hit"))


def _code_sql() -> str:
    found = ", ".join(f"nullif(regexp_extract(stem, '{pattern}', 0, 'i'), '')" for pattern in CODES)
    return f"upper(regexp_replace(replace(replace(replace(coalesce({found}, ''), '_', '/'), ' ', ''), '//', '/'), '\\.+$', ''))"


@query(
    "s13_pdf_inventory",
    rf"""WITH f AS (SELECT CASE p_size % 3 WHEN 0 THEN '法规/' WHEN 1 THEN '地方/已废止地方标准/' ELSE 'x/' END || CASE p_partkey % 5 WHEN 0 THEN 'GB_T ' || p_partkey || '.1-20' || 10 + p_size WHEN 1 THEN 'db11 T_' || p_partkey || '-1999_' || p_name WHEN 2 THEN 'AQ ' || p_partkey || '-2007 2019版'
          WHEN 3 THEN p_name || ' sy/5225-2019' ELSE p_name END || '_' || p_partkey || CASE WHEN p_partkey % 9 = 0 THEN '.PDF' WHEN p_partkey % 11 = 0 THEN '.doc' ELSE '.pdf' END AS path, p_size * 100000 AS size FROM part),
        n AS (SELECT *, split_part(path, '/', len(string_split(path, '/'))::INT) AS name FROM f WHERE lower(path) LIKE '%.pdf'), s AS (SELECT *, replace(name, '.pdf', '') AS stem FROM n)
       SELECT path, CASE WHEN starts_with(path, '法规') THEN '法规' ELSE '标准' END AS document_type, CASE WHEN starts_with(path, '法规') THEN '' WHEN contains(path, '已废止地方标准') THEN '废止' ELSE '现行' END AS standard_status, {_code_sql()} AS standard_code,
         coalesce(list_extract(regexp_extract_all(name, '{YEAR}'), -1), '') AS year, round(size / 1024 / 1024, 2) AS size_mb, row_number() OVER (ORDER BY path) AS number FROM s""",
)
def s13_pdf_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of files named after the parts."""
    number, size = F.col("p_partkey"), F.col("p_size")
    folder = F.when(size % 3 == 0, "法规/").when(size % 3 == 1, "地方/已废止地方标准/").otherwise("x/")
    stem = (
        F.when(number % 5 == 0, F.concat(F.lit("GB_T "), number, F.lit(".1-20"), 10 + size)).when(number % 5 == 1, F.concat(F.lit("db11 T_"), number, F.lit("-1999_"), "p_name"))
        .when(number % 5 == 2, F.concat(F.lit("AQ "), number, F.lit("-2007 2019版"))).when(number % 5 == 3, F.concat("p_name", F.lit(" sy/5225-2019"))).otherwise(F.col("p_name"))
    )
    suffix = F.when(number % 9 == 0, ".PDF").when(number % 11 == 0, ".doc").otherwise(".pdf")
    files = table(spark, sf_dir, "part").select(F.concat(folder, stem, F.lit("_"), number, suffix).alias("path"), (size * 100_000).alias("size"))
    return pdf_inventory(files).select("path", "document_type", "standard_status", "standard_code", "year", "size_mb", "number")


@query(
    "k27_scored_sources",
    r"""WITH d AS (SELECT c_custkey AS id, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS title, CASE WHEN c_nationkey % 4 = 0 THEN 'aq' || c_custkey || '2007' ELSE '' END AS code, c_nationkey % 3 = 0 AS quoted FROM customer),
        f AS (SELECT c_mktsegment || '/' || CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'the ' || c_name || ' x' WHEN 2 THEN 'AQ ' || c_custkey - c_custkey % 8 || '-2007 of ' || c_name ELSE c_mktsegment || c_custkey END || '.pdf' AS path FROM customer
              UNION ALL SELECT 'again/' || c_name || '.v2.pdf' FROM customer WHERE c_custkey % 7 = 0),
        n AS (SELECT path, regexp_replace(lower(regexp_replace(split_part(path, '/', 2), '\.[^.]*$', '')), '[^a-z0-9]+', '', 'g') AS name FROM f),
        s AS (SELECT id, path, greatest(CASE WHEN title = name AND NOT quoted THEN 100 WHEN contains(name, title) AND NOT quoted THEN 90 ELSE 0 END, CASE WHEN length(code) >= 7 AND contains(name, code) THEN 95 ELSE 0 END,
                CASE WHEN quoted AND contains(name, title) AND code = '' THEN 85 ELSE 0 END) AS score FROM d JOIN n ON contains(name, title) OR code <> '' AND contains(name, code)),
        b AS (SELECT *, max(score) OVER (PARTITION BY id) AS best FROM s WHERE score > 0)
       SELECT id AS doc_id, min(path) AS path, best::INT AS score FROM b WHERE score = best GROUP BY id, best HAVING count(*) = 1""",
)
def k27_scored_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files, named after customers and codes, that customers are resolved to."""
    rows, number, nation = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    code = F.when(nation % 4 == 0, F.concat(F.lit("AQ "), number, F.lit("-2007"))).otherwise("")
    title = F.when(nation % 3 == 0, F.concat(F.lit("X 《全省"), "c_name", F.lit("》 Y"))).otherwise(F.col("c_name"))
    name = (
        F.when(number % 4 == 0, F.col("c_name")).when(number % 4 == 1, F.concat(F.lit("the "), "c_name", F.lit(" x")))
        .when(number % 4 == 2, F.concat(F.lit("AQ "), number - number % 8, F.lit("-2007 of "), "c_name")).otherwise(F.concat("c_mktsegment", number))
    )
    files = rows.select(F.concat("c_mktsegment", F.lit("/"), name, F.lit(".pdf")).alias("path"))
    more = rows.where(number % 7 == 0).select(F.concat(F.lit("again/"), "c_name", F.lit(".v2.pdf")).alias("path"))
    return resolve_sources(rows.select(number.alias("doc_id"), title.alias("title"), code.alias("code")), files.unionByName(more))
