"""Names: canonical entities, core titles, values that differ between pages, and the order of a fair schedule."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.registry import query
from quillspar.sources.shared import Steps
from quillspar.sources.tables import table

#: What a company's and an authority's full name holds, and a standard's code.
COMPANY, AUTHORITY = "(公司|集团|厂|有限|股份|合作社|中心)", "(委员会|管理局|人民政府|厅|局|部|院)"
CODE = r"(?:GB|AQ|DB|HG|TSG|SY|JT|NB|SN|YS|JB|JGJ|CJJ|GA|WS)\s*[/T]?\s*\d+(?:[.\-—–]\d+)*(?:[-—–]\d{2,4})?"


def surface_form(text: Column) -> Column:
    """A mention without white space, full-width brackets, commas and points as plain ones."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "（），．", "(),."), r"\s+", "")


def canonical_entities(mentions: DataFrame, chemicals: DataFrame) -> DataFrame:
    """Adds name, entity_id, physical_state, resolved, level and confidence to mentions (type, surface, doc_id, state).

    A chemical is looked up in ``chemicals`` (known, name, state); others keep their own name, with the state that is
    stated or that a sign for liquid or gas tells. A company, a standard and an authority are known by a full name or a
    code; what is not belongs to its document, as all other types do. ``surface`` comes out normalised.
    """
    rows = mentions.withColumn("surface", surface_form(F.col("surface")))
    known = chemicals.select(F.col("known").alias("_known"), F.col("name").alias("_name"), F.col("state").alias("_state")).dropDuplicates(["_known"])
    joined = rows.join(known, (F.col("type") == "chemical") & (F.col("surface") == F.col("_known")), "left")
    surface, kind, code = F.col("surface"), F.col("type"), F.regexp_extract("surface", CODE, 0)
    found = F.col("_known").isNotNull()
    by_rule = (
        ((kind == "enterprise") & surface.rlike(COMPANY)) | ((kind == "standard") & (code != "")) | (kind.isin("regulation", "regulator") & surface.rlike(AUTHORITY))
    )
    name = F.when(found, F.col("_name")).when((kind == "standard") & (code != ""), code).otherwise(surface)
    whole = F.concat_ws("::", kind, name)
    entity_id = F.when((kind == "chemical") | by_rule, whole).when((surface == "") & ~kind.isin("enterprise", "standard", "regulation", "regulator"), "").otherwise(
        F.concat(whole, F.lit("::"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    )
    told = F.when(F.contains(surface, F.lit("液")), "liquid").when(F.contains(surface, F.lit("气")), "gas")
    state = F.when(kind == "chemical", F.coalesce("state", "_state", F.when(~found, told))).otherwise(F.col("state"))
    special = kind.isin("chemical", "enterprise", "standard", "regulation", "regulator")
    return joined.withColumns({
        "name": name, "entity_id": entity_id, "physical_state": state, "resolved": F.coalesce(found | by_rule, F.lit(False)),
        "level": F.when(found, "dictionary").when(by_rule, "rule").otherwise("provisional"),
        "confidence": F.when(found, 0.95).when(by_rule, 0.9).when(special, 0.5).otherwise(0.6),
    }).drop("_known", "_name", "_state")


#: What is taken off a title, in this order: patterns and what stays of them.
TITLE_RULES = (
    (r"(?i)\.pdf$", ""), (r"^\d{8}\s*-{1,3}", ""), (r"[-_]{1,3}\d{8}$", ""), (r"\.\d{8}$", ""),
    (r"^[A-Z]{2,}\s*[_T/]?\s*\d{2,5}(?:\.\d+)?\s*[\-–—]\s*\d{4}\s*_?", ""),
    (r"《([^》]*)》", "$1"), (r"〈([^〉]*)〉", "$1"), (r"（[^）]*）", ""), (r"〔[^〕]*〕", ""), (r"［[^］]*］", ""), (r"「[^」]*」", ""), (r"『[^』]*』", ""),
    ("关于印发", ""), ("关于做好", ""), ("关于进一步加强", ""), ("关于公布", ""), ("关于发布", ""), ("关于调整", ""), ("关于修订", ""), ("关于转发", ""), ("关于", ""), ("印发", ""),
    ("的通知$", ""), ("的公告$", ""), ("的通告$", ""), ("的办法$", ""), ("的规定$", ""), ("的意见$", ""), ("的方案$", ""), ("的通知$", ""),
    (r"[、。，！“”‘’；：!?,:;\s]+", ""), (r"[\-–—―_/\\·]+", ""),
)


def core_title(text: Column) -> Column:
    """What of a title is compared: no dates, codes, bracketed parts, words of official letters, marks or white space; null is empty."""
    out = F.trim(F.coalesce(text, F.lit("")))
    for pattern, stays in TITLE_RULES:
        out = F.regexp_replace(out, pattern, stays)
    return out


#: Units of the conditions that are compared.
UNITS = r"(\d+(?:\.\d+)?)\s*(℃|MPa|kPa|mg/m³|ppm|%|kg|km|GB)"


def numeric_conflicts(sections: DataFrame, pages: int = 8) -> DataFrame:
    """(section, unit, values) of sections (page, section, content) in which pages state different numbers of one unit.

    ``values`` are structs of value and its first ``pages`` pages, by value. Pages are counted per value before they are
    listed, so a value that all pages state is no large group.
    """
    found = sections.select("page", "section", F.explode(F.regexp_extract_all("content", F.lit(UNITS), F.lit(0))).alias("m"))
    stated = found.select("section", "page", F.regexp_extract("m", UNITS, 2).alias("unit"), F.regexp_extract("m", UNITS, 1).alias("value")).distinct()
    place = F.row_number().over(Window.partitionBy("section", "unit", "value").orderBy("page"))
    listed = stated.withColumn("_place", place).where(F.col("_place") <= pages).groupBy("section", "unit", "value").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    grouped = listed.groupBy("section", "unit").agg(F.array_sort(F.collect_list(F.struct("value", "pages"))).alias("values"))
    return grouped.where(F.size("values") > 1)


def schedule(rows: DataFrame, doc: str, order: str) -> DataFrame:
    """Adds ``round`` and ``place``: every document's first row, then every second one, documents by the digest of their id.

    ``place`` counts from 1 over all rows. Rows are sorted by ranges over all tasks; only the sizes of the ranges are
    added up in one place.
    """
    steps = Steps(rows.sparkSession, "schedule")
    number = F.row_number().over(Window.partitionBy(doc).orderBy(order)).cast("long")
    keys = ["round", "_digest", doc]
    sorted_ = rows.withColumns({"round": number, "_digest": F.sha1(F.col(doc).cast("string"))}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = steps.keep(sorted_.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = sizes.select("_range", "_first", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    return placed.join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_range", "_at", "_first", "_before", "_digest")


_TYPES = ("chemical", "enterprise", "standard", "regulator", "equipment")


@query(
    "e19_entity_ids",
    rf"""WITH m AS (SELECT p_partkey AS id, ['chemical', 'enterprise', 'standard', 'regulator', 'equipment'][p_partkey % 5 + 1] AS type, p_size AS doc,
          CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_size % 3 = 0 THEN ' 液 氯' ELSE p_brand || '气' END WHEN 1 THEN p_brand || CASE WHEN p_size % 2 = 0 THEN '（北京）有限公司' ELSE '' END
            WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'see GB ' || p_partkey || '—2010 x' ELSE p_name END WHEN 3 THEN p_brand || CASE WHEN p_size % 4 = 0 THEN ' 管理局' ELSE '' END ELSE p_type END AS raw FROM part),
        s AS (SELECT *, regexp_replace(replace(replace(raw, '（', '('), '）', ')'), '\s+', '', 'g') AS surface FROM m), c AS (SELECT *, regexp_extract(surface, '{CODE}') AS code FROM s),
        r AS (SELECT *, type = 'enterprise' AND regexp_matches(surface, '{COMPANY}') OR type = 'standard' AND code <> '' OR type = 'regulator' AND regexp_matches(surface, '{AUTHORITY}') AS rule, type = 'chemical' AND surface = '液氯' AS known FROM c)
       SELECT id, CASE WHEN known THEN 'chemical::氯' WHEN type = 'chemical' THEN 'chemical::' || surface WHEN rule AND type = 'standard' THEN 'standard::' || code WHEN rule THEN type || '::' || surface ELSE type || '::' || surface || '::' || doc END AS entity_id,
         CASE WHEN known THEN 'liquid' WHEN type = 'chemical' AND contains(surface, '气') THEN 'gas' END AS physical_state, CASE WHEN known THEN 'dictionary' WHEN rule THEN 'rule' ELSE 'provisional' END AS level,
         CASE WHEN known THEN 0.95 WHEN rule THEN 0.9 WHEN type <> 'equipment' THEN 0.5 ELSE 0.6 END::DOUBLE AS confidence FROM r""",
)
def e19_entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical ids of mentions of five types, made of the parts' names, by the rules."""
    kind, even = F.col("p_partkey") % 5, lambda n: F.col("p_size") % n == 0
    surface = (
        F.when(kind == 0, F.when(even(3), " 液 氯").otherwise(F.concat("p_brand", F.lit("气")))).when(kind == 1, F.concat("p_brand", F.when(even(2), "（北京）有限公司").otherwise("")))
        .when(kind == 2, F.when(even(2), F.concat(F.lit("see GB "), "p_partkey", F.lit("—2010 x"))).otherwise(F.col("p_name"))).when(kind == 3, F.concat("p_brand", F.when(even(4), " 管理局").otherwise("")))
        .otherwise(F.col("p_type"))
    )
    kinds = F.element_at(F.array(*map(F.lit, _TYPES)), (kind + 1).cast("int"))
    mentions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kinds.alias("type"), surface.alias("surface"), F.col("p_size").alias("doc_id"), F.lit(None).cast("string").alias("state"))
    chemicals = spark.createDataFrame([("液氯", "氯", "liquid")], "known string, name string, state string")
    return canonical_entities(mentions, chemicals).select("id", "entity_id", "physical_state", "level", "confidence")


def _title_sql(column: str) -> str:
    out = f"trim({column})"
    for pattern, stays in TITLE_RULES:
        plain, flags = (pattern[4:], "gi") if pattern.startswith("(?i)") else (pattern, "g")
        out = f"regexp_replace({out}, '{plain}', '{stays.replace('$', chr(92))}', '{flags}')"
    return out


@query(
    "x09_core_titles",
    f"""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '20240131--关于印发《' || p_name || '》的通知.PDF' WHEN 1 THEN 'GB ' || p_partkey + 100 || '.' || p_size || ' — 2010_' || p_name || '（试行）.pdf'
          WHEN 2 THEN p_name || '〔' || p_size || '〕的公告-20230102' ELSE ' 关于进一步加强' || p_type || '、' || p_brand || '的意见' END AS title FROM part) SELECT id, {_title_sql("title")} AS title FROM t""",
)
def x09_core_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core titles, by all rules, of titles made of the parts' names."""
    kind, name = F.col("p_partkey") % 4, F.col("p_name")
    title = (
        F.when(kind == 0, F.concat(F.lit("20240131--关于印发《"), name, F.lit("》的通知.PDF")))
        .when(kind == 1, F.concat(F.lit("GB "), F.col("p_partkey") + 100, F.lit("."), "p_size", F.lit(" — 2010_"), name, F.lit("（试行）.pdf")))
        .when(kind == 2, F.concat(name, F.lit("〔"), "p_size", F.lit("〕的公告-20230102"))).otherwise(F.concat(F.lit(" 关于进一步加强"), "p_type", F.lit("、"), "p_brand", F.lit("的意见")))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), core_title(title).alias("title"))


@query(
    "a29_section_conflicts",
    f"""WITH t AS (SELECT p_brand AS section, p_partkey AS page, p_name || ' below ' || p_size % 7 || ['℃', ' MPa', ' ppm'][p_partkey % 3 + 1] || ', ' || p_size || ' kg or ' || p_size % 3 || '.5 kg' AS content FROM part),
        m AS (SELECT section, page, unnest(regexp_extract_all(content, '{UNITS}', 0)) AS m FROM t),
        v AS (SELECT DISTINCT section, page, regexp_extract(m, '{UNITS}', 2) AS unit, regexp_extract(m, '{UNITS}', 1) AS value FROM m), p AS (SELECT *, row_number() OVER (PARTITION BY section, unit, value ORDER BY page) AS r FROM v),
        l AS (SELECT section, unit, value, string_agg(page::VARCHAR, ' ' ORDER BY page) AS pages FROM p WHERE r <= 8 GROUP BY ALL)
       SELECT section, unit, string_agg(value || ':' || pages, ',' ORDER BY value) AS stated FROM l GROUP BY ALL HAVING count(*) > 1""",
)
def a29_section_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of one unit that differ between the parts of one brand, in sentences made of their sizes."""
    unit = F.element_at(F.array(*map(F.lit, ("℃", " MPa", " ppm"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    content = F.concat("p_name", F.lit(" below "), F.col("p_size") % 7, unit, F.lit(", "), "p_size", F.lit(" kg or "), F.col("p_size") % 3, F.lit(".5 kg"))
    found = numeric_conflicts(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.col("p_brand").alias("section"), content.alias("content")))
    pages = lambda v: F.array_join(F.transform(v["pages"], lambda p: p.cast("string")), " ")
    stated = F.array_join(F.transform("values", lambda v: F.concat(v["value"], F.lit(":"), pages(v))), ",")
    return found.select("section", "unit", stated.alias("stated"))


@query(
    "w05_schedule",
    """SELECT conv_id, turn, round, row_number() OVER (ORDER BY round, sha1(conv_id::VARCHAR), conv_id) AS place
       FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round FROM conversations)""",
)
def w05_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every turn in a schedule that is fair to conversations."""
    return schedule(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")
