"""Rule extraction and excerpts: annotations of accident and standard texts, mentions in context, chunks of the first version."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.registry import query
from quillspar.sources.shared import dealt
from quillspar.sources.tables import table

#: Patterns of counts, of which the first group that is filled holds the number.
COUNTS = {
    "death_count": r"(\d+)\s*人\s*死亡|死亡\s*(\d+)\s*人|(\d+)\s*人\s*遇难",
    "severe_injury_count": r"(\d+)\s*人\s*重伤|重伤\s*(\d+)\s*人",
    "minor_injury_count": r"(\d+)\s*人\s*轻伤|轻伤\s*(\d+)\s*人",
    "injury_count": r"(\d+)\s*人\s*受伤|受伤\s*(\d+)\s*人",
    "missing_count": r"(\d+)\s*人\s*失踪|失踪\s*(\d+)\s*人",
}
#: Patterns of codes, numbers, dates, clauses and quantities.
STANDARD_CODE = r"(?:GB|AQ|DB|HG|TSG|SY|JT|NB|SN|YS|JB|JGJ|CJJ|GA|WS)\s*[/T]?\s*\d+(?:[.\-—–]\d+)*(?:[-—–]\d{2,4})?"
CAS_NUMBER = r"(?:CAS|Cas|cas)\s*[号:：]?\s*(\d{2,7}[-]\d{2}[-]\d)"
DATES = (r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})")
CLAUSES = (r"第\s*[一二三四五六七八九十百零〇两\d]+\s*条", r"(?<!\d)((?:\d+\.){2,}\d+)(?!\.?\d)", r"(?<![\d.])(\d+\.\d+)(?=\s*[一-鿿])")
QUANTITY = r"(?:不应?|不得|禁止|必须|宜|应|应当)?\s*(?:大于|小于|不超过|不低于|不大于|不小于|超过|等于)?\s*\d+(?:\.\d+)?\s*(?:[%％]|[a-zA-Z]+(?:/[a-zA-Z0-9]+)?)"
#: Signs of which every match of a pattern has one.
SIGNS = {
    **dict(zip(COUNTS.values(), (("死亡", "遇难"), ("重伤",), ("轻伤",), ("受伤",), ("失踪",)), strict=True)),
    CAS_NUMBER: ("CAS", "Cas", "cas"), DATES[0]: ("年",), CLAUSES[0]: ("条",), CLAUSES[1]: (".",), CLAUSES[2]: (".",),
}
#: Words of modality, in the order in which they are reported.
MODALITIES = ("应当", "必须", "不得", "禁止", "不应", "不宜", "宜", "可以", "应")


def annotations(text: Column) -> dict[str, Column]:
    """Columns of what rules find in a text: counts (null if none), and distinct codes, numbers, dates, clauses, modalities and quantities in order."""

    def holds(pattern: str) -> Column:
        """Whether the text holds a sign that every match has; looking for it is much cheaper than for the pattern."""
        return reduce(Column.__or__, [F.contains(text, F.lit(sign)) for sign in SIGNS[pattern]])

    def first_number(pattern: str) -> Column:
        digits = F.regexp_extract(F.regexp_extract(text, pattern, 0), r"\d+", 0)
        return F.when(holds(pattern), F.nullif(digits, F.lit("")).cast("long"))

    def all_of(pattern: str, group: int = 0) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.when(~holds(pattern), F.array().cast("array<string>")).otherwise(found) if pattern in SIGNS else found

    def distinct(*found: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(F.concat(*found), lambda x: F.trim(x)), lambda x: x != ""))

    def dates(pattern: str) -> Column:
        parts = lambda d: [F.regexp_extract(d, pattern, k) for k in (1, 2, 3)]
        return F.transform(all_of(pattern), lambda d: F.concat_ws("-", parts(d)[0], F.lpad(parts(d)[1], 2, "0"), F.lpad(parts(d)[2], 2, "0")))

    words = F.array(*map(F.lit, MODALITIES))
    return {
        **{name: first_number(pattern) for name, pattern in COUNTS.items()},
        "standard_codes": distinct(all_of(STANDARD_CODE)), "cas_numbers": distinct(all_of(CAS_NUMBER, 1)), "dates": distinct(*map(dates, DATES)),
        "clauses": distinct(all_of(CLAUSES[0]), all_of(CLAUSES[1], 1), all_of(CLAUSES[2], 1)), "modalities": F.filter(words, lambda w: F.contains(text, w)),
        "quantities": distinct(all_of(QUANTITY)),
    }


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of accidents, one an order, so that every rule has texts to work on."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat_ws(
        "，", F.concat(day, F.lit("发生事故")), F.concat(F.col("o_orderkey") % 11, F.lit(" 人死亡")), F.concat(F.lit("受伤"), F.col("o_custkey"), F.lit("人")),
        F.concat(F.lit("违反GB "), F.col("o_orderkey"), F.lit("-2018第"), F.col("o_custkey"), F.lit("条")), F.concat(F.lit("不得超过"), F.col("o_custkey"), F.lit("mg/m3")),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    # A text takes far longer to search than an order to read, so a file of orders is shared by many tasks.
    return dealt(orders, orders.count(), "o_orderkey", each=100_000).select("o_orderkey", text.alias("text"))


@query(
    "x11_annotations",
    f"""WITH r AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '发生事故，' || (o_orderkey % 11) || ' 人死亡，受伤' || o_custkey || '人，违反GB ' || o_orderkey || '-2018第' || o_custkey || '条，不得超过' || o_custkey || 'mg/m3' AS text FROM orders)
        SELECT o_orderkey, regexp_extract(regexp_extract(text, '{COUNTS['death_count']}'), '[0-9]+')::BIGINT AS deaths, regexp_extract(regexp_extract(text, '{COUNTS['injury_count']}'), '[0-9]+')::BIGINT AS injuries,
        array_to_string(list_distinct(regexp_extract_all(text, '{STANDARD_CODE}')), ';') AS codes, array_to_string(regexp_extract_all(text, '{CLAUSES[0]}'), ';') AS clauses,
        array_to_string(regexp_extract_all(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), ';') AS dates FROM r""",
)
def x11_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotations(F.col("text"))
    joined = lambda name: F.array_join(found[name], ";")
    return _reports(spark, sf_dir).select("o_orderkey", found["death_count"].alias("deaths"), found["injury_count"].alias("injuries"), joined("standard_codes").alias("codes"), joined("clauses").alias("clauses"), joined("dates").alias("dates"))


def mentions_in_context(text: Column, terms: list[str], before: str = "", after: str = "") -> Column:
    """Mentions of the terms, the longest first, that no letter or digit continues and that no sign of ``before`` precedes or of ``after`` follows."""
    alternatives = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    left = "(?<![A-Za-z0-9" + re.escape(before) + "])"
    return F.regexp_extract_all(text, F.lit(f"{left}(?:{alternatives})(?![A-Za-z0-9{re.escape(after)}])"), F.lit(0))


@query(
    "x07_mentions_in_context",
    """SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9(])the([^A-Za-z0-9,]|$)') AS the, regexp_matches(text, '(^|[^A-Za-z0-9(])with([^A-Za-z0-9,]|$)') AS with_ FROM documents""",
)
def x07_mentions_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentions_in_context(F.col("text"), ["the", "with"], before="(", after=",")
    rows = table(spark, sf_dir, "documents").select("doc_id", found.alias("m"))
    return rows.select("doc_id", F.array_contains("m", "the").alias("the"), F.array_contains("m", "with").alias("with_"))


def places(text: Column, needle: str) -> Column:
    """Places (from 0) of the occurrences of a needle that do not overlap."""
    pieces = F.transform(F.split(text, re.escape(needle)), F.length)
    ends = F.aggregate(pieces, F.array(F.lit(0)), lambda out, n: F.array_append(out, F.element_at(out, -1) + n + len(needle)))
    return F.transform(F.slice(ends, F.lit(2), F.size(pieces) - 1), lambda end: end - len(needle))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pair_excerpt(text: Column, source: str, target: str, gap: int = 500, around: int = 120) -> Column:
    """The text around the nearest pair of a source's and a target's place, empty if they are further apart than ``gap`` or one is missing.

    Nothing lies between the two of a nearest pair, so only neighbours in the order of all places are looked at.
    """
    if not source or not target:
        return F.lit("")
    marked = lambda needle, kind: F.transform(places(text, needle), lambda p: F.struct(p.alias("at"), F.lit(kind).alias("kind")))
    order = F.array_sort(marked(source, 0) if source == target else F.concat(marked(source, 0), marked(target, 1)))
    first = lambda a, b: F.when(a["kind"] <= b["kind"], a["at"]).otherwise(b["at"])
    second = lambda a, b: F.when(a["kind"] <= b["kind"], b["at"]).otherwise(a["at"])
    pair = lambda a, b: F.struct((b["at"] - a["at"]).alias("gap"), first(a, b).alias("first"), second(a, b).alias("second"))
    beside = lambda m: F.zip_with(F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0))), F.slice(m, 2, 1 << 30), lambda a, b: F.when(F.lit(source == target) | (a["kind"] != b["kind"]), pair(a, b)))
    left = lambda near: F.greatest(F.lit(0), F.least(near["first"], near["second"]) - around)
    right = lambda near: F.least(F.length(text), F.greatest(near["first"] + len(source), near["second"] + len(target)) + around)
    excerpt = lambda near: F.when(near["gap"] <= gap, F.substring(text, left(near) + 1, right(near) - left(near))).otherwise("")
    return _let(_let(order, lambda m: F.array_min(beside(m))), excerpt)


@query("x19_pair_excerpt")
def x19_pair_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pair_excerpt(F.col("text"), "with", "from").alias("excerpt")
    return table(spark, sf_dir, "documents").select("doc_id", found).where("excerpt <> ''")


def split_headed(text: Column, kind: str) -> Column:
    """Pieces of a standard, cut before numbers, or of a regulation, cut before articles; short pieces are dropped."""
    pattern, least = {"standard": (r"(?=\n?\d+(?:\.\d+)*\s)", 50), "regulation": (r"(?=\n?第[一二三四五六七八九十百]+条)", 30)}[kind]
    return F.filter(F.transform(F.split(text, pattern), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) > least)


def split_long(text: Column | str) -> Column:
    """Pieces of 1200 signs at most, each up to its last full stop where it has one, else of 1201; blank ends and null texts give none."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)(?=.{1201})(?:.{0,1199}。|.{1201})|.+"), F.lit(0))
    # Only the last piece has 1200 signs or fewer to its right, and only it may be dropped for being blank.
    kept = lambda m: F.when(F.element_at(m, -1).rlike(r"(?U)^[\s\x1c-\x1f]*\z") & (F.length(F.element_at(m, -1)) <= 1200), F.slice(m, F.lit(1), F.size(m) - 1)).otherwise(m)
    return F.coalesce(_let(found, lambda m: F.when(F.size(m) > 0, kept(m)).otherwise(m)), F.array().cast("array<string>"))


@query("x16_first_chunks")
def x16_first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the chunks of every document, cut as a standard and then to size."""
    text = F.replace(F.col("text"), F.lit(". "), F.lit("。"))
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_headed(text, "standard")).alias("piece", "t"))
    return pieces.select("doc_id", "piece", F.posexplode(split_long("t")).alias("part", "chunk")).select("doc_id", "piece", "part", F.length("chunk").alias("n"))
