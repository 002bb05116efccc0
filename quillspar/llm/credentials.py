"""Secret scan with multipart credential linking, in Spark expressions and joins only.

Every pattern splits the whole text once: the pieces between its matches and
the matches give lengths, and their running sums the places in code points.
Base kinds (assign, access, hex) are always reported. Weak kinds (id, a name or
account; mixed, a long string of letters and digits; endpoint, an address) mean little alone and
are reported only if a complementary part lies within SCOPE code points of
them in the same document: an id needs a secret, a mixed string an id or an endpoint, an
endpoint a secret. Mixed strings inside a base span are dropped.

The interval join deals parts into cells of SCOPE code points, so that it is an
equality join on document and cell; a cell holds a few parts at most, however
many a document has, and no pair of far parts is made.

Defined results: null and empty texts have no spans and the digest of an empty
list; rows that repeat doc_id and text are scanned once and returned once each;
null doc_ids are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.llm.common import Scratch, table

SCOPE = 200

#: Kinds in their order, with pattern, value group, least length of the value, and role.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret"),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20, "id"),
    ("hex", r"([0-9a-f]{24,})", 1, 24, "secret"),
    ("id", r"""\b(?i:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 1, 3, "id"),
    ("mixed", r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{32,}={0,2})", 1, 32, "secret"),
    ("endpoint", r"""\b((?i:https?|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+)""", 1, 8, "endpoint"),
)
BASE = 3


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (gap, size, whole): code points before a match since the last, of the match, and whether its value is long enough."""
    expression = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, expression, F.lit(0)), F.length)
    values = F.transform(F.regexp_extract_all(text, expression, F.lit(group)), lambda v: F.length(v) >= least)
    zipped = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), values.alias("whole"))
    return F.when(text.rlike(pattern), zipped)


def mixed(text: Column, pattern: str) -> Column:
    """As ``matches`` for mixed strings: the value must hold a digit and letters of either case."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(found, F.length).alias("size"),
        F.transform(found, lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")).alias("whole"),
    )
    return F.when(text.rlike(pattern), zipped)


def parts_of(documents: DataFrame) -> DataFrame:
    """doc_id, key and, per kind, the matches of every row."""
    text = F.coalesce("text", F.lit(""))
    found = [
        (mixed(text, pattern) if kind == "mixed" else matches(text, pattern, group, least)).alias(kind)
        for kind, pattern, group, least, _ in KINDS
    ]
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), *found)


def places(parts: DataFrame) -> DataFrame:
    """doc_id, key, kind (its number), start and end of all whole matches."""
    any_found = F.coalesce(*[F.col(kind) for kind, *_ in KINDS]).isNotNull()
    out = None
    rows = parts.where(any_found).dropDuplicates(["doc_id", "key"])
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(kind[0]).alias("found")) for n, kind in enumerate(KINDS)])
    rows = rows.select("doc_id", "key", F.explode(F.filter(kinds, lambda k: k["found"].isNotNull())).alias("k"))
    rows = rows.select("doc_id", "key", "k.kind", F.posexplode("k.found").alias("pos", "m"))
    # The last piece of a split has no match behind it.
    before = Window.partitionBy("doc_id", "key", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.coalesce("m.size", F.lit(0))).over(before)
    out = rows.select("doc_id", "key", "kind", end.alias("end"), F.col("m.size").alias("size"), F.col("m.whole").alias("whole"))
    return out.where("whole").select("doc_id", "key", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def linked(spans: DataFrame) -> DataFrame:
    """The weak spans that complementary parts of the same document lie next to."""
    role = F.element_at(F.array(*[F.lit(kind[-1]) for kind in KINDS]), F.col("kind") + 1)
    cell = lambda first, last: F.explode(F.sequence(F.floor(first / SCOPE), F.floor(last / SCOPE)))
    spans = spans.withColumn("role", role)
    weak = spans.where(F.col("kind") >= BASE).withColumn("cell", cell(F.col("start") - SCOPE, F.col("end") + SCOPE))
    near = spans.select(
        F.col("doc_id").alias("d"), F.col("key").alias("h"), F.col("kind").alias("near_kind"), F.col("role").alias("near_role"),
        F.col("start").alias("near_start"), F.col("end").alias("near_end"), cell(F.col("start"), F.col("end")).alias("near_cell"),
    )
    close = (F.col("near_start") <= F.col("end") + SCOPE) & (F.col("start") <= F.col("near_end") + SCOPE)
    pairs = weak.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("h")) & (F.col("cell") == F.col("near_cell")) & close)
    over = (F.col("near_start") < F.col("end")) & (F.col("start") < F.col("near_end"))
    fits = ~over & (
        ((F.col("role") == "id") & (F.col("near_role") == "secret"))
        | ((F.col("role") == "secret") & (F.col("near_role") != "secret"))
        | ((F.col("role") == "endpoint") & (F.col("near_role") == "secret"))
    )
    return (
        pairs.groupBy("doc_id", "key", "kind", "start", "end")
        .agg(F.max(fits).alias("fits"), F.max(over & (F.col("near_kind") < BASE)).alias("inside"))
        .where("fits AND NOT inside")
        .drop("fits", "inside")
    )


def scan(scratch: Scratch, documents: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and spans of every row."""
    parts = scratch.keep(parts_of(documents), "parts")
    spans = scratch.keep(places(parts), "places")
    every = spans.where(F.col("kind") < BASE).unionByName(linked(spans))
    name = F.array(*[F.lit(kind[0]) for kind in KINDS])
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    count = lambda n: F.count_if(F.col("kind") == n)
    by_row = every.groupBy("doc_id", "key").agg(listed.alias("all"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"))
    by_row = by_row.select(
        F.col("doc_id").alias("d"), F.col("key").alias("h"), "n_assign", "n_access", "n_hex",
        written(F.filter("all", lambda s: s["kind"] < BASE)).alias("base"), written(F.col("all")).alias("spans"),
    )
    rows = parts.select("doc_id", "key").join(by_row, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("h")), "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id", *[F.coalesce(F.col(c), zero).alias(c) for c in ("n_assign", "n_access", "n_hex")],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def op5_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(Scratch(spark, "op5"), table(spark, sf_dir, "documents"))
