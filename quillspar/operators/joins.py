"""Joins: lookups with fallback, semi, anti, interval overlap, phased linkage, and set operations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.operators.windows import cap_per_key
from quillspar.registry import query
from quillspar.sources.shared import Steps, dealt
from quillspar.sources.tables import table


def active_at(start: Column, end: Column, at: Column) -> Column:
    """Half-open validity; null bounds are open, inverted intervals are never active."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (at < end)) & ~F.coalesce(end <= start, F.lit(False))


def overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two half-open intervals share an instant."""
    ordered = lambda a, b: a.isNull() | b.isNull() | (a < b)
    return ordered(start, other_end) & ordered(other_start, end) & ordered(start, end) & ordered(other_start, other_end)


def interval_pairs(rows: DataFrame, keys: list[str], order: str, start: str, end: str) -> DataFrame:
    """Unordered pairs of rows with equal ``keys`` whose half-open intervals share an instant, as structs ``first`` and ``second`` by ``order``.

    Time is cut into cells, on as many levels as there are magnitudes of length: an interval lies in at most two cells
    of the level whose cells are at least as long as it is. A pair is looked for on the level of the longer one, so a
    row is sent to two cells a level, however long the others are, and it is given in the cell where the later one
    begins and nowhere else. The rows of a frequent key are therefore dealt by time as well. Rows with a null key are
    in no pair; null bounds are open; empty and inverted intervals share nothing. ``order`` is unique; bounds are dates
    or timestamps.
    """
    row = F.struct(*rows.columns)
    ends = F.col(end).isNull() | F.col(start).isNull() | (F.col(start) < F.col(end))
    timed = rows.where(ends).select(
        *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], row.alias("_row"), F.unix_micros(F.col(start).cast("timestamp")).alias("_s"), F.unix_micros(F.col(end).cast("timestamp")).alias("_e")
    )
    bounds = timed.agg(F.least(F.min("_s"), F.min("_e")).alias("low"), F.greatest(F.max("_s"), F.max("_e")).alias("high")).first()
    low, high = bounds.low or 0, bounds.high or 0
    # An open bound lies beyond all others.
    timed = timed.withColumns({"_s": F.coalesce("_s", F.lit(low - 1)), "_e": F.coalesce("_e", F.lit(high + 2))})
    timed = timed.withColumn("_level", F.ceil(F.log2((F.col("_e") - F.col("_s")).cast("double"))).cast("int"))
    levels = sorted(r[0] for r in timed.select("_level").distinct().collect())  # at most one a bit of a number
    cells = lambda level: F.sequence(F.expr(f"shiftright(_s, {level})"), F.expr(f"shiftright(_e - 1, {level})"))
    names = [f"_k{n}" for n in range(len(keys))]
    long = timed.select(*names, F.col("_row").alias("_b"), F.col("_s").alias("_bs"), F.col("_level").alias("_at"), F.explode(cells("_level")).alias("_cell"))
    upwards = F.filter(F.array(*map(F.lit, levels)), lambda level: level >= F.col("_level")) if levels else F.array().cast("array<int>")
    short = timed.select("*", F.explode(upwards).alias("_at")).select(*names, F.col("_row").alias("_a"), F.col("_s").alias("_as"), "_level", "_at", F.explode(cells("_at")).alias("_cell"))
    met = short.join(long, [*names, "_at", "_cell"])
    once = (F.col("_level") < F.col("_at")) | (F.col(f"_a.{order}") < F.col(f"_b.{order}"))
    owner = F.expr("shiftright(greatest(_as, _bs), _at)") == F.col("_cell")
    both = overlap(F.col(f"_a.{start}"), F.col(f"_a.{end}"), F.col(f"_b.{start}"), F.col(f"_b.{end}"))
    before = F.col(f"_a.{order}") < F.col(f"_b.{order}")
    pairs = met.where(once & owner & both & (F.col(f"_a.{order}") != F.col(f"_b.{order}")))
    return pairs.select(F.when(before, F.col("_a")).otherwise(F.col("_b")).alias("first"), F.when(before, F.col("_b")).otherwise(F.col("_a")).alias("second"))


def conflicts(facts: DataFrame) -> DataFrame:
    """Unordered pairs of facts of one (subject, predicate) that state different objects, in different documents, for overlapping times.

    A pair is emitted once, the earlier row first. Facts: seq, subject, predicate, object, doc, valid_from, valid_to.
    """
    usable = facts.where("subject <> '' AND predicate <> '' AND object <> ''").select("seq", "subject", "predicate", "object", "doc", "valid_from", "valid_to")
    pairs = interval_pairs(usable, ["subject", "predicate"], "seq", "valid_from", "valid_to")
    differ = (F.col("first.object") != F.col("second.object")) & ~F.col("first.doc").eqNullSafe(F.col("second.doc"))
    return pairs.where(differ).select("first.subject", "first.predicate", F.col("first.seq").alias("first"), F.col("second.seq").alias("second"), F.lit("needs_review").alias("status"))


def phased_link(left: DataFrame, right: DataFrame, phases: list[tuple[str, Column, Column, float]]) -> DataFrame:
    """Links rows by one normalised key after another; a row that is linked takes no part in later phases.

    Columns: ``left`` has id, ``right`` has rid. Within a phase and key the n-th row of one side takes the n-th of the other.
    """
    linked = None
    for method, left_key, right_key, confidence in phases:
        if linked is not None:
            left = left.join(linked.select("id"), "id", "left_anti")
            right = right.join(linked.select("rid"), "rid", "left_anti")
        number = lambda order: F.row_number().over(Window.partitionBy("k").orderBy(order))
        a = left.withColumn("k", left_key).where("k <> ''").withColumn("n", number("id")).select("k", "n", "id")
        b = right.withColumn("k", right_key).where("k <> ''").withColumn("n", number("rid")).select("k", "n", "rid")
        found = a.join(b, ["k", "n"]).select("id", "rid", F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))
        linked = found if linked is None else linked.unionByName(found)
    return linked


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New, changed, removed and unchanged keys of two versions of a table, by a digest of the other columns."""
    rest = sorted(c for c in old.columns if c != key)
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in rest]), 256)
    before, after = old.select(key, digest.alias("before")), new.select(key, digest.alias("after"))
    state = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("unchanged")
    return before.join(after, key, "full").select(key, state.alias("state"))


@query("j01_lookup", "SELECT l_orderkey, l_linenumber, count(*) AS n, any_value(o_orderpriority) AS priority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def j01_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return items.join(orders, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "n", F.col("o_orderpriority").alias("priority"))


@query("j02_evidence_counts", "SELECT c_custkey, count(o_orderkey) AS evidence FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def j02_evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("evidence"))


@query(
    "j03_fallback",
    """SELECT e.event_id, coalesce(c.c_name, s.s_name, 'none') AS name, CASE WHEN c.c_name IS NOT NULL THEN 1 WHEN s.s_name IS NOT NULL THEN 2 ELSE 3 END AS level
       FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey AND c.c_acctbal > 5000 LEFT JOIN supplier s ON e.user_id = s.s_suppkey""",
)
def j03_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"), "c_name")
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), "s_name")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id").join(first, "user_id", "left").join(second, "user_id", "left")
    level = F.when(F.col("c_name").isNotNull(), 1).when(F.col("s_name").isNotNull(), 2).otherwise(3)
    return rows.select("event_id", F.coalesce("c_name", "s_name", F.lit("none")).alias("name"), level.alias("level"))


@query("j04_three_way", "SELECT r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def j04_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("customers"))


@query(
    "j05_conditional_on",
    """SELECT o_orderkey, coalesce(sum(l_quantity) FILTER (l_returnflag <> 'N'), 0) AS returned FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag <> 'N' GROUP BY 1""",
)
def j05_conditional_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(returned, "o_orderkey", "left").select("o_orderkey", F.coalesce("q", F.lit(0.0)).alias("returned"))


@query("j06_anti", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j06_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query(
    "j07_pending_once",
    """SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY user_id""",
)
def j07_pending_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    done = events.where("event_type = 'purchase'").select("user_id")
    waiting = events.where("event_type = 'signup'").join(done, "user_id", "left_anti")
    return waiting.groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("j08_semi", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def j08_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(seen, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@query(
    "j09_conflicts",
    """WITH f AS (SELECT o_orderkey AS seq, o_custkey::VARCHAR AS subject, o_orderstatus AS predicate, o_orderpriority AS object, o_orderkey % 7 AS doc, o_orderdate AS f, o_orderdate + INTERVAL 60 DAY AS t FROM orders)
       SELECT a.subject, a.predicate, a.seq AS first, b.seq AS second, 'needs_review' AS status FROM f a JOIN f b ON a.subject = b.subject AND a.predicate = b.predicate AND a.seq < b.seq
       AND a.object <> b.object AND a.doc IS DISTINCT FROM b.doc AND a.f < b.t AND b.f < a.t""",
)
def j09_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("subject"), F.col("o_orderstatus").alias("predicate"), F.col("o_orderpriority").alias("object"),
        (F.col("o_orderkey") % 7).alias("doc"), F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("INTERVAL '60' DAY")).alias("valid_to"),
    )
    return conflicts(facts)


@query(
    "j11_phased_link",
    """WITH l AS (SELECT c_custkey AS id, c_nationkey, c_mktsegment FROM customer), r AS (SELECT s_suppkey AS rid, s_nationkey, s_acctbal FROM supplier),
       a1 AS (SELECT l.id, r.rid FROM (SELECT *, row_number() OVER (PARTITION BY id % 1000 ORDER BY id) AS n FROM l) l JOIN (SELECT *, row_number() OVER (PARTITION BY rid % 1000 ORDER BY rid) AS n FROM r WHERE s_acctbal > 0) r ON id % 1000 = rid % 1000 AND l.n = r.n),
       l2 AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY id) AS n FROM l WHERE id NOT IN (SELECT id FROM a1)),
       r2 AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY rid) AS n FROM r WHERE rid NOT IN (SELECT rid FROM a1))
       SELECT id, rid, 'code' AS method, 1.0::DOUBLE AS confidence FROM a1 UNION ALL SELECT id, rid, 'nation', 0.85 FROM l2 JOIN r2 ON c_nationkey = s_nationkey AND l2.n = r2.n""",
)
def j11_phased_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    right = table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "rid")
    code = F.when(F.col("s_acctbal") > 0, (F.col("rid") % 1000).cast("string"))
    return phased_link(left, right, [("code", (F.col("id") % 1000).cast("string"), code, 1.0), ("nation", F.col("c_nationkey").cast("string"), F.col("s_nationkey").cast("string"), 0.85)])


def sharing_most(cited: DataFrame, k: int, part: int = 500) -> DataFrame:
    """(page, other, shared): the ``k`` pages that share most documents with a page, ties to the smaller; ``cited`` has page and doc.

    A page is sent to where it is counted with lists of the others of each document, about ``part`` in one; a task makes about two
    million pairs, so neither a large document nor many pages make a large task.
    """
    steps = Steps(cited.sparkSession, "sharing")
    cited = steps.keep(cited.select("page", "doc").where("page IS NOT NULL AND doc IS NOT NULL").distinct())
    size = steps.keep(cited.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1"))
    made = size.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    dealt_out = cited.join(size, "doc").withColumn("part", F.pmod(F.xxhash64("page"), F.ceil(F.col("n") / part)))
    lists = dealt_out.groupBy("doc", "part").agg(F.collect_list("page").alias("others")).select("doc", "others")
    pairs = dealt(cited.join(lists, "doc").select("page", "others"), made, "page", each=2_000_000).select("page", F.explode("others").alias("other"))
    counted = pairs.where("page <> other").groupBy("page", "other").agg(F.count("*").alias("shared"))
    return cap_per_key(counted, ["page"], [F.desc("shared"), F.col("other")], k)


@query(
    "j15_shared_documents",
    """WITH e AS (SELECT DISTINCT l_suppkey AS page, l_partkey AS doc FROM lineitem WHERE l_returnflag = 'R'),
       p AS (SELECT a.page, b.page AS other, count(*) AS shared FROM e a JOIN e b ON a.doc = b.doc AND a.page <> b.page GROUP BY ALL)
       SELECT page, other, shared FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY shared DESC, other) AS r FROM p) WHERE r <= 6""",
)
def j15_shared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("doc"))
    return sharing_most(e, 6)


@query(
    "j18_publish_gate",
    """WITH m AS (SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NULL THEN 'unaudited' WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 0 THEN 'weak' ELSE 'ok' END AS reason,
       row_number() OVER (PARTITION BY sha256(d.text) ORDER BY d.doc_id) AS copy FROM documents d LEFT JOIN labels l USING (doc_id))
       SELECT CASE WHEN reason = 'ok' AND copy > 1 THEN 'duplicate' ELSE reason END AS reason, count(*) AS n FROM m GROUP BY 1""",
)
def j18_publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    copy = F.row_number().over(Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id"))
    reason = F.when(F.col("toxic").isNull(), "unaudited").when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 0, "weak")
    reason = reason.when(F.col("copy") > 1, "duplicate").otherwise("ok")
    return rows.select("toxic", "quality", copy.alias("copy")).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("f12_as_of", "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-01-01' < o_orderdate + INTERVAL 90 DAY")
def f12_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("1997-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").where(active_at(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL '90' DAY"), at)).select("o_orderkey")


@query(
    "f16_evidence_contained",
    """SELECT item_id, count(*) AS documents FROM benchmark b JOIN documents d ON contains(regexp_replace(d.text, '\\s+', '', 'g'), regexp_replace(b.text, '\\s+', '', 'g')) WHERE trim(b.text) <> '' GROUP BY 1""",
)
def f16_evidence_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quoted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quoted(documents: DataFrame, quotes: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """How many documents hold each quote, white space aside.

    Quotes are broadcast in slices whose size is checked: the documents are scanned once for every ``limit`` bytes of
    quotes. One automaton finds all quotes of a slice in one walk over a text, whatever their number.
    """
    plain = lambda c: F.regexp_replace(c, r"\s+", "")
    quotes = quotes.where("trim(text) <> ''").select("item_id", plain("text").alias("quote")).where("quote <> ''")
    bodies = documents.select(plain("text").alias("body")).where("body <> ''")
    kind = dict(quotes.dtypes)["item_id"]
    slices = max(1, -(-(quotes.agg(F.sum(F.octet_length("quote"))).first()[0] or 0) // limit))
    found = None
    for k in range(slices):
        part = quotes.where(F.pmod(F.xxhash64("item_id", "quote"), F.lit(slices)) == k).toArrow()
        shared = documents.sparkSession.sparkContext.broadcast(list(zip(part.column("quote").to_pylist(), part.column("item_id").to_pylist())))
        rows = bodies.mapInArrow(_holding(shared, part.schema.field("item_id").type), f"item_id {kind}").groupBy("item_id").agg(F.count("*").alias("documents"))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("item_id").agg(F.sum("documents").alias("documents"))


def _holding(shared, kind: pa.DataType):
    """One row for every quote of every text that holds it; rows of equal quotes each have theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners: dict[str, list] = {}
        for quote, item in shared.value:
            owners.setdefault(quote, []).append(item)
        automaton = ahocorasick.Automaton()
        for quote in owners:
            automaton.add_word(quote, quote)
        if not owners:
            return
        automaton.make_automaton()
        for batch in batches:
            for body in batch.column("body"):
                items = [item for quote in {quote for _, quote in automaton.iter(body.as_py())} for item in owners[quote]]
                if items:
                    yield pa.RecordBatch.from_arrays([pa.array(items, kind)], names=["item_id"])

    return run


@query("u01_union", "SELECT 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier")
def u01_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda name, key: table(spark, sf_dir, name).select(F.lit(name).alias("kind"), F.col(key).alias("nation"))
    return reduce(DataFrame.unionByName, [named("customer", "c_nationkey"), named("supplier", "s_nationkey")])


@query("u02_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def u02_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(ordered, "p_partkey", "left_anti").distinct()


@query("u03_intersection", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u03_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("u04_manifest_equal", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) = 0 AS complete")
def u04_manifest_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id"))
    return missing.agg((F.count("*") == 0).alias("complete"))


@query(
    "u05_changes",
    """WITH o AS (SELECT c_custkey, c_mktsegment AS s FROM customer WHERE c_acctbal > -500), n AS (SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 'X' ELSE c_mktsegment END AS s FROM customer WHERE c_acctbal < 9000)
       SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.s IS NULL THEN 'new' WHEN n.s IS NULL THEN 'removed' WHEN o.s <> n.s THEN 'changed' ELSE 'unchanged' END AS state FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""",
)
def u05_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    new = rows.withColumn("c_mktsegment", F.when(F.col("c_nationkey") == 7, "X").otherwise(F.col("c_mktsegment"))).where("c_acctbal < 9000")
    shape = ("c_custkey", "c_mktsegment")
    return changes(rows.where("c_acctbal > -500").select(*shape), new.select(*shape), "c_custkey")
