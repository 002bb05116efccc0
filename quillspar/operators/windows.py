"""Per-key ordered operators: latest versions, caps, schedules and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.registry import query
from quillspar.sources.tables import table


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of every key with the number of its events.

    An aggregate keeps one row a key before the shuffle; a sort of all events is not needed.
    """
    at = F.struct(*order)
    rest = F.struct(*[c for c in log.columns if c != key])
    return log.groupBy(key).agg(F.max_by(rest, at).alias("_last"), F.count("*").alias("revision_count")).select(key, "_last.*", "revision_count")


def current_relations(reviews: DataFrame) -> DataFrame:
    """Latest review of each assertion; a modified one speaks with its corrected label, else with the original.

    Columns: assertion_id, seq, decision, original, corrected. All events count as revisions.
    """
    last = latest(reviews, "assertion_id", "seq")
    label = F.when(F.col("decision") == "modified", F.coalesce("corrected", "original")).otherwise(F.col("original"))
    return last.select("assertion_id", F.col("decision").alias("status"), label.alias("label"), "revision_count")


def approved(current: DataFrame) -> DataFrame:
    return current.where(F.col("status").isin("approved", "modified"))


def alias_map(log: DataFrame) -> DataFrame:
    """Replays merges and revocations: the alias stands if its last event is a merge."""
    return latest(log, "alias_id", "seq").where("action = 'merge'").select("alias_id", "canonical_id")


def cap_per_key(hits: DataFrame, partition: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of every key in the given order."""
    return hits.withColumn("_rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_rank") <= cap).drop("_rank")


def first_wins(frame: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the first in order."""
    rest = F.struct(*[c for c in frame.columns if c != key])
    return frame.groupBy(key).agg(F.min_by(rest, F.struct(*order)).alias("_first")).select(key, "_first.*")


_EVENTS = "SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS revision_count FROM events"


@query("w01_latest", f"SELECT user_id, event_id, event_type, revision_count FROM ({_EVENTS}) WHERE r = 1")
def w01_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").drop("ts")


@query(
    "w02_approved",
    f"""SELECT user_id::VARCHAR AS assertion_id, CASE WHEN event_type = 'purchase' THEN 'approved' ELSE 'modified' END AS status,
        CASE WHEN event_type = 'purchase' THEN 'o' || event_id ELSE coalesce(CASE WHEN event_id % 2 = 0 THEN 'c' || event_id END, 'o' || event_id) END AS label, revision_count
        FROM ({_EVENTS}) WHERE r = 1 AND event_type IN ('purchase', 'click')""",
)
def w02_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "click", "modified").otherwise("rejected")
    reviews = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("assertion_id"), F.struct("ts", "event_id").alias("seq"), decision.alias("decision"),
        F.concat(F.lit("o"), "event_id").alias("original"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("c"), "event_id")).alias("corrected"),
    )
    return approved(current_relations(reviews))


@query("w03_diversity", "SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 2")
def w03_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "value")
    return cap_per_key(hits, ["event_type", "user_id"], [F.desc("value"), F.col("event_id")], 2).drop("value")


@query(
    "w04_route_ranks",
    """WITH r AS (SELECT event_type AS route, user_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events)
       SELECT route, user_id, min(rank) AS rank FROM r WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL""",
)
def w04_route_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")).cast("long")
    ranked = table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), "user_id", "ts", rank.alias("rank"))
    return ranked.where("ts >= TIMESTAMP_NTZ '2024-01-10'").groupBy("route", "user_id").agg(F.min("rank").alias("rank"))


@query(
    "w05_round_robin",
    "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round, sha1(conv_id::VARCHAR) AS place FROM conversations",
)
def w05_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule's sort keys: rounds first, inside a round the conversations by a digest of their id."""
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", number.alias("round"), F.sha1(F.col("conv_id").cast("string")).alias("place"))


@query(
    "w06_citation_numbers",
    """WITH f AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) SELECT conv_id, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY first, role) AS number FROM f""",
)
def w06_citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return first.select("conv_id", "role", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("first", "role")).cast("long").alias("number"))


@query(
    "w08_alias_replay",
    """WITH l AS (SELECT o_custkey AS alias_id, o_orderkey AS seq, o_orderkey % 50 AS canonical_id, CASE WHEN o_orderstatus = 'P' THEN 'revoke' ELSE 'merge' END AS action FROM orders)
       SELECT alias_id, canonical_id FROM (SELECT *, row_number() OVER (PARTITION BY alias_id ORDER BY seq DESC) AS r FROM l) WHERE r = 1 AND action = 'merge'""",
)
def w08_alias_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("o_orderstatus") == "P", "revoke").otherwise("merge").alias("action")
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("alias_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 50).alias("canonical_id"), action)
    return alias_map(log)


@query(
    "w09_section_reviews",
    f"SELECT count(*) FILTER (event_type = 'purchase') AS approved, count(*) FILTER (event_type = 'error') AS rejected, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS pending FROM ({_EVENTS}) WHERE r = 1",
)
def w09_section_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id")
    is_ = lambda *names: F.count_if(F.col("event_type").isin(*names))
    return last.agg(is_("purchase").alias("approved"), is_("error").alias("rejected"), (F.count("*") - is_("purchase", "error")).alias("pending"))


@query("w10_first_wins", "SELECT digest, min(doc_id) AS doc_id FROM (SELECT sha256(text) AS digest, doc_id FROM documents) GROUP BY 1")
def w10_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_wins(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id"), "digest", "doc_id")


@query(
    "w12_neighbour_duplicates",
    """WITH l AS (SELECT doc_id, p, line, lag(line) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))
       SELECT doc_id, count(*) AS dropped FROM l WHERE line = before AND line <> '' GROUP BY 1""",
)
def w12_neighbour_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines equal to the line before, found inside each row's array, without a shuffle."""
    lines = F.split("text", "\n", -1)
    same = F.filter(F.sequence(F.lit(1), F.size("lines") - 1), lambda i: (F.get("lines", i) == F.get("lines", i - 1)) & (F.get("lines", i) != ""))
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).where("size(lines) > 1")
    return rows.select("doc_id", F.size(same).cast("long").alias("dropped")).where("dropped > 0")
