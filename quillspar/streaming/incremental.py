"""Incremental maintenance: change-data merges, snapshots, resumable queues and event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.registry import query
from quillspar.sources.tables import table
from quillspar.streaming.journal import Files


def apply_export(current: DataFrame, export: DataFrame, key: str, removed: DataFrame | None = None) -> DataFrame:
    """The mirror after an export: every exported row is upserted, a sent one revived, keys in ``removed`` marked.

    ``current`` has the export's columns and ``removed`` (0 or 1).
    """
    kept = current.join(export.select(key), key, "left_anti")
    if removed is not None:
        gone = removed.select(key, F.lit(1).alias("_gone")).distinct()
        kept = kept.join(gone, key, "left").withColumn("removed", F.greatest("removed", F.coalesce("_gone", F.lit(0)))).drop("_gone")
    return kept.unionByName(export.withColumn("removed", F.lit(0)))


def upsert(index: DataFrame, rows: DataFrame, key: str, body: str) -> DataFrame:
    """An index with rows added or replaced in place; ValueError if a batch states one key in two ways."""
    once = rows.groupBy(key).agg(F.count_distinct(body).alias("n"), F.first(body).alias(body))
    if not once.where("n > 1").isEmpty():
        raise ValueError("rows of one key differ")
    return index.join(once.select(key, F.col(body).alias("_new")), key, "full").select(key, F.coalesce("_new", body).alias(body))


def snapshot_signature(frame: DataFrame, *columns: str) -> Column | DataFrame:
    """One row (rows, signature) that changes with any value, in whatever order rows come."""
    return frame.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("signature"))


def resume(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The items still to do."""
    return work.join(done.select(key), key, "left_anti")


def leases(log: DataFrame, now: Column) -> DataFrame:
    """The job states after replaying a log of (job, seq, action, until): done jobs stay done, expired leases return to the queue."""
    last = log.groupBy("job").agg(F.max_by(F.struct("action", "until"), "seq").alias("l"))
    state = F.when(F.col("l.action") == "done", "done").when((F.col("l.action") == "lease") & (F.col("l.until") > now), "leased").otherwise("queued")
    return last.select("job", state.alias("state"))


def _changed(jobs: DataFrame, job: str, allowed: Column, **values: Column) -> DataFrame:
    """The jobs with one of them changed where ``allowed``; ValueError if it is not there or not allowed."""
    row = F.col("job") == job
    if jobs.where(row & F.coalesce(allowed, F.lit(False))).isEmpty():
        raise ValueError(f"job {job} does not allow this")
    return jobs.select(*[F.when(row, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in jobs.columns])


def create_job(jobs: DataFrame, job: str, key: str, now: float) -> DataFrame:
    """Jobs (job, key, state, owner, until, cancel, created) with one more, unless one of the same key is there."""
    one = jobs.sparkSession.createDataFrame([(job, key, "queued", None, 0.0, False, float(now))], jobs.schema)
    return jobs.unionByName(one.join(jobs.select("key"), "key", "left_anti").select(jobs.columns))


def claim(jobs: DataFrame, owner: str, now: float, seconds: float = 600) -> DataFrame:
    """The oldest job that is queued, or whose lease has expired, is leased to the owner; expired jobs to be cancelled are cancelled."""
    expired = F.col("until") < now
    over = F.col("cancel") & expired & ~F.col("state").isin("ready_for_review", "failed", "cancelled")
    jobs = jobs.withColumn("state", F.when(over, "cancelled").otherwise(F.col("state")))
    free = ~F.col("cancel") & ((F.col("state") == "queued") | (F.col("state").isin("analyzing", "generating", "validating") & expired))
    chosen = jobs.where(free).orderBy("created", "job").limit(1).select("job").collect()
    if not chosen:
        return jobs
    return _changed(jobs, chosen[0]["job"], F.lit(True), state=F.lit("analyzing"), owner=F.lit(owner), until=F.lit(float(now + seconds)))


def heartbeat(jobs: DataFrame, job: str, owner: str, now: float, state: str = "generating", seconds: float = 600) -> DataFrame:
    """A lease that is still held is made longer; ValueError if it is another's, has expired, or the job is to be cancelled."""
    held = (F.col("owner") == owner) & (F.col("until") >= now) & ~F.col("cancel")
    return _changed(jobs, job, held, state=F.lit(state), until=F.lit(float(now + seconds)))


def finish(jobs: DataFrame, job: str, owner: str, state: str) -> DataFrame:
    """The owner's job ends in ``state``, or cancelled if that was asked for."""
    return _changed(jobs, job, F.col("owner") == owner, state=F.when(F.col("cancel"), "cancelled").otherwise(state), until=F.lit(0.0))


def cancel(jobs: DataFrame, job: str) -> DataFrame:
    """Asks for an end: queued jobs are cancelled at once, running ones when they end or expire."""
    open_ = ~F.col("state").isin("ready_for_review", "failed", "cancelled")
    return _changed(jobs, job, open_, cancel=F.lit(True), state=F.when(F.col("state") == "queued", "cancelled").otherwise(F.col("state")))


def retry(jobs: DataFrame, job: str) -> DataFrame:
    """A failed or cancelled job is queued again."""
    return _changed(jobs, job, F.col("state").isin("failed", "cancelled"), state=F.lit("queued"), owner=F.lit(None).cast("string"), until=F.lit(0.0), cancel=F.lit(False))


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums per window and type; as a stream, rows later than ``late`` are dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_seen(events: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once within the watermark; the state is bounded by ``late``."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def merge_stream(stream: DataFrame, path: str, key: str, checkpoint: str, sequence: str | None = None, keep: int = 2):
    """Merges micro-batches into a table by ``key``: each batch writes a new version, so a repeated batch changes nothing.

    Of a key's rows in one batch the one with the largest ``sequence`` counts; without a sequence they must be equal, or
    the stream stops. The last ``keep`` versions stay, for readers of the one before.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if sequence:
            order = Window.partitionBy(key).orderBy(F.desc(sequence), F.xxhash64(*batch.columns))
            rows = batch.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
        else:
            rows = batch.distinct()
            if not rows.groupBy(key).count().where("count > 1").isEmpty():
                raise ValueError("rows of one key differ; name a sequence")
        if number:
            merged = apply_export(spark.read.parquet(f"{path}/version={number - 1}"), rows, key)
        else:
            merged = rows.withColumn("removed", F.lit(0))
        merged.write.mode("overwrite").parquet(f"{path}/version={number}")
        if number >= keep:
            Files(spark, path).delete(f"version={number - keep}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def cached(requests: DataFrame, cache: DataFrame, now: Column, ready: str = "INTERVAL '7' DAY", failed: str = "INTERVAL '300' SECOND") -> DataFrame:
    """Requests (url) with the state of their cache entry (url, ok, fetched): hit while it is young enough, else fetch; an old good one may serve on error."""
    age = now - F.col("fetched")
    young = F.when(F.col("ok"), age < F.expr(ready)).otherwise(age < F.expr(failed))
    state = F.when(F.col("fetched").isNull(), "fetch").when(young, "hit").when(F.col("ok"), "refresh").otherwise("fetch")
    return requests.join(cache, "url", "left").select("url", state.alias("state"))


def changed_since(rows: DataFrame, done: DataFrame, key: str, body: str) -> DataFrame:
    """Rows that are new or whose content hash differs from the one recorded as done (key, hash)."""
    hashed = rows.withColumn("hash", F.sha2(body, 256))
    return hashed.join(done.select(key, "hash"), [key, "hash"], "left_anti")


def with_history(turns: DataFrame, least: int = 6) -> DataFrame:
    """Questions of fewer than ``least`` words get the conversation's last question before them in front."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("text").over(order)
    short = F.size(F.split(F.trim("text"), r"\s+")) < least
    return turns.select("conv_id", "turn", F.when(short & before.isNotNull(), F.concat(before, F.lit("\n"), F.col("text"))).otherwise(F.col("text")).alias("question"))


@query(
    "i08_changed_since",
    "SELECT doc_id FROM documents WHERE NOT (lang = 'en' AND n_chars > 1000)",
)
def i08_changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    body = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.lit("old"))
    done = docs.where("n_chars > 1000").select("doc_id", F.sha2(body, 256).alias("hash"))
    return changed_since(docs.select("doc_id", "text"), done, "doc_id", "text").select("doc_id")


@query(
    "i10_history",
    """SELECT conv_id, turn, md5(CASE WHEN len(string_split_regex(trim(text), '\\s+')) < 6 AND b IS NOT NULL THEN b || chr(10) || text ELSE text END) AS digest
       FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations WHERE role = 'user')""",
)
def i10_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return with_history(asked).select("conv_id", "turn", F.md5("question").alias("digest"))


@query("i12_retry_set", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P')")
def i12_retry_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey")


@query(
    "i13_cache_states",
    """WITH c AS (SELECT user_id AS url, arg_max(event_type, event_id) <> 'error' AS ok, max_by(ts, event_id) AS fetched FROM events GROUP BY 1)
       SELECT c_custkey AS url, CASE WHEN fetched IS NULL THEN 'fetch' WHEN ok AND TIMESTAMP '2024-01-31' - fetched < INTERVAL 7 DAY THEN 'hit' WHEN NOT ok AND TIMESTAMP '2024-01-31' - fetched < INTERVAL 300 SECOND THEN 'hit' WHEN ok THEN 'refresh' ELSE 'fetch' END AS state
       FROM customer LEFT JOIN c ON c_custkey = url""",
)
def i13_cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    cache = events.groupBy(F.col("user_id").alias("url")).agg((F.max_by("event_type", "event_id") != "error").alias("ok"), F.max_by("ts", "event_id").alias("fetched"))
    return cached(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url")), cache, F.lit("2024-01-31").cast("timestamp_ntz"))


@query(
    "i14_insert_ignore",
    "SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN 'old' ELSE 'queued' END AS state FROM customer",
)
def i14_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    old = rows.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit("old").alias("state"))
    new = rows.select(F.col("c_custkey").alias("id"), F.lit("queued").alias("state"))
    return old.unionByName(resume(new, old, "id"))


@query(
    "i01_apply_export",
    """WITH cur AS (SELECT c_custkey AS id, c_mktsegment AS body, 0 AS removed FROM customer WHERE c_acctbal > 0), new AS (SELECT c_custkey AS id, 'new' AS body FROM customer WHERE c_nationkey = 7),
       gone AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey = 11)
       SELECT id, body, CASE WHEN id IN (SELECT id FROM gone) THEN 1 ELSE removed END::INT AS removed FROM cur WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT id, body, 0 FROM new""",
)
def i01_apply_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("body"), "c_acctbal", "c_nationkey")
    current = rows.where("c_acctbal > 0").select("id", "body", F.lit(0).alias("removed"))
    sent = rows.where("c_nationkey = 7").select("id", F.lit("new").alias("body"))
    return apply_export(current, sent, "id", rows.where("c_nationkey = 11").select("id"))


@query(
    "i02_upsert",
    "SELECT coalesce(a.id, b.id) AS id, coalesce(b.body, a.body) AS body FROM (SELECT p_partkey AS id, p_brand AS body FROM part WHERE p_size > 10) a FULL JOIN (SELECT p_partkey AS id, p_type AS body FROM part WHERE p_size < 20) b ON a.id = b.id",
)
def i02_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    index = parts.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("body"))
    return upsert(index, parts.where("p_size < 20").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("body")), "id", "body")


@query("i03_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def i03_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return resume(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query(
    "i06_leases",
    """WITH l AS (SELECT user_id AS job, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'fail' ELSE 'lease' END AS action, ts + INTERVAL 10 DAY AS until FROM events),
       r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq DESC) AS r FROM l)
       SELECT job, CASE WHEN action = 'done' THEN 'done' WHEN action = 'lease' AND until > TIMESTAMP '2024-01-25' THEN 'leased' ELSE 'queued' END AS state FROM r WHERE r = 1""",
)
def i06_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fail").otherwise("lease")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("ts") + F.expr("INTERVAL '10' DAY")).alias("until"))
    return leases(log, F.lit("2024-01-25").cast("timestamp_ntz"))


@query(
    "p7_tumbling_windows",
    """SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def p7_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tumbling(table(spark, sf_dir, "events"), "6 hours", "1 day")
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "p7_session_windows",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events),
       s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
       SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""",
)
def p7_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = timed.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
