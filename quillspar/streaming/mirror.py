"""A verified mirror of an upstream table, fed by exports.

An export holds the records that are new or changed, the numbers of those that are
gone, and the manifest of all that should be there afterwards, each record with its
digest. It is applied as a whole or not at all: the digests of records and manifest
are checked, every record must be the manifest's, the mirror that would result must
equal the manifest, and only then are mirror, history and log committed together.
What is wrong is found by joins and counted; no rows come to the driver.

History holds one row for every version of a record with the half-open interval of
its validity; the version that holds has no end. A record that is gone ends, and one
that comes back begins anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.functions.text import safe_url
from quillspar.registry import query
from quillspar.sources.shared import shared_dir
from quillspar.sources.tables import table
from quillspar.streaming.journal import Store

#: Buckets of a manifest's digest: each is digested on its own, in the order of ids.
BUCKETS = 4096
#: The rows of a stream of exports: a head says how many the manifest has (``n``), its digest and the time of the export.
EXPORT = "export long, kind string, id long, body string, hash string, n long, at timestamp"
ARTICLE = "id long, url string, title string, payload string, hash string, removed int"
HISTORY = "id long, payload string, hash string, valid_from timestamp, valid_to timestamp"
LOG = "export long, at timestamp, total long, inserted long, changed long, removed long, snapshot_hash string"


class Rejected(ValueError):
    """An export that is not what it says; nothing was changed."""


def manifest_digest(manifest: DataFrame) -> Column | DataFrame:
    """One row (n, digest) of a manifest (id, hash): the digest of the digests of its buckets, in their order."""
    lines = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("id", "hash"))), lambda r: F.concat(r["id"].cast("string"), F.lit(":"), r["hash"])))
    buckets = manifest.groupBy(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(BUCKETS)).alias("bucket")).agg(F.count("*").alias("n"), F.sha2(lines, 256).alias("digest"))
    whole = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda r: F.concat(r["bucket"].cast("string"), F.lit(":"), r["digest"])))
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(whole, 256).alias("digest"))


def _none(rows: DataFrame, what: str) -> None:
    if not rows.isEmpty():
        raise Rejected(what)


def _tables(store: Store) -> dict[str, DataFrame]:
    empty = lambda schema: store.spark.createDataFrame([], schema)
    found = {name: store.read(name) for name in ("articles", "history", "log")}
    return {name: empty(schema) if found[name] is None else found[name] for name, schema in (("articles", ARTICLE), ("history", HISTORY), ("log", LOG))}


def apply_verified(store: Store, export: DataFrame) -> bool:
    """Applies one export (rows of EXPORT); False if it has been applied, Rejected if anything in it is wrong."""
    head = export.where("kind = 'head'").select("export", "n", "hash", "at").collect()
    if len(head) != 1:
        raise Rejected("an export has one head")
    number, total, snapshot, at = head[0]
    now = _tables(store)
    last = now["log"].agg(F.max("export")).first()[0]
    if last is not None and number <= last:
        return False
    manifest = export.where("kind = 'manifest'").select("id", "hash")
    _none(manifest.groupBy("id").count().where("count > 1"), "a manifest names a record twice")
    stated = manifest_digest(manifest).first()
    if stated.n != total or stated.digest != snapshot:
        raise Rejected("snapshot manifest mismatch")
    records = export.where("kind = 'record'").select("id", F.col("body").alias("payload"), F.col("hash").alias("stated"), F.sha2("body", 256).alias("hash"))
    records = records.withColumns({"url": F.get_json_object("payload", "$.url"), "title": F.get_json_object("payload", "$.title")})
    _none(records.groupBy("id").count().where("count > 1"), "an export states a record twice")
    checked = records.join(manifest.select("id", F.col("hash").alias("due")), "id", "left")
    own_id = F.get_json_object("payload", "$.id").cast("long")
    wrong = ~(F.col("hash").eqNullSafe(F.col("stated")) & F.col("hash").eqNullSafe(F.col("due")) & own_id.eqNullSafe(F.col("id")))
    _none(checked.where(wrong), "record checksum mismatch")
    _none(checked.where((F.coalesce(safe_url(F.col("url")), F.lit("")) == "") | (F.coalesce("title", F.lit("")) == "")), "invalid URL or title")
    gone = export.where("kind = 'removed'").select("id", F.lit(1).alias("_gone")).distinct()
    sent = records.select("id", F.struct("url", "title", "payload", "hash").alias("sent"))
    # One row a record: what is there, what was sent, and whether it is to go.
    both = now["articles"].withColumnRenamed("hash", "old_hash").join(sent, "id", "full").join(gone, "id", "left")
    value = lambda name, old: F.coalesce(F.col(f"sent.{name}"), F.col(old)).alias(name)
    removed = F.when(F.col("_gone").isNotNull(), 1).when(F.col("sent").isNotNull(), 0).otherwise(F.col("removed"))
    after = both.select("id", value("url", "url"), value("title", "title"), value("payload", "payload"), value("hash", "old_hash"), removed.cast("int").alias("removed"))
    active = after.where("removed = 0").select("id", F.col("hash").alias("has"))
    _none(active.join(manifest, "id", "full").where("has IS NULL OR hash IS NULL OR has <> hash"), "mirror does not match upstream snapshot")
    # A version ends where the record changes or goes; one begins where what holds was not valid before.
    was = now["articles"].select("id", F.col("hash").alias("was"), F.col("removed").alias("was_removed"))
    moved = after.join(was, "id", "left").withColumns({
        "ends": (F.col("was_removed") == 0) & ((F.col("removed") == 1) | (F.col("hash") != F.col("was"))),
        "begins": (F.col("removed") == 0) & (F.col("was").isNull() | (F.col("was_removed") == 1) | (F.col("hash") != F.col("was"))),
    })
    when = F.lit(at).cast("timestamp")
    ending = moved.where("ends").select("id", F.lit(True).alias("_ends"))
    closed = now["history"].join(ending, "id", "left")
    closed = closed.withColumn("valid_to", F.when(F.col("_ends") & F.col("valid_to").isNull(), when).otherwise(F.col("valid_to"))).drop("_ends")
    opened = moved.where("begins").select("id", "payload", "hash", when.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    counts = moved.agg(
        F.count("*").alias("all"), F.count_if(F.col("was").isNull()).alias("inserted"), F.count_if(F.col("was").isNotNull() & (F.col("hash") != F.col("was"))).alias("changed"),
        F.count_if((F.col("was_removed") == 0) & (F.col("removed") == 1)).alias("removed"),
    )
    entry = counts.select(F.lit(number).cast("long").alias("export"), when.alias("at"), F.lit(total).cast("long").alias("total"), "inserted", "changed", "removed", F.lit(snapshot).alias("snapshot_hash"))
    store.commit({"articles": after, "history": closed.unionByName(opened), "log": now["log"].unionByName(entry)})
    return True


def mirror_stream(exports: DataFrame, root: str, checkpoint: str):
    """A writer that applies a stream of exports in their order; a batch that is repeated changes nothing.

    Rejected exports stop the stream: the mirror stays at the last good one. All rows of an export come in one trigger.
    """

    def apply(batch: DataFrame, _: int) -> None:
        store = Store(batch.sparkSession, root)
        store.recover(force=True)  # the stream is the only writer
        batch = batch.persist()
        try:
            for row in batch.where("kind = 'head'").select("export").distinct().orderBy("export").toLocalIterator():
                apply_verified(store, batch.where(F.col("export") == row.export))
        finally:
            batch.unpersist()

    return exports.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def exported(rows: DataFrame, sent: DataFrame, gone: DataFrame, number: int, at: str) -> DataFrame:
    """The export of an upstream: of its ``rows`` (id, payload) the ``sent`` ids, and the ids that are ``gone``."""
    hashed = rows.select("id", "payload", F.sha2("payload", 256).alias("hash"))
    none = lambda kind: F.lit(None).cast(kind)
    shape = lambda frame, kind, *columns: frame.select(F.lit(number).cast("long").alias("export"), F.lit(kind).alias("kind"), *columns)
    stated = manifest_digest(hashed)
    head = shape(stated, "head", none("long").alias("id"), none("string").alias("body"), F.col("digest").alias("hash"), F.col("n").cast("long").alias("n"), F.lit(at).cast("timestamp").alias("at"))
    rest = [none("long").alias("n"), none("timestamp").alias("at")]
    records = shape(hashed.join(sent.select("id"), "id", "left_semi"), "record", "id", F.col("payload").alias("body"), "hash", *rest)
    manifest = shape(hashed, "manifest", "id", none("string").alias("body"), "hash", *rest)
    removed = shape(gone, "removed", "id", none("string").alias("body"), none("string").alias("hash"), *rest)
    return head.unionByName(records).unionByName(manifest).unionByName(removed)


@query(
    "i01_verified_mirror",
    """WITH a AS (SELECT c_custkey AS id, '{"id":' || c_custkey || ',"title":"' || c_name || '","url":"https://x.org/' || c_custkey || '"}' AS old,
         '{"id":' || c_custkey || ',"title":"' || c_name || ' ' || c_mktsegment || '","url":"https://x.org/' || c_custkey || '"}' AS new, c_acctbal > 0 AS first, c_nationkey % 3 = 0 AS changed, c_nationkey = 7 AS gone FROM customer)
       SELECT id, sha256(old) AS hash, '2024-01-01' AS valid_from, CASE WHEN gone OR changed THEN '2024-02-01' END AS valid_to FROM a WHERE first
       UNION ALL SELECT id, sha256(CASE WHEN changed THEN new ELSE old END), '2024-02-01', NULL FROM a WHERE NOT gone AND (NOT first OR changed)""",
)
def i01_verified_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exports are verified and applied: customers in credit, then all but those of one nation, a third of them renamed."""
    rows = table(spark, sf_dir, "customer")
    body = lambda title: F.concat(F.lit('{"id":'), "c_custkey", F.lit(',"title":"'), title, F.lit('","url":"https://x.org/'), "c_custkey", F.lit('"}'))
    old, new = body(F.col("c_name")), body(F.concat_ws(" ", "c_name", "c_mktsegment"))
    changed = F.col("c_nationkey") % 3 == 0
    numbered = lambda frame, payload: frame.select(F.col("c_custkey").cast("long").alias("id"), payload.alias("payload"))
    first = numbered(rows.where("c_acctbal > 0"), old)
    second = numbered(rows.where("c_nationkey <> 7"), F.when(changed, new).otherwise(old))
    gone = rows.where("c_nationkey = 7 AND c_acctbal > 0").select(F.col("c_custkey").cast("long").alias("id"))
    sent = rows.where((F.col("c_nationkey") != 7) & (changed | ~(F.col("c_acctbal") > 0))).select(F.col("c_custkey").cast("long").alias("id"))
    store = Store(spark, f"{shared_dir(spark)}/mirror-{uuid.uuid4().hex}")
    apply_verified(store, exported(first, first, gone.limit(0), 1, "2024-01-01"))
    apply_verified(store, exported(second, sent, gone, 2, "2024-02-01"))
    day = lambda name: F.date_format(name, "yyyy-MM-dd").alias(name)
    return store.read("history").select("id", "hash", day("valid_from"), day("valid_to"))
