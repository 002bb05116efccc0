"""One profile of all columns of a table: kinds, what is valid, missing or mismatched, statistics, lengths, months and frequent values.

Counts and moments of all columns come from one aggregation. Values are then dealt
as rows of (column, value), counted per value before anything else, so frequent
values and numbers of different ones come from those counts; bins come from a
second pass that knows the ends. What reaches the driver is a row a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspar.registry import query
from quillspar.sources.tables import table

#: Names that tell a column's kind.
IDS = ("id", "doc_id", "chunk_id", "wiki_id", "assertion_id", "source_id", "content_hash", "draft_revision", "published_revision")
NUMBERS = ("page_start", "page_end", "sample_page", "char_count", "characters", "chunks", "ordinal", "removed")
DATES = ("published_at", "event_at", "updated_at", "reviewed_at", "created_at", "finalized_at")
TEXTS = ("text", "sample_text", "title", "source_path", "source_file", "section", "section_title", "pdf_path", "url")
#: Bins of a histogram and frequent values of a column.
BINS, FREQUENT = 10, 5


def kind(field: T.StructField) -> str:
    """identifier, number, date, json, text, boolean, object, array or category: by the name, else by the type."""
    name, of = field.name, field.dataType
    if name in IDS or name.endswith("_id"):
        return "identifier"
    if name in NUMBERS:
        return "number"
    if name in DATES or name.endswith("_at") or isinstance(of, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if name in ("payload", "summary"):
        return "json"
    if name in TEXTS:
        return "text"
    kinds = ((T.BooleanType, "boolean"), (T.NumericType, "number"), ((T.StructType, T.MapType), "object"), (T.ArrayType, "array"))
    return next((said for types, said in kinds if isinstance(of, types)), "category")


def _missing(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        empty = F.trim(col) == ""
        return col.isNull() | empty | (F.lower(col).isin("nan", "none", "null") if field.name == "pdf_path" else F.lit(False))
    return col.isNull() | (F.size(col) == 0) if isinstance(field.dataType, (T.ArrayType, T.MapType)) else col.isNull()


def _valid(field: T.StructField, said: str) -> Column:
    """Whether a value that is there is one of its kind."""
    col, of = F.col(f"`{field.name}`"), field.dataType
    string = isinstance(of, T.StringType)
    if said == "number":
        return (~F.isnan(col.cast("double")) & (F.abs(col.cast("double")) < float("inf"))) if isinstance(of, T.NumericType) else F.lit(False)
    if said == "date":
        return F.lit(True) if not string else col.rlike(r"^\s*\d{4}-\d{2}-\d{2}") & F.try_to_date(F.substring(F.trim(col), 1, 10), "yyyy-MM-dd").isNotNull()
    if said == "identifier":
        return F.lit(string or isinstance(of, T.IntegralType))
    if said == "json":
        return F.try_parse_json(col).isNotNull() if string else F.lit(False)
    return F.lit(string) if said in ("text", "category") else F.lit(True)


def _text(field: T.StructField) -> Column:
    """A value as it is counted and measured."""
    col = F.col(f"`{field.name}`")
    return F.to_json(col) if isinstance(field.dataType, (T.StructType, T.MapType, T.ArrayType)) else col.cast("string")


def profile(frame: DataFrame) -> DataFrame:
    """One row a column.

    name, kind, total, valid, missing, mismatched, unique; mean, std (of the population) and quantiles (0, 1/4, 1/2, 3/4,
    1, interpolated) of numbers; shortest and longest of texts, objects and arrays; months (value, n) of dates in order;
    frequent (value, n): the FREQUENT commonest values of categories and booleans, the commonest one of others, ties by
    value; histogram (bin, n): BINS of equal width of numbers or lengths, empty ones left out, one if all are equal.
    """
    fields = [(field, kind(field)) for field in frame.schema.fields]
    held = frame.select(*[
        F.struct(_missing(f).alias("missing"), F.when(~_missing(f) & _valid(f, said), _text(f)).alias("value"), _measure(f, said).alias("size")).alias(f"c{k}") for k, (f, said) in enumerate(fields)
    ])
    sums = []
    for k, (_, said) in enumerate(fields):
        size = F.when(F.col(f"c{k}.value").isNotNull(), F.col(f"c{k}.size"))
        numbers = said == "number"
        sums.append(F.struct(
            F.count("*").alias("total"), F.count(f"c{k}.value").alias("valid"), F.count_if(F.col(f"c{k}.missing")).alias("missing"), F.min(size).alias("least"), F.max(size).alias("most"),
            (F.avg(size) if numbers else F.lit(None).cast("double")).alias("mean"), (F.stddev_pop(size) if numbers else F.lit(None).cast("double")).alias("std"),
            (F.percentile(size, [0.0, 0.25, 0.5, 0.75, 1.0]) if numbers else F.lit(None).cast("array<double>")).alias("quantiles"),
        ).alias(f"c{k}"))
    counted = held.agg(*sums).first()
    rows = [(k, f.name, said, *counted[f"c{k}"]) for k, (f, said) in enumerate(fields)]
    of = frame.sparkSession.createDataFrame(rows, "_k int, name string, kind string, total long, valid long, missing long, least double, most double, mean double, std double, quantiles array<double>")
    long = held.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}.value").alias("value"), F.col(f"c{k}.size").alias("size")) for k in range(len(fields))])).alias("v"))
    long = long.select(F.col("v.k").alias("_k"), F.col("v.value").alias("value"), F.col("v.size").alias("size")).where("value IS NOT NULL")
    ends = F.broadcast(of.where("least IS NOT NULL").select("_k", "least", "most", "kind"))  # a row a column
    placed = long.join(ends, "_k")
    width = (F.col("most") - F.col("least")) / BINS
    bin_ = F.when(F.col("most") == F.col("least"), 0).otherwise(F.least(F.lit(BINS - 1), F.floor((F.col("size") - F.col("least")) / F.nullif(width, F.lit(0.0))))).cast("int")
    listed = lambda first: F.array_sort(F.collect_list(F.struct(first, "n")))
    bins = placed.where("size IS NOT NULL").groupBy("_k", bin_.alias("bin")).agg(F.count("*").alias("n")).groupBy("_k").agg(listed("bin").alias("histogram"))
    dates = [k for k, (_, said) in enumerate(fields) if said == "date"]
    months = long.where(F.col("_k").isin(dates)).groupBy("_k", F.substring(F.trim("value"), 1, 7).alias("value")).agg(F.count("*").alias("n")).groupBy("_k").agg(listed("value").alias("months"))
    values = long.groupBy("_k", "value").agg(F.count("*").alias("n"))
    unique = values.groupBy("_k").agg(F.count("*").alias("unique"))
    many = [k for k, (_, said) in enumerate(fields) if said in ("category", "boolean")]
    top = values.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("n"), "value"))).where(F.col("_r") <= F.when(F.col("_k").isin(many), FREQUENT).otherwise(1))
    frequent = top.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value", "n"))), lambda v: F.struct(v["value"].alias("value"), v["n"].alias("n"))).alias("frequent"))
    out = of.join(unique, "_k", "left").join(bins, "_k", "left").join(months, "_k", "left").join(frequent, "_k", "left")
    lengths = F.col("kind").isin("text", "json", "object", "array")
    return out.select(
        "name", "kind", "total", "valid", "missing", (F.col("total") - F.col("valid") - F.col("missing")).alias("mismatched"), F.coalesce("unique", F.lit(0)).alias("unique"), "mean", "std", "quantiles",
        F.when(lengths, F.col("least").cast("long")).alias("shortest"), F.when(lengths, F.col("most").cast("long")).alias("longest"), "histogram", "months", "frequent",
    )


def _measure(field: T.StructField, said: str) -> Column:
    """What a histogram is made of: a number, or the length of a text or of what is written for an object."""
    if said == "number":
        return F.col(f"`{field.name}`").cast("double") if isinstance(field.dataType, T.NumericType) else F.lit(None).cast("double")
    return F.length(_text(field)).cast("double") if said in ("text", "json", "object", "array") else F.lit(None).cast("double")


def _shown(name: str, entries: str, first: str) -> Column:
    return F.coalesce(F.array_join(F.transform(entries, lambda v: F.concat(v[first].cast("string"), F.lit("="), v["n"])), ","), F.lit("")).alias(name)


def _sql() -> str:
    columns = (("event_id", "identifier", "event_id::VARCHAR", "NULL::DOUBLE"), ("created_at", "date", "strftime(ts, '%Y-%m-%d')", "NULL::DOUBLE"), ("event_type", "category", "nullif(event_type, 'view')", "NULL::DOUBLE"),
               ("value", "number", "value::VARCHAR", "value::DOUBLE"), ("payload", "json", "CASE WHEN event_id % 5 = 0 THEN '{' ELSE props END", "length(props)::DOUBLE"))
    parts = " UNION ALL ".join(f"SELECT {k} AS k, '{n}' AS name, '{kind}' AS kind, {v} AS value, {s} AS size, event_id FROM events" for k, (n, kind, v, s) in enumerate(columns))
    return f"""WITH r AS ({parts}), a AS (SELECT *, value IS NULL AS missing, value IS NOT NULL AND NOT (kind = 'json' AND event_id % 5 = 0) AS ok FROM r), v AS (SELECT * FROM a WHERE ok),
      e AS (SELECT k, min(size) AS lo, max(size) AS hi FROM v GROUP BY k), b AS (SELECT k, CASE WHEN hi = lo THEN 0 ELSE least(9, floor((size - lo) / ((hi - lo) / 10)))::INT END AS bin, count(*) AS n FROM v JOIN e USING (k) WHERE size IS NOT NULL GROUP BY ALL),
      h AS (SELECT k, string_agg(bin || '=' || n, ',' ORDER BY bin) AS histogram FROM b GROUP BY k), m AS (SELECT k, string_agg(d || '=' || n, ',' ORDER BY d) AS months FROM (SELECT k, left(value, 7) AS d, count(*) AS n FROM v WHERE kind = 'date' GROUP BY ALL) GROUP BY k),
      c AS (SELECT k, kind, value, count(*) AS n FROM v GROUP BY ALL), u AS (SELECT k, count(*) AS n_unique FROM c GROUP BY k),
      t AS (SELECT k, string_agg(value || '=' || n, ',' ORDER BY r) AS frequent FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, value) AS r FROM c) WHERE kind <> 'number' AND r <= CASE WHEN kind = 'category' THEN 5 ELSE 1 END GROUP BY k)
      SELECT name, kind, count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (missing) AS missing, count(*) FILTER (NOT ok AND NOT missing) AS mismatched, any_value(n_unique) AS unique,
        CASE WHEN kind = 'number' THEN round(avg(size), 6) END AS mean, CASE WHEN kind = 'number' THEN round(stddev_pop(size), 6) END AS std, CASE WHEN kind = 'number' THEN quantile_cont(size, 0.25) END AS q25,
        CASE WHEN kind = 'json' THEN min(size) FILTER (ok) END::BIGINT AS shortest, CASE WHEN kind = 'json' THEN max(size) FILTER (ok) END::BIGINT AS longest, coalesce(any_value(histogram), '') AS histogram, coalesce(any_value(months), '') AS months, coalesce(any_value(frequent), '') AS frequent
      FROM a LEFT JOIN h USING (k) LEFT JOIN m USING (k) LEFT JOIN u USING (k) LEFT JOIN t USING (k) GROUP BY k, name, kind"""


@query("a13_column_profile", _sql())
def a13_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of the table of events: ids, days, types of which one is left out, values, and payloads of which a fifth is broken."""
    events = table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("created_at"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"), "value",
        F.when(F.col("event_id") % 5 == 0, "{").otherwise(F.col("props")).alias("payload"),
    )
    found = profile(events)
    shown = F.when(F.col("kind") == "number", F.lit("")).otherwise(_shown("frequent", "frequent", "value")).alias("frequent")
    return found.select(
        "name", "kind", "total", "valid", "missing", "mismatched", "unique", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.get("quantiles", F.lit(1)).alias("q25"), "shortest", "longest",
        _shown("histogram", "histogram", "bin"), _shown("months", "months", "value"), shown,
    )
