"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts are summed into cells of source, language and topic; the cells,
not the documents, are raked: in every sweep the weights of each margin in turn
are scaled to its target shares, and no weight may exceed its cell's tokens, so
that weight over tokens is a probability. Weights sum to ``keep`` of the corpus.
A target that even all tokens of a value could not meet is first lowered to
``SLACK`` of what they can, and the difference given to the other values in
proportion. Sweeps go on until every margin is met to ``TOLERANCE``; if targets
contradict each other and ``MOST`` sweeps do not do, a warning tells the largest
difference that is left. Every document is sampled by comparing its cell's
probability with a number between 0 and 1 made from a digest of its id, so the
choice is the same in every run and attempt.

Cells are combined before the shuffle, so a source with a third of all rows
costs a few rows a task; the cells themselves, one for every combination of
values that occurs, are one partition. A lost executor costs ten sweeps: so
often they are written to the shared folder.

Defined results: null or blank sources, languages and topics form the value
``unknown``; null and empty texts have no tokens and their cell's probability; a
cell without tokens has probability 0; documents with a null id draw by their
text; repeated rows draw alike; an empty table gives no rows; other columns are
not read. Target shares are scaled to sum to one over the values that occur; a
value without a target keeps its own share.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.llm.common import Scratch, table

MARGINS = ("source", "lang", "topic")
TEMPER, KEEP, SLACK = 0.7, 0.6, 0.9
SWEEPS, MOST, TOLERANCE = 10, 400, 1e-11

#: Topics by the first pattern that a text holds.
TOPICS = (("licence", r"(?i)licen[cs]e|copyright"), ("contact", r"[A-Za-z0-9]@[A-Za-z0-9]"), ("code", r"(^|[^A-Za-z])(def|return|import|function|class)([^A-Za-z]|$)"), ("list", r"[|]"))


def topic_of(text: Column) -> Column:
    out = F
    for name, pattern in TOPICS:
        out = out.when(text.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("prose"))


def weighed(documents: DataFrame, *more: Column) -> DataFrame:
    """doc_id, the margins, n_tokens and draw of every row, and the columns ``more``."""
    text = F.coalesce("text", F.lit(""))
    value = lambda c: F.when(F.trim(c) != "", F.col(c)).otherwise(F.lit("unknown")).alias(c)
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), text), F.lit(":mix")).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(16**12))
    topic = value("topic") if "topic" in documents.columns else topic_of(text).alias("topic")
    return documents.select(
        "doc_id", value("source"), value("lang"), topic, F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"), draw.alias("draw"), *more
    )


def tempered(cells: DataFrame, power: float = TEMPER) -> DataFrame:
    """Targets (margin, value, share): the margins' own token shares to a power, scaled to one."""
    out = None
    for margin in MARGINS:
        own = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").cast("double").alias("t"))
        shared = own.select(F.lit(margin).alias("margin"), "value", F.when(F.col("t") > 0, F.pow("t", F.lit(power))).otherwise(0.0).alias("share"))
        out = shared if out is None else out.unionByName(shared)
    return out


def feasible(own: DataFrame, margin: str, keep: float) -> DataFrame:
    """``own`` (margin, own, share) with to_margin: target tokens, together ``keep`` of all, that the values' tokens can meet.

    Shares are multiplied by one factor and cut at SLACK of a value's tokens.
    In the order of how little the values can take, the factor is right at the
    first value that it does not cut.
    """
    everything = Window.partitionBy(F.lit(1))
    wanted = F.try_divide("share", F.sum("share").over(everything)) * F.lit(keep) * F.sum("own").over(everything)
    rows = own.withColumn("wanted", wanted).withColumn("most", F.greatest(F.lit(SLACK), F.lit(keep)) * F.col("own"))
    rows = rows.withColumn("ratio", F.when(F.col("wanted") > 0, F.try_divide("most", "wanted")))
    before = Window.partitionBy(F.lit(1)).orderBy(F.col("ratio").asc_nulls_last(), margin)
    cut = F.coalesce(F.sum("most").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("wanted").over(before.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("factor", F.try_divide(F.lit(keep) * F.sum("own").over(everything) - cut, rest))
    factor = F.min(F.when(F.col("factor") <= F.col("ratio"), F.struct("ratio", "factor"))).over(everything)["factor"]
    return rows.select(margin, F.when(F.col("wanted") > 0, F.least("most", factor * F.col("wanted"))).otherwise(0.0).alias(f"to_{margin}"))


def rake(scratch: Scratch, cells: DataFrame, targets: DataFrame, keep: float = KEEP) -> DataFrame:
    """The cells with their fitted weight, ``keep`` of all tokens together, and the target tokens of their values."""
    cells = cells.coalesce(1)
    for margin in MARGINS:
        wanted = targets.where(F.col("margin") == margin).select(F.col("value").alias(margin), F.col("share").cast("double").alias("to"))
        own = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("own")).join(wanted, margin, "left")
        share = F.coalesce("to", F.try_divide("own", F.sum("own").over(Window.partitionBy(F.lit(1)))))
        cells = cells.join(feasible(own.select(margin, "own", share.alias("share")), margin, keep), margin)
    cells = scratch.keep(cells.withColumn("weight", F.lit(keep) * F.col("tokens")), "cells-0")
    for sweep in range(SWEEPS, MOST + 1, SWEEPS):
        now = cells.coalesce(1)
        for _ in range(SWEEPS):
            for margin in MARGINS:
                total = F.sum("weight").over(Window.partitionBy(margin))
                scaled = F.least(F.col("tokens").cast("double"), F.col("weight") * F.col(f"to_{margin}") / total)
                now = now.withColumn("weight", F.when(total > 0, scaled).otherwise(0.0))
        cells = scratch.keep(now, f"cells-{sweep}")
        scratch.drop(f"cells-{sweep - SWEEPS}")
        if (left := residual(cells)) <= TOLERANCE:
            return cells
    warnings.warn(f"targets are missed by up to {left:.2g} of the sampled tokens", stacklevel=2)
    return cells


def residual(cells: DataFrame) -> float:
    """The largest difference between a value's fitted and target tokens, as a share of all fitted tokens."""
    off = [F.abs(F.sum("weight").over(Window.partitionBy(margin)) - F.col(f"to_{margin}")) for margin in MARGINS]
    most, total = cells.coalesce(1).select("weight", F.greatest(*off).alias("off")).agg(F.max("off"), F.sum("weight")).first()
    return (most or 0.0) / (total or 1.0)


def mix(scratch: Scratch, documents: DataFrame, targets: DataFrame | None = None, keep: float = KEEP) -> DataFrame:
    """doc_id, margins, n_tokens, probability and sampled of every row."""
    rows = scratch.keep(weighed(documents), "rows")
    cells = fitted(scratch, rows, targets, keep)
    out = rows.join(cells, list(MARGINS))
    return out.select("doc_id", *MARGINS, "n_tokens", F.round("probability", 6).alias("probability"), (F.col("draw") < F.col("probability")).alias("sampled"))


def fitted(scratch: Scratch, rows: DataFrame, targets: DataFrame | None = None, keep: float = KEEP) -> DataFrame:
    """The margins' values and the probability of every cell of ``rows``."""
    cells = scratch.keep(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    cells = rake(scratch, cells, tempered(cells) if targets is None else targets, keep)
    return cells.select(*MARGINS, F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0).alias("probability"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(Scratch(spark, "op3"), table(spark, sf_dir, "documents"))


def sample(scratch: Scratch, documents: DataFrame, keep: float = KEEP) -> DataFrame:
    """The sampled rows with all their columns."""
    rows = scratch.keep(weighed(documents, F.struct(*documents.columns).alias("row")), "rows")
    return rows.join(fitted(scratch, rows, keep=keep), list(MARGINS)).where("draw < probability").select("row.*")


def _oracle() -> str:
    topic = "CASE " + " ".join(f"WHEN regexp_matches(text, '{pattern}') THEN '{name}'" for name, pattern in TOPICS) + " ELSE 'prose' END"
    value = "CASE WHEN trim({0}) <> '' THEN {0} ELSE 'unknown' END AS {0}"
    steps = [
        f"""whole AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)""",
        f"""rows AS (SELECT doc_id, {value.format('source')}, {value.format('lang')}, {topic} AS topic,
            len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
            ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text) || ':mix'), 1, 12))::BIGINT / {16**12}.0 AS draw FROM whole)""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL)",
    ]
    for margin in MARGINS:
        own = f"SELECT {margin}, sum(tokens) AS own, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {TEMPER}) ELSE 0 END AS s FROM cells GROUP BY {margin}"
        wanted = f"SELECT *, s / sum(s) OVER () * {KEEP} * sum(own) OVER () AS wanted, {max(SLACK, KEEP)} * own AS most FROM ({own})"
        order = f"ORDER BY ratio NULLS LAST, {margin} ROWS BETWEEN"
        factor = f"""SELECT *, ({KEEP} * sum(own) OVER () - coalesce(sum(most) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(wanted) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor FROM (SELECT *, CASE WHEN wanted > 0 THEN most / wanted END AS ratio FROM ({wanted}))"""
        first = f"(SELECT factor FROM ({factor}) WHERE factor <= ratio ORDER BY ratio, factor LIMIT 1)"
        steps.append(f"want_{margin} AS (SELECT {margin}, CASE WHEN wanted > 0 THEN least(most, {first} * wanted) ELSE 0 END AS to_{margin} FROM ({wanted}))")
    joined = " ".join(f"JOIN want_{margin} USING ({margin})" for margin in MARGINS)
    steps.append(f"w0 AS MATERIALIZED (SELECT *, {KEEP} * tokens AS weight FROM cells {joined})")
    # So many sweeps that more of them change nothing that is shown.
    sweep = "FROM swept WHERE n < 150"
    for margin in MARGINS:
        total = f"sum(weight) OVER (PARTITION BY {margin})"
        sweep = f"SELECT * REPLACE (CASE WHEN {total} > 0 THEN least(tokens, weight * to_{margin} / {total}) ELSE 0 END AS weight) FROM ({sweep})"
    steps.append(f"swept AS (SELECT 0 AS n, * FROM w0 UNION ALL SELECT * REPLACE (n + 1 AS n) FROM ({sweep}))")
    steps.append("rated AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS probability FROM swept WHERE n = 150)")
    return f"""WITH RECURSIVE {', '.join(steps)}
        SELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability, draw < probability AS sampled
        FROM rows JOIN rated USING (source, lang, topic)"""


ORACLE = _oracle()
