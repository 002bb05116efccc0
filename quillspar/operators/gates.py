"""Gates: evidence for a question, sections and revisions before they are published, numbers in the names of files."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.registry import query
from quillspar.sources.tables import table

#: Tags of chunks that are no evidence, signs that evidence has at least, the score that an intent needs.
BAD_TAGS, LEAST, THRESHOLD = ("empty", "failed", "bad"), 30, 2


@dataclass(frozen=True)
class Intent:
    """Words that show a text speaks of something: two points for a strong one, one for a weak one; one of ``required`` must be there, if any are named."""

    strong: tuple[str, ...]
    weak: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    threshold: int = THRESHOLD


def plain(text: Column) -> Column:
    """Lower case without white space; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")


def _hits(content: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(content, F.lit(re.sub(r"\s+", "", word.lower()))).cast("int") for word in words], F.lit(0))


def validate_evidence(hits: DataFrame, targets: dict[str, tuple[str, ...]], intents: dict[str, Intent], least_score: float | None = None) -> DataFrame:
    """Adds ``reason``, ``matched_intent`` and ``intent_scores`` to hits (title, code, text, quality, score).

    The first gate that fails names the reason: ``empty`` or ``short`` text, ``quality:<tag>``, ``score:<score>`` below
    ``least_score`` (a null score passes), ``entity:<names>`` if no alias of any target is in title, code or text, and
    ``intent:<name>=<score>,...`` if the text alone serves none of the intents; else ``accepted``, with the first intent
    that it serves. No targets or no intents are no gate.
    """
    text = F.coalesce("text", F.lit(""))
    tag = F.lower(F.coalesce("quality", F.lit("")))
    whole = plain(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("code", F.lit("")), F.lit("\n"), text))
    body = plain(text)
    aliases = [re.sub(r"\s+", "", alias.lower()) for names in targets.values() for alias in names]
    entity = reduce(lambda a, b: a | b, [F.contains("_whole", F.lit(alias)) for alias in aliases], F.lit(not targets))
    scores = {name: 2 * _hits(F.col("_body"), rule.strong) + _hits(F.col("_body"), rule.weak) for name, rule in intents.items()}
    served = {name: (scores[name] >= rule.threshold) & ((_hits(F.col("_body"), rule.required) > 0) if rule.required else F.lit(True)) for name, rule in intents.items()}
    matched = F.coalesce(*[F.when(served[name], F.lit(name)) for name in intents]) if intents else F.lit(None).cast("string")
    told = F.concat_ws(",", *[F.concat(F.lit(f"{name}="), score.cast("string")) for name, score in scores.items()])
    reason = (
        F.when(text == "", "empty").when(F.length(F.trim(text)) < LEAST, "short").when(tag.isin(*BAD_TAGS), F.concat(F.lit("quality:"), tag))
        .when(F.col("score") < (F.lit(least_score) if least_score is not None else F.lit(None)), F.concat(F.lit("score:"), F.format_string("%.4f", F.col("score").cast("double"))))
        .when(~entity, F.lit("entity:" + ",".join(targets))).when(F.lit(bool(intents)) & F.col("matched_intent").isNull(), F.concat(F.lit("intent:"), "intent_scores")).otherwise("accepted")
    )
    out = hits.withColumns({"_whole": whole, "_body": body}).withColumns({"matched_intent": matched, "intent_scores": told}).withColumn("reason", reason)
    passed = F.col("reason") == "accepted"
    return out.withColumn("matched_intent", F.when(passed, F.col("matched_intent"))).drop("_whole", "_body")


#: Where a block of knowledge may come from, states in which a section is not done, sources that no longer hold.
SOURCES, UNDONE = ("grounded", "model_prior", "mixed", "unknown", "external"), ("failed", "evidence_insufficient", "legacy_unverified")
WITHDRAWN = ("repealed", "withdrawn", "deleted", "inactive", "废止", "撤回")
CITATION = r"\[Wiki证据(\d+)\]"


def section_errors(sections: DataFrame, high_risk: list[str] = []) -> DataFrame:
    """Adds ``errors``, what is wrong with a section that is to be published, each kind once, in a fixed order.

    Sections have content, applicable, skip_reason, status, validated, section, blocks (array of source, ids, refs,
    text) and evidence (array of evidence_id, status). Null applicable is true, null validated is true, null arrays are
    empty. A section that does not apply needs a reason and nothing else; an empty one has no other error.
    """
    content = F.trim(F.coalesce("content", F.lit("")))
    size = F.size("_evidence")
    cited = F.transform(F.regexp_extract_all(content, F.lit(CITATION), F.lit(1)), lambda n: n.cast("int"))
    within = lambda n: n.isNotNull() & (n >= 1) & (n <= size)
    blocks = F.col("_blocks")
    ids = lambda b: F.coalesce(b["ids"], F.array().cast("array<int>"))
    refs = lambda b: F.coalesce(b["refs"], F.array().cast("array<string>"))
    referred = lambda b: (F.size(ids(b)) > 0) | (F.size(refs(b)) > 0)
    said = lambda b: F.trim(F.coalesce(b["text"], F.lit("")))
    known = F.transform("_evidence", lambda e: e["evidence_id"])
    bound = F.filter(F.flatten(F.transform(blocks, ids)), within)
    state = lambda n: F.lower(F.coalesce(F.element_at("_evidence", n)["status"], F.lit("")))
    tests = [
        (content.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffd]"), "control_characters"),
        (F.size(F.split(content, "```", -1)) % 2 == 0, "open_fence"),
        (F.exists(cited, lambda n: ~within(n)), "citation_out_of_range"),
        (F.size(blocks) == 0, "no_blocks"),
        (F.exists(blocks, lambda b: ~F.coalesce(b["source"].isin(*SOURCES), F.lit(False))), "unknown_source"),
        (F.exists(blocks, lambda b: (b["source"] == "grounded") & ~referred(b)), "grounded_without_reference"),
        (F.exists(blocks, lambda b: (b["source"] == "model_prior") & referred(b)), "prior_with_reference"),
        (F.exists(blocks, lambda b: (b["source"] == "external") & referred(b)), "external_with_reference"),
        (F.exists(blocks, lambda b: F.exists(refs(b), lambda r: ~F.array_contains(known, r))), "unknown_reference"),
        (F.exists(blocks, lambda b: F.exists(ids(b), lambda n: ~within(n))), "block_out_of_range"),
        (F.exists(blocks, lambda b: (said(b) == "") | ~F.contains(content, said(b))), "block_not_in_content"),
        (F.col("section").isin(*high_risk) & F.exists(blocks, lambda b: ~b["source"].eqNullSafe(F.lit("grounded"))) if high_risk else F.lit(False), "high_risk_unsupported"),
        (F.size(F.array_except(cited, bound)) > 0, "citation_unbound"),
        (F.exists(F.array_distinct(bound), lambda n: state(n).isin(*WITHDRAWN)), "withdrawn_source"),
        (F.col("validated") == False, "not_validated"),  # noqa: E712
        (F.col("status").isin(*UNDONE), "not_done"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in tests]))
    none = F.array().cast("array<string>")
    skipped = F.when(F.coalesce("skip_reason", F.lit("")) == "", F.array(F.lit("skipped_without_reason"))).otherwise(none)
    errors = F.when(F.col("applicable") == False, skipped).when(content == "", F.array(F.lit("empty"))).otherwise(found)  # noqa: E712
    held = sections.withColumns({"_blocks": F.coalesce("blocks", F.expr("CAST(array() AS %s)" % dict(sections.dtypes)["blocks"])), "_evidence": F.coalesce("evidence", F.expr("CAST(array() AS %s)" % dict(sections.dtypes)["evidence"]))})
    return held.withColumn("errors", errors).drop("_blocks", "_evidence")


def publishable(revisions: DataFrame, sections: DataFrame, reviews: DataFrame, high_risk: list[str] = []) -> DataFrame:
    """(page, revision, publishable, reasons) of revisions (page, revision, draft, freshness).

    A revision is published if it is still the page's draft, fresh, has sections without errors and of different names,
    and if the last review (by seq) of every section approves it, as it is or modified, at the very content it has now
    (content_hash). Reasons are sorted; those of a section begin with its name.
    """
    last = reviews.groupBy("page", "revision", "section").agg(F.max_by(F.struct("decision", "content_hash"), "seq").alias("last"))
    named = Window.partitionBy("page", "revision", "section")
    checked = section_errors(sections, high_risk).withColumn("_named", F.count("*").over(named)).join(last, ["page", "revision", "section"], "left")
    approved = F.coalesce(F.col("last.decision").isin("approved", "modified"), F.lit(False))
    states = F.array_compact(F.array(F.when(~approved, "not_approved"), F.when(approved & ~F.col("last.content_hash").eqNullSafe(F.col("content_hash")), "changed_since_review"), F.when(F.col("_named") > 1, "repeated")))
    each = F.transform(F.concat("errors", states), lambda e: F.concat("section", F.lit(": "), e))
    by_page = checked.groupBy("page", "revision").agg(F.flatten(F.collect_list(each)).alias("found"))
    joined = revisions.join(by_page, ["page", "revision"], "left")
    own = F.array_compact(F.array(
        F.when(~F.col("draft").eqNullSafe(F.col("revision")), "not_the_draft"), F.when(~F.col("freshness").eqNullSafe(F.lit("fresh")), "not_fresh"), F.when(F.col("found").isNull(), "no_sections")
    ))
    reasons = F.array_sort(F.array_distinct(F.concat(own, F.coalesce("found", F.array().cast("array<string>")))))
    return joined.select("page", "revision", (F.size(reasons) == 0).alias("publishable"), reasons.alias("reasons"))


#: Patterns of standard codes, regulation numbers and attachments in the names of files.
STANDARD = r"(?i)([A-Z]{2,}\d{0,4})\s*[_T/\s]*?(\d{2,5}(?:\.\d+)?)\s*[\-–—]\s*(\d{4})"
RECOMMENDED = r"(?i)[_/]\s*T\b"
REGULATIONS = (r"[一-鿿]+令第\d+号", r"[一-鿿]+〔\d{4}〕\d+号", r"[一-鿿]+公告\d{4}年第\d+号", r"[一-鿿]+通令第\d+号")
ATTACHMENT = r"(?i)([0-9A-F]{16})"


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def standard_key(code: Column) -> Column:
    """A standard's code without separators, in capitals; null if empty."""
    return _or_null(F.upper(F.regexp_replace(F.trim(code), r"[\s_/–—―−\-‐]", "")))


def regulation_key(code: Column) -> Column:
    """A regulation's number without white space, all of its brackets square; null if empty."""
    return _or_null(F.translate(F.regexp_replace(F.trim(code), r"\s+", ""), "〔〕﹝﹞", "[][]"))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.pdf$", "")


def file_standard(name: Column) -> Column:
    """The key of the standard that a file is named after; a T behind a stroke marks it as recommended wherever it stands."""
    stem = _stem(name)
    part = lambda n: F.regexp_extract(stem, STANDARD, n)
    code = F.concat(part(1), F.when(stem.rlike(RECOMMENDED), "T").otherwise(""), part(2), part(3))
    return F.when(stem.rlike(STANDARD), standard_key(code))


def file_regulation(name: Column) -> Column:
    """The number of the regulation that a file is named after: that of the first pattern which is found."""
    return F.coalesce(*[_or_null(F.regexp_extract(_stem(name), pattern, 0)) for pattern in REGULATIONS])


def file_attachment(name: Column) -> Column:
    """Sixteen hexadecimal digits in a file's name, in capitals."""
    return _or_null(F.upper(F.regexp_extract(name, ATTACHMENT, 1)))


def id_standard(doc_id: Column) -> Column:
    """The key of the standard that a document's id names (STD_AQ_4104_2025, STD_SY_T_5857_2025)."""
    parts = F.split(doc_id, "_", -1)
    marked = F.get(parts, F.lit(2)) == "T"
    at = F.when(marked, 3).otherwise(2)
    code = F.concat(F.get(parts, F.lit(1)), F.when(marked, "/T ").otherwise(" "), F.get(parts, at), F.lit("-"), F.get(parts, at + 1))
    return F.when(doc_id.startswith("STD_") & (F.size(parts) >= 4), standard_key(code))


_EVIDENCE = {"targets": {"office": ("bureau", "the office"), "house": ("th e", "der")}, "intents": {"rights": Intent(("license", "permission"), ("with", "use")), "access": Intent(("password",), ("key", "token"), ("api", "secret"), 1)}}


def _score_sql(rule: Intent) -> str:
    return " + ".join([f"2 * contains(b, '{w}')::INT" for w in rule.strong] + [f"contains(b, '{w}')::INT" for w in rule.weak])


_RIGHTS, _ACCESS = (_score_sql(rule) for rule in _EVIDENCE["intents"].values())


@query(
    "k07_evidence_gate",
    f"""WITH h AS (SELECT doc_id, text, CASE doc_id % 9 WHEN 0 THEN 'Bad' WHEN 1 THEN 'ok' END AS tag, CASE WHEN doc_id % 7 <> 0 THEN (n_chars % 10) / 10.0 END AS score,
          regexp_replace(lower(coalesce(source, '') || coalesce(lang, '') || coalesce(text, '')), '\\s+', '', 'g') AS w, regexp_replace(lower(coalesce(text, '')), '\\s+', '', 'g') AS b FROM documents),
        s AS (SELECT *, {_RIGHTS} AS rights, {_ACCESS} AS access, contains(b, 'api') OR contains(b, 'secret') AS needed FROM h)
        SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN length(trim(text)) < 30 THEN 'short' WHEN lower(tag) IN ('empty', 'failed', 'bad') THEN 'quality:' || lower(tag)
          WHEN score < 0.2 THEN 'score:' || printf('%.4f', score::DOUBLE) WHEN NOT (contains(w, 'bureau') OR contains(w, 'theoffice') OR contains(w, 'the') OR contains(w, 'der')) THEN 'entity:office,house'
          WHEN NOT (rights >= 2 OR access >= 1 AND needed) THEN 'intent:rights=' || rights || ',access=' || access ELSE 'accepted:' || CASE WHEN rights >= 2 THEN 'rights' ELSE 'access' END END AS reason FROM s""",
)
def k07_evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why every document is, or is no, evidence for a question about two entities with two intents."""
    tag = F.when(F.col("doc_id") % 9 == 0, "Bad").when(F.col("doc_id") % 9 == 1, "ok")
    score = F.when(F.col("doc_id") % 7 != 0, (F.col("n_chars") % 10) / 10.0)
    hits = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("code"), "text", tag.alias("quality"), score.alias("score"))
    found = validate_evidence(hits, least_score=0.2, **_EVIDENCE)
    return found.select("doc_id", F.concat_ws(":", "reason", "matched_intent").alias("reason"))


@query(
    "k25_revision_gate",
    """WITH s AS (SELECT conv_id AS page, turn, role, text, turn::VARCHAR AS section, md5(text) AS now, md5(CASE WHEN conv_id % 6 = 0 AND turn = 1 THEN 'old' ELSE text END) AS seen,
         role = 'system' AND conv_id % 2 = 0 AS skipped, CASE WHEN conv_id % 5 = 0 AND turn = 2 THEN 'rejected' ELSE 'approved' END AS decision FROM conversations),
        e AS (SELECT *, CASE WHEN skipped OR trim(text) = '' OR length(text) >= 40 THEN [] ELSE ['not_done'] END AS a, CASE WHEN NOT skipped AND trim(text) = '' THEN ['empty'] ELSE [] END AS b,
          CASE WHEN NOT skipped AND trim(text) <> '' AND page % 4 = 0 AND role = 'assistant' THEN ['grounded_without_reference'] ELSE [] END AS c,
          CASE WHEN decision = 'rejected' THEN ['not_approved'] WHEN now <> seen THEN ['changed_since_review'] ELSE [] END AS d FROM s),
        u AS (SELECT page, section || ': ' || unnest(a || b || c || d) AS reason FROM e UNION ALL SELECT DISTINCT page, 'not_fresh' FROM s WHERE page % 7 = 0 UNION ALL SELECT DISTINCT page, 'not_the_draft' FROM s WHERE page % 11 = 0),
        g AS (SELECT page, string_agg(reason, ',' ORDER BY reason) AS reasons FROM (SELECT DISTINCT page, reason FROM u) GROUP BY page)
       SELECT p.page, reasons IS NULL AS publishable, coalesce(reasons, '') AS reasons FROM (SELECT DISTINCT page FROM s) p LEFT JOIN g USING (page)""",
)
def k25_revision_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every conversation, read as a page whose turns are reviewed sections, can be published, and why not."""
    turns = table(spark, sf_dir, "conversations").withColumns({"page": F.col("conv_id"), "revision": F.lit(1), "section": F.col("turn").cast("string")})
    source = F.when((F.col("conv_id") % 4 == 0) & (F.col("role") == "assistant"), "grounded").otherwise("unknown")
    block = F.struct(source.alias("source"), F.array().cast("array<int>").alias("ids"), F.array().cast("array<string>").alias("refs"), F.col("text").alias("text"))
    none = F.array().cast("array<struct<evidence_id: string, status: string>>")
    sections = turns.select(
        "page", "revision", "section", F.col("text").alias("content"), F.md5("text").alias("content_hash"), (~((F.col("role") == "system") & (F.col("conv_id") % 2 == 0))).alias("applicable"), F.lit("no system").alias("skip_reason"),
        F.when(F.length("text") < 40, "failed").alias("status"), F.lit(True).alias("validated"), F.array(block).alias("blocks"), none.alias("evidence"),
    )
    decision = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 2), "rejected").otherwise("approved")
    seen = F.md5(F.when((F.col("conv_id") % 6 == 0) & (F.col("turn") == 1), "old").otherwise(F.col("text")))
    events = turns.select("page", "revision", "section", decision.alias("decision"), seen.alias("content_hash"), F.lit(2).alias("seq"))
    reviews = events.unionByName(events.withColumns({"seq": F.lit(1), "decision": F.lit("rejected")}))
    pages = turns.select("page", "revision").distinct().withColumns({"draft": F.when(F.col("page") % 11 == 0, 2).otherwise(1), "freshness": F.when(F.col("page") % 7 == 0, "stale").otherwise("fresh")})
    return publishable(pages, sections, reviews).select("page", "publishable", F.array_join("reasons", ",").alias("reasons"))


@query(
    "x08_file_numbers",
    r"""WITH f AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'SN_T ' || p_partkey + 1000 || '.' || p_size || '-2010 ' || p_name || '.pdf' WHEN 1 THEN 'db11/T ' || p_partkey + 1000 || ' – 2025.PDF'
          WHEN 2 THEN '国务院令第' || p_partkey || '号 ' || p_name WHEN 3 THEN '安监总〔20' || 10 + p_size % 10 || '〕' || p_partkey || '号.pdf' WHEN 4 THEN p_name || '_' || upper(substr(md5(p_name), 1, 20)) || '.pdf' ELSE p_name END AS name FROM part),
        s AS (SELECT *, regexp_replace(name, '\.pdf$', '', 'i') AS stem, '([A-Z]{2,}\d{0,4})\s*[_T/\s]*?(\d{2,5}(?:\.\d+)?)\s*[\-–—]\s*(\d{4})' AS p FROM f)
       SELECT id, CASE WHEN regexp_matches(stem, p, 'i') THEN upper(regexp_replace(regexp_extract(stem, p, 1, 'i') || CASE WHEN regexp_matches(stem, '[_/]\s*T\b', 'i') THEN 'T' ELSE '' END || regexp_extract(stem, p, 2, 'i') || regexp_extract(stem, p, 3, 'i'), '[\s_/–—―−\-‐]', '', 'g')) END AS standard,
         translate(nullif(coalesce(nullif(regexp_extract(stem, '[一-鿿]+令第\d+号'), ''), nullif(regexp_extract(stem, '[一-鿿]+〔\d{4}〕\d+号'), ''), nullif(regexp_extract(stem, '[一-鿿]+公告\d{4}年第\d+号'), ''), regexp_extract(stem, '[一-鿿]+通令第\d+号')), ''), '〔〕﹝﹞', '[][]') AS regulation,
         nullif(upper(regexp_extract(name, '([0-9A-F]{16})', 1, 'i')), '') AS attachment FROM s""",
)
def x08_file_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standards, regulations and attachments that files are named after, by the rules, for names made of the parts' names."""
    kind, number = F.col("p_partkey") % 6, F.col("p_partkey")
    name = (
        F.when(kind == 0, F.concat(F.lit("SN_T "), number + 1000, F.lit("."), "p_size", F.lit("-2010 "), "p_name", F.lit(".pdf"))).when(kind == 1, F.concat(F.lit("db11/T "), number + 1000, F.lit(" – 2025.PDF")))
        .when(kind == 2, F.concat(F.lit("国务院令第"), number, F.lit("号 "), "p_name")).when(kind == 3, F.concat(F.lit("安监总〔20"), 10 + F.col("p_size") % 10, F.lit("〕"), number, F.lit("号.pdf")))
        .when(kind == 4, F.concat("p_name", F.lit("_"), F.upper(F.substring(F.md5("p_name"), 1, 20)), F.lit(".pdf"))).otherwise(F.col("p_name"))
    )
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    found = {"standard": file_standard(F.col("name")), "regulation": regulation_key(file_regulation(F.col("name"))), "attachment": file_attachment(F.col("name"))}
    return named.select("id", *[value.alias(column) for column, value in found.items()])
