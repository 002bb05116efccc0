"""A catalogue of pages made from chunks: sections of excerpts chosen by keywords, links to documents and neighbours, accident readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.registry import query
from quillspar.sources.tables import table

#: Signs before a named term, of an excerpt, and that one has at least; excerpts, links and readings of a page.
BEFORE, SIGNS, LEAST, FREE, LINKS, READINGS = 90, 520, 25, 4, 8, 4
CITATION, CONTROL = r"\[Wiki证据\d+\]", r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
#: Sections of a document's page and the words that place a chunk there, six at most; then free excerpts.
DOCUMENT_SECTIONS = {
    "适用范围": (("适用", "范围", "目的", "本标准", "本办法"), 6), "关键条款与要求": (("必须", "应当", "不得", "禁止", "应符合", "应设置", "条", "职责"), 6),
    "事故与异常记录": (("事故", "死亡", "受伤", "泄漏", "爆炸", "异常"), 6), "防范措施与检查": (("整改", "建议", "检查", "防范", "措施", "检验", "检测", "管理"), 6), "原文摘录": ((), FREE),
}


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def excerpt(text: Column, terms: Column, signs: int = SIGNS) -> Column:
    """``signs`` of a text from BEFORE signs before the first of ``terms`` that it holds, else from its beginning.

    Of what control characters part the longest piece stands. Null where fewer than LEAST signs are left, or where they
    hold a citation or a sign that could not be read.
    """
    body = _strip(F.coalesce(text, F.lit("")))
    places = F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.when(t != "", F.instr(body, t)).otherwise(0)), lambda p: p > 0)
    start = F.greatest(F.lit(0), F.coalesce(F.get(places, F.lit(0)), F.lit(1)) - 1 - BEFORE)
    pieces = F.split(_strip(F.substring(body, start + 1, F.lit(signs))), CONTROL, -1)
    longest = F.array_max(F.transform(pieces, lambda p, k: F.struct(F.length(p).alias("n"), (-k).alias("k"), p.alias("p"))))["p"]
    found = _strip(longest)
    return F.when((F.length(found) >= LEAST) & ~found.rlike(CITATION) & ~F.contains(found, F.lit("�")), found)


def chosen(rows: DataFrame, sections: dict[str, tuple[tuple[str, ...], int]]) -> DataFrame:
    """(page, section, n, chunk_id, excerpt): of every page's rows (page, place, chunk_id, text, terms) what its sections quote.

    A section takes rows that hold one of its words, those with more of them first, then by place, and any row if it
    names no words. Rows without an excerpt are passed over. Each section keeps its limit before rows of a page meet.
    """
    quoted = rows.withColumn("excerpt", excerpt(F.col("text"), F.col("terms"))).where("excerpt IS NOT NULL")
    text = F.coalesce("text", F.lit(""))
    hits = {name: sum((F.contains(text, F.lit(word)).cast("int") for word in words), F.lit(0)) for name, (words, _) in sections.items()}
    fits = [F.when(F.lit(not words) | (hits[name] > 0), F.struct(F.lit(name).alias("section"), hits[name].alias("hits"), F.lit(limit).alias("limit"))) for name, (words, limit) in sections.items()]
    placed = quoted.select("page", "place", "chunk_id", "excerpt", F.explode(F.array_compact(F.array(*fits))).alias("s")).select("page", "place", "chunk_id", "excerpt", "s.*")
    n = F.row_number().over(Window.partitionBy("page", "section").orderBy(F.desc("hits"), "place"))
    return placed.withColumn("n", n).where(F.col("n") <= F.col("limit")).select("page", "section", "n", "chunk_id", "excerpt")


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (chunk_id, doc_id, page_start, text, ...) with ``place``, the order in which pages quote them."""
    return chunks.withColumn("place", F.struct("doc_id", F.coalesce(F.col("page_start").cast("string"), F.lit("None")).alias("page_start"), "chunk_id"))


def entity_pages(mentions: DataFrame, aliases: DataFrame, chunks: DataFrame, sections: dict[str, tuple[tuple[str, ...], int]]) -> DataFrame:
    """The sections of a page for every entity: mentions (name, chunk_id), aliases (name, aliases), as ``chosen`` gives them."""
    rows = mentions.select("name", "chunk_id").distinct().join(ordered_chunks(chunks), "chunk_id").join(aliases, "name", "left")
    return chosen(rows.select(F.col("name").alias("page"), "place", "chunk_id", "text", F.col("aliases").alias("terms")), sections)


def document_pages(chunks: DataFrame, sections: dict[str, tuple[tuple[str, ...], int]] = DOCUMENT_SECTIONS) -> DataFrame:
    """The sections of a page for every document, chunks in the order of its pages."""
    place = F.struct(F.coalesce(F.col("page_start").cast("int"), F.lit(0)).alias("page_start"), "chunk_id")
    return chosen(chunks.select(F.col("doc_id").alias("page"), place.alias("place"), "chunk_id", "text", F.array().cast("array<string>").alias("terms")), sections)


def page_links(mentions: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(page, kind, n, target): the first LINKS document pages (documents: doc_id, page) and neighbours of every entity, by name.

    Neighbours are entities of the same document. As only the first LINKS count, a document offers its first LINKS + 1
    names, so one that all entities share makes no more than that many pairs an entity.
    """
    own = mentions.select("name", "chunk_id").distinct().join(chunks.select("chunk_id", "doc_id"), "chunk_id").select("name", "doc_id").distinct()
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("name"))
    offered = own.withColumn("r", place).where(F.col("r") <= LINKS + 1).select("doc_id", F.col("name").alias("target"))
    peers = own.join(offered, "doc_id").where("name <> target").select("name", F.lit("neighbour").alias("kind"), "target")
    related = own.join(documents.select("doc_id", F.col("page").alias("target")), "doc_id").select("name", F.lit("document").alias("kind"), "target")
    n = F.row_number().over(Window.partitionBy("name", "kind").orderBy("target"))
    return peers.unionByName(related).distinct().withColumn("n", n).where(F.col("n") <= LINKS).select(F.col("name").alias("page"), "kind", "n", "target")


def accident_readings(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(page, n, doc_id, chunk_id, excerpt): the first chunk of each of an entity's first READINGS accident reports."""
    reports = ordered_chunks(chunks).where(F.contains("document_type", F.lit("事故")))
    rows = mentions.select("name", "chunk_id").distinct().join(reports, "chunk_id")
    first = rows.groupBy("name", "doc_id").agg(F.min(F.struct("place", "chunk_id", "text")).alias("c"))
    n = F.row_number().over(Window.partitionBy("name").orderBy("c.place"))
    none = F.array().cast("array<string>")
    return first.withColumn("n", n).where(F.col("n") <= READINGS).select(F.col("name").alias("page"), "n", "doc_id", "c.chunk_id", excerpt(F.col("c.text"), none, 220).alias("excerpt"))


_SECTIONS = {"use": (("with", "for", "pour"), 2), "rights": (("license", "token"), 3), "any": ((), 3)}


@query(
    "k35_entity_pages",
    r"""WITH m AS (SELECT lang || '/' || doc_id % 40 AS page, doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, text FROM documents), p AS (SELECT *, instr(t, 'zzz') AS a, instr(t, 'tion') AS b FROM m),
        q AS (SELECT page, doc_id, text, regexp_replace(substr(t, greatest(0, CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE 1 END - 91)::INT + 1, 520), '^\s+|\s+$', '', 'g') AS e FROM p),
        s AS (SELECT *, 'use' AS section, contains(text, 'with')::INT + contains(text, 'for')::INT + contains(text, 'pour')::INT AS hits, 2 AS most, true AS worded FROM q
          UNION ALL SELECT *, 'rights', contains(text, 'license')::INT + contains(text, 'token')::INT, 3, true FROM q UNION ALL SELECT *, 'any', 0, 3, false FROM q),
        r AS (SELECT *, row_number() OVER (PARTITION BY page, section ORDER BY hits DESC, doc_id) AS n FROM s WHERE length(e) >= 25 AND (hits > 0 OR NOT worded))
       SELECT page, section, n::INT AS n, doc_id AS chunk_id, md5(e) AS digest FROM r WHERE n <= most""",
)
def k35_entity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of entities, each of a language and every fortieth of its documents, with three sections of excerpts."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat("lang", F.lit("/"), F.col("doc_id") % 40)
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(1).alias("page_start"), "text")
    mentions = docs.select(name.alias("name"), F.col("doc_id").alias("chunk_id"))
    aliases = mentions.select("name").distinct().select("name", F.array(F.lit("zzz"), F.lit(""), F.lit("tion")).alias("aliases"))
    return entity_pages(mentions, aliases, chunks, _SECTIONS).select("page", "section", "n", "chunk_id", F.md5("excerpt").alias("digest"))
