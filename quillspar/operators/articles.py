"""Reports cut into headed chunks, encyclopedia articles and their excerpts, targets of questions, audit flags."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.registry import query
from quillspar.sources.tables import table

#: How headings of accident reports begin, and the words that make a short line a heading.
NUMBERED = r"(?:第[一二三四五六七八九十百零]+[章节部分篇]|[一二三四五六七八九十]+[、.．]|[（(][一二三四五六七八九十]+[）)]|\d{1,2}[、.．]|\d{1,2}\.\d{1,2})"
TITLES = (
    "事故基本情况 基本情况 事故概况 事故发生经过 事故经过 事故应急处置 应急处置 事故原因 直接原因 间接原因 事故性质 人员伤亡 伤亡情况 经济损失 责任认定 责任追究 "
    "事故防范措施 防范措施 整改措施 调查结论 企业概况 设备情况 处理意见 事故责任 事故类别"
).split()
#: Longest heading; a section up to WHOLE signs is one chunk, a longer one has windows of SIZE that overlap by OVERLAP.
LONGEST, WHOLE, SIZE, OVERLAP = 60, 1200, 1000, 150
BODY = "正文"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_heading(line: Column) -> Column:
    """Whether a line of at most 60 signs begins with a number, or is a heading's word with at most six more signs."""
    known = rf"^(?:{NUMBERED}|(?:{'|'.join(TITLES)}).{{0,6}}$)"
    return (F.length(_stripped(line)) <= LONGEST) & _stripped(line).rlike(known)


def section_chunks(reports: DataFrame) -> DataFrame:
    """Rows (doc_id, chunk, section, text) of ``reports`` (doc_id, text): chunks of the headed sections, numbered from 1 over a report.

    What stands before the first heading is the section ``正文``; sections without text make no chunk, nor do null texts. All work is on
    arrays of one row, so nothing is shuffled.
    """
    lines = reports.select("doc_id", F.split("text", "\n", -1).alias("lines"))
    at = F.filter(F.transform("lines", lambda line, k: F.when(is_heading(line), k)), lambda k: k.isNotNull())
    marked = lines.select("doc_id", "lines", F.concat(F.array(F.lit(-1)), at).alias("begin"), F.concat(at, F.array(F.size("lines"))).alias("end"))
    body = lambda begin, end: _stripped(F.array_join(F.slice("lines", begin + 2, end - begin - 1), "\n"))
    name = lambda begin: F.when(begin < 0, F.lit(BODY)).otherwise(_stripped(F.element_at("lines", F.greatest(begin, F.lit(0)) + 1)))
    sections = marked.select("doc_id", F.zip_with("begin", "end", lambda begin, end: F.struct(name(begin).alias("section"), body(begin, end).alias("body"))).alias("sections"))
    windows = lambda s: F.sequence(F.lit(0), F.when(F.length(s["body"]) <= WHOLE, 0).otherwise(F.ceil((F.length(s["body"]) - SIZE) / (SIZE - OVERLAP))).cast("int"))
    piece = lambda s, k: _stripped(F.substring(s["body"], k * (SIZE - OVERLAP) + 1, F.when(F.length(s["body"]) <= WHOLE, WHOLE).otherwise(SIZE)))
    pieces = F.flatten(F.transform("sections", lambda s: F.transform(windows(s), lambda k: F.struct(s["section"], piece(s, k).alias("text")))))
    found = sections.select("doc_id", F.posexplode(F.filter(pieces, lambda p: p["text"] != "")).alias("k", "p"))
    return found.select("doc_id", (F.col("k") + 1).alias("chunk"), "p.section", "p.text")


@query(
    "x15_section_chunks",
    r"""WITH l AS (SELECT doc_id, generate_subscripts(lines, 1) AS p, unnest(lines) AS line FROM (SELECT doc_id, string_split(replace(text, '. ', chr(10) || '1、'), chr(10)) AS lines FROM documents)),
        h AS (SELECT *, length(regexp_replace(line, '^\s+|\s+$', '', 'g')) <= 60 AND regexp_matches(line, '^\s*[0-9]{1,2}([、.．]|\.[0-9]{1,2})') AS head FROM l),
        n AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM h),
        s AS (SELECT doc_id, s, coalesce(max(line) FILTER (head), '正文') AS section, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT head), ''), '^\s+|\s+$', '', 'g') AS body FROM n GROUP BY doc_id, s),
        w AS (SELECT doc_id, s, section, body, unnest(generate_series(0, CASE WHEN length(body) <= 1200 THEN 0 ELSE ceil((length(body) - 1000) / 850.0)::BIGINT END)) AS k FROM s),
        c AS (SELECT doc_id, s, k, regexp_replace(section, '^\s+|\s+$', '', 'g') AS section, regexp_replace(substr(body, k * 850 + 1, CASE WHEN length(body) <= 1200 THEN 1200 ELSE 1000 END), '^\s+|\s+$', '', 'g') AS text FROM w)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s, k))::INT AS chunk, section, text FROM c WHERE text <> ''""",
)
def x15_section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sentences are numbered lines; the short ones are headings."""
    text = F.replace(F.col("text"), F.lit(". "), F.lit("\n1、"))
    return section_chunks(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))


#: Words of questions, by what is asked for; phrases of protection, and of operation where both may be meant.
INTENTS = {
    "definition": "是什么 定义 概念 基本情况 基本定义 适用范围 主要用途 用途 性质".split(),
    "hazard": "危险性 危险 风险 危害 安全风险 有什么危害".split(),
    "storage": "储存 贮存 仓储 存放 库房 储存要求 贮存要求".split(),
    "operation": "使用要求 生产要求 生产过程 使用过程 操作 操作要求 接卸 输送 搬运 充装 气化 作业安全 作业要求".split(),
    "facility": "安全设施 设施 报警 联锁 自动控制 自动化控制 安全仪表 sis 紧急切断 检测装置 风险控制".split(),
    "protection": "个体防护 个人防护 防护用品 防护措施 呼吸器 防护服 防毒面具".split(),
    "emergency": "泄漏 事故处置 应急处置 应急措施 怎么处置 如何处置 疏散 堵漏 断源".split(),
    "first_aid": "急救 中毒怎么办 中毒处置 吸入后 人员中毒 医疗救治".split(),
    "training": "应急准备 应急预案 应急物资 应急演练 培训 气防站 救援协议".split(),
}
PROTECTING = "个体防护 个人防护 防护用品 防护服 防毒面具 呼吸器".split()
OPERATING = "操作要求 生产过程 使用过程 接卸 输送 搬运 充装 气化".split()


def named(text: Column, names: dict[str, list[str]]) -> Column:
    """Keys of ``names`` of which one word occurs in the text; case and white space do not count."""
    plain = lambda word: re.sub(r"\s+", "", word.lower())
    spaceless = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", "")
    return F.array_compact(F.array(*[F.when(spaceless.rlike("|".join(re.escape(plain(w)) for w in words)), F.lit(key)) for key, words in names.items()]))


def question_targets(question: Column, entities: dict[str, list[str]], intents: dict[str, list[str]]) -> tuple[Column, Column]:
    """Entities named in a question, and what it asks for.

    A question for protection that mentions workers is none for ``operation``, unless it names an operation. Null names and asks nothing.
    """
    asked = named(question, intents)
    only = (F.size(named(question, {"p": PROTECTING})) > 0) & F.array_contains(asked, "protection") & (F.size(named(question, {"o": OPERATING})) == 0)
    return named(question, entities), F.when(only, F.array_remove(asked, "operation")).otherwise(asked)


_ENTITIES = {"chlorine": ["液氯", "氯气"], "lpg": ["液化石油气", "LPG"]}
_QUESTIONS = ["液氯操作人员的个体防护", "LPG 充装时的防护用品", "氯气泄漏如何处置", "l p g 储存要求与安全风险", "作业人员培训", "SIS 联锁是什么", ""]


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w.lower()}')" for w in words) + ")"


def _keys(names: dict[str, list[str]]) -> str:
    return "[" + ", ".join(f"CASE WHEN {_has(words)} THEN '{key}' END" for key, words in names.items()) + "]"


@query(
    "k08_question_targets",
    f"""WITH q AS (SELECT event_id, list_extract({_QUESTIONS}, (event_id % 7 + 1)::INT) || ' ' || list_extract({_QUESTIONS}, (user_id % 7 + 1)::INT) AS question FROM events),
        t AS (SELECT event_id, regexp_replace(lower(question), '\\s+', '', 'g') AS t FROM q), a AS (SELECT *, {_keys(_ENTITIES)} AS entities, {_keys(INTENTS)} AS asked FROM t)
        SELECT event_id, coalesce(array_to_string(entities, ','), '') AS entities, coalesce(array_to_string(CASE WHEN {_has(PROTECTING)} AND list_contains(asked, 'protection') AND NOT {_has(OPERATING)} THEN [x FOR x IN asked IF x <> 'operation'] ELSE asked END, ','), '') AS intents FROM a""",
)
def k08_question_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and intents of a question an event, made of two phrases."""
    phrase = lambda c: F.element_at(F.array(*map(F.lit, _QUESTIONS)), (F.col(c) % 7 + 1).cast("int"))
    questions = table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", phrase("event_id"), phrase("user_id")).alias("question"))
    entities, intents = question_targets(F.col("question"), _ENTITIES, INTENTS)
    return questions.select("event_id", F.array_join(entities, ",").alias("entities"), F.array_join(intents, ",").alias("intents"))


def audit_plan(assertions: DataFrame, audited: DataFrame, batch: int = 10) -> DataFrame:
    """Rows (id, chunk, reason, batch) of the assertions that have no audit yet.

    ``assertions`` (id, chunk, status, located): one whose validation did not pass, or whose quote was not located, needs a review for the
    reason given; the others have no reason and a batch, numbered from 0 inside a chunk in the order of their ids.
    """
    open_ = assertions.join(audited.select("id"), "id", "left_anti")
    reason = F.when(~F.equal_null("status", F.lit("passed")), "validation").when(~F.coalesce("located", F.lit(False)), "quote")
    ready = open_.withColumn("reason", reason)
    place = F.row_number().over(Window.partitionBy("chunk", F.col("reason").isNull()).orderBy("id"))
    return ready.select("id", "chunk", "reason", F.when(F.col("reason").isNull(), F.floor((place - 1) / batch)).alias("batch"))


@query(
    "k30_audit_plan",
    """WITH a AS (SELECT o_orderkey AS id, o_custkey AS chunk, CASE WHEN o_orderstatus <> 'P' THEN 'passed' ELSE 'failed' END AS status, o_totalprice > 50000 AS located FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM labels)),
       r AS (SELECT *, CASE WHEN status <> 'passed' THEN 'validation' WHEN NOT located THEN 'quote' END AS reason FROM a)
       SELECT id, chunk, reason, CASE WHEN reason IS NULL THEN (row_number() OVER (PARTITION BY chunk, reason IS NULL ORDER BY id) - 1) // 10 END AS batch FROM r""",
)
def k30_audit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") != "P", "passed").otherwise("failed")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("chunk"), status.alias("status"), (F.col("o_totalprice") > 50000).alias("located"))
    return audit_plan(orders, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


#: Headings of an encyclopedia page that open no section, titles of pages that ask for a check, the first section, least length of a paragraph.
NO_SECTION = ("目录", "参考资料", "词条图册", "相关视频")
CHALLENGE = r"<title[^>]*>\s*(?:百度安全验证|安全验证|访问验证|百度一下).*?</title>"
FIRST, LEAST = "基本概述", 20
#: Pages that are read at once.
AT_ONCE = 50
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def plain_name(text: str | None) -> str:
    """A name without signs, case and compatibility forms."""
    return re.sub(r"[^\w]", "", unicodedata.normalize("NFKC", str(text or "")).casefold())


class _Article(HTMLParser):
    """Title, headings and paragraphs of a page, in the order in which they open."""

    def __init__(self, also: tuple[str, ...]) -> None:
        super().__init__()
        self.also, self.open, self.blocks = also, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        classes = (dict(attrs).get("class") or "").split()
        block = None
        if tag in ("script", "style", "sup") or any("superscript" in c or "reference" in c for c in classes):
            block = ("skip", [])
        elif tag in ("h1", "h2", "h3"):
            block = ("title" if tag == "h1" else "heading", [])
        elif tag in self.also or tag == "div" and any(c == "para" or c.startswith("para_") for c in classes):
            block = ("para", [])
        if block:
            self.blocks.append((*block, "J-lemma-title" in classes))
        self.open.append((tag, block))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        blocks = [block for _, block in self.open if block]
        if not any(kind == "skip" for kind, _ in blocks):
            for _, words in blocks:
                words.append(data.strip())


def read_article(html: str | None, names: set[str], also: tuple[str, ...] = ()) -> dict:
    """status, title and sections (heading, text) of one page; ``names`` are plain names of which the title must be one."""
    html = html or ""
    none = {"status": "challenge", "title": None, "sections": []}
    if re.search(CHALLENGE, html, re.S):
        return none
    parser = _Article(also)
    parser.feed(html)
    parser.close()
    blocks = [(kind, "".join(words), marked) for kind, words, marked in parser.blocks]
    titles = sorted((not marked, k) for k, (kind, _, marked) in enumerate(blocks) if kind == "title")
    if not titles:
        return none | {"status": "no_title"}
    title = blocks[titles[0][1]][1]
    if plain_name(title) not in names:
        return none | {"status": "other_title", "title": title}
    sections: list[tuple[str, list[str]]] = [(FIRST, [])]
    for kind, text, _ in blocks:
        if kind == "heading" and text not in NO_SECTION:
            sections.append((text, []))
        elif kind == "para":
            text = re.sub(r"\[\d+(?:[-,，]\d+)*\]", "", text)
            sections[-1][1].extend([text] if len(text) >= LEAST else [])
    found = [{"heading": heading, "text": "\n".join(parts)} for heading, parts in sections if parts]
    return {"status": "ok" if found else "no_sections", "title": title, "sections": found}


def encyclopedia(pages: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows (url, status, title, sections) of ``pages`` (url, html, names): articles whose title is one of their expected names.

    Paragraphs are ``div`` elements of class ``para`` and elements of the tags ``also``. Pages that ask for a check, without a title, with
    another title or without a paragraph say so in their status.
    """

    names = ("url", "status", "title", "sections")
    kind = pa.schema([*[pa.field(c, pa.string()) for c in names[:3]], pa.field("sections", pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string())])))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                # A few pages at a time leave their columns, so a batch is never held a second time.
                rows = batch.slice(start, AT_ONCE).to_pylist()
                found = [{"url": r["url"]} | read_article(r["html"], {plain_name(n) for n in r["names"] or []}, also) for r in rows]
                yield pa.RecordBatch.from_pylist(found, kind)

    return pages.select("url", "html", "names").mapInArrow(read, "url string, status string, title string, sections array<struct<heading: string, text: string>>")


def chapter_excerpt(sections: Column, words: list[str], size: int = 180, least: int = 70) -> Column:
    """(heading, excerpt) of the first section whose heading holds the longest of the words, null where none does.

    An excerpt of 180 signs ends at its last full stop or semicolon, if more than 70 signs stand before that.
    """
    held = lambda s: F.array_max(F.array(F.lit(0), F.lit(0), *[F.when(F.contains(s["heading"], F.lit(w)), len(w)).otherwise(0) for w in words]))
    ranked = F.filter(F.transform(sections, lambda s, k: F.struct(held(s).alias("n"), (-k).alias("k"), s["heading"].alias("heading"), F.substring(s["text"], 1, size).alias("text"))), lambda r: r["n"] > 0)
    best = F.array_max(ranked)
    stop = F.length(F.regexp_extract(best["text"], r"(?s)^.*[。；]", 0))
    return F.when(best.isNotNull(), F.struct(best["heading"].alias("heading"), F.when(stop - 1 > least, F.substring(best["text"], F.lit(1), stop)).otherwise(best["text"]).alias("excerpt")))


@query("x28_encyclopedia")
def x28_encyclopedia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every page that has a title, its paragraphs being ``p`` elements; each page is expected under the title in its first heading."""
    title = F.regexp_replace(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")
    pages = table(spark, sf_dir, "pages").select("url", "html", F.array(title).alias("names"))
    return encyclopedia(pages, ("p",)).select("url", "status", "title", F.size("sections").alias("sections"))
