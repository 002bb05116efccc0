"""Main text of web pages by tag-path ratios.

A page is read once as a sequence of blocks: runs of text between block-level
tags, each with its path of enclosing blocks (tag, id and class) from the root.
Elements that are boilerplate by their nature (scripts, navigation, footers,
forms, hidden parts, or named so by id, class or role) are left out. Of every
path the text outside links and the punctuation are summed and divided by the
path's blocks. Both ratios, laid along the page, are smoothed with a Gaussian,
and fused by multiplication into one value a path.

The path that holds most of the fused text and its closest common ancestors
give the content area: the deepest prefix under which ``AREA`` of all fused text
lies, and then the article (or main, or outermost section) around it; without
one, the nearest container. Inside it all is content but paths of several blocks
that are mostly links, unless they follow content there (lists of references);
headings are content there and beside its ancestors. Paths elsewhere are content
if their value reaches ``OUTSIDE`` of the best.

Of a header inside an article or main, or named as an entry's, headings are read
and paragraphs that are named or written as a standfirst. A form is left out unless
the page's content with it weighs more than ``FORM`` times that without: so are pages
that server-side frameworks write into one form. Self-closing drawings end where
they begin.

Where names would leave nothing of a page, as on a page whose outermost element
is called a banner, they are not heeded.

Defined results: null, empty and tag-only pages give an empty text; an empty table
gives no rows; repeated
rows give repeated rows; an unclosed comment or script runs to the end of the
page; character references are decoded as HTML5 does, without a semicolon too;
other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspar.llm.common import small_batches, table

AREA, OUTSIDE, LINKS, FORM = 0.6, 0.5, 0.6, 2.0

#: Elements by their treatment.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style iframe textarea noframes title"
SKIPPED = frozenset("head nav footer aside form button dialog menu fieldset".split())
#: Left out too, but the text around them is one block.
SKIPPED_INLINE = frozenset("noscript template svg math object select canvas video audio".split())
ROOTS = frozenset("html body".split())
#: Of these, only such names make boilerplate: their classes often tell of the layout around them.
AREAS, AREA_NAMED = frozenset("main article".split()), frozenset("comment comments related ad ads advert sponsored promo".split())
#: Quotations inside an article are content as well, however its alerts are called.
QUOTES = frozenset("blockquote q pre".split())
CONTAINERS, HEADINGS = frozenset("article main section div td body".split()), frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag closes, if one of them is open inside the nearest block of another kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of ids, classes and roles that mark boilerplate.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer colophon comment comments respond disqus cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup login "
    "share sharing social related recommended recommendations pagination pager widget toolbar search hidden complementary contentinfo alert skip".split()
)

#: Words that may stand beside these in a name, as in cookie-bar; with any other word, as in share-price, a name marks nothing.
BESIDE = frozenset(
    "bar box block wrap wrapper container content inner outer area section row col column list links link item items icon icons button buttons btn top bottom left right main "
    "site page global primary secondary sub post posts article entry media text slot unit banner zone panel group tools count counts form input field footer header fixed sticky mobile desktop".split()
)
#: Words that make a header an entry's own; names of standfirsts, and the signs that one without a name has at least.
ENTRY, LEADS, LEAD = frozenset("entry post posts article content".split()), frozenset("lead lede standfirst intro summary subtitle deck dek excerpt abstract".split()), 60
#: So begin further such words.
NAMED_STARTS = ("advert", "adsby", "sponsor", "cookie", "breadcrumb", "newsletter", "sidebar", "commentlist")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW.replace(' ', '|')})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    rf"|<({RAW.replace(' ', '|')})\b[^>]*>.*?(?:</\2\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>"
    r"|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""(id|class|role|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.IGNORECASE)
#: Classes that tell of an element elsewhere, such as no-sidebar.
_ELSEWHERE = re.compile(r"(?<![a-z0-9])(?:no|has|with|without|non)[-_][a-z0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")


@dataclass
class Tree:
    """The paths of a page: every path is its parent's number and a label; path 0 is the root."""

    parent: list[int] = field(default_factory=lambda: [-1])
    label: list[str] = field(default_factory=lambda: [""])
    known: dict[tuple[int, str], int] = field(default_factory=dict)

    def child(self, path: int, label: str) -> int:
        if (path, label) not in self.known:
            self.known[path, label] = len(self.parent)
            self.parent.append(path)
            self.label.append(label)
        return self.known[path, label]

    def upward(self, path: int) -> list[int]:
        """The path and the paths around it, up to the root."""
        out = []
        while path >= 0:
            out.append(path)
            path = self.parent[path]
        return out


@dataclass
class Block:
    path: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    #: In an entry's header and not in a heading.
    header: bool = False


@dataclass
class Element:
    tag: str
    path: int
    skipped: bool
    #: In the header of an article, where headings and standfirsts count.
    header: bool = False


def _words(name: str) -> list[str]:
    return [word for word in re.split(r"[^a-z]+", name) if word]


def _own(words: list[str]) -> bool:
    """Whether a name is that of an entry's header."""
    return "header" in words and not ENTRY.isdisjoint(words) and all(word == "header" or word in BESIDE for word in words)


def _named(value: str, marks: frozenset[str]) -> bool:
    """Whether one of the names in an attribute is made of marking words, and words that may stand beside them."""
    for words in map(_words, value.split()):
        if any(word in marks or marks is NAMED and word.startswith(NAMED_STARTS) for word in words) and not _own(words):
            if all(word in marks or word in BESIDE or word.startswith(NAMED_STARTS) for word in words):
                return True
    return False


def _label(tag: str, attributes: str, marks: frozenset[str] = NAMED) -> tuple[str, bool, bool]:
    """The element's label in a path, whether its attributes mark boilerplate, and whether they name an entry's header."""
    label, named, own = tag, False, False
    if attributes.strip(" /\n\t"):
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name in ("id", "class", "role"):
                named |= _named(_ELSEWHERE.sub("", value), marks)
                own |= name != "role" and any(_own(_words(each)) for each in value.split())
                if name != "role" and value.split():
                    label += f".{value.split()[0]}"
            elif name == "style":
                named |= "display:none" in value.replace(" ", "")
            else:
                named |= name == "hidden" or value == "true"
    return label, named and tag not in ROOTS, own


def blocks_of(page: str, by_name: bool = True, forms: bool = False) -> tuple[list[Block], Tree]:
    """The page's blocks with text, in page order, without boilerplate elements, and their paths.

    Names count only if ``by_name``, and forms are read if ``forms``.
    """
    tree = Tree()
    stack = [Element("", 0, False)]
    opened: Counter[str] = Counter()
    found: list[Block] = []
    block: Block | None = None
    links = 0

    def push(tag: str, label: str, skipped: bool, header: bool = False) -> None:
        top = stack[-1]
        path = top.path if skipped else tree.child(top.path, label)
        stack.append(Element(tag, path, skipped or top.skipped, header or top.header))
        opened[tag] += 1

    def close(tag: str) -> None:
        while True:
            gone = stack.pop().tag
            opened[gone] -= 1
            if gone == tag:
                return

    for match in TOKEN.finditer(page):
        tag = match[4] or match[7]
        top = stack[-1]
        if tag is None:
            token = match[0]
            if match[1] or match[2] or token[0] == "<" and len(token) > 1:
                continue
            if top.skipped:
                continue
            text = html.unescape(token)
            if block is None:
                if not text.strip():
                    continue
                block = Block(top.path, header=top.header and not any(opened[h] for h in HEADINGS))
                found.append(block)
            block.parts.append(text)
            if links:
                block.linked += len(text.strip())
            continue
        tag, ending, attributes = tag.lower(), match[3] or match[6], match[5] or match[8] or ""
        if tag == "a":
            links = 0 if ending else 1
        if tag == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if tag in SKIPPED_INLINE:
            if ending:
                if opened[tag]:
                    close(tag)
            elif not attributes.endswith("/"):
                push(tag, tag, True)
            continue
        if tag in INLINE:
            if not ending and by_name and not top.skipped and _label(tag, attributes)[1]:
                push(tag, tag, True)
            elif ending and top.tag == tag:
                close(tag)
            continue
        if not top.skipped:
            block = None
        if tag in VOID:
            continue
        if ending:
            links = 0  # a link that was left open ends with its block
            if opened[tag]:
                close(tag)
            continue
        if tag in CLOSES and any(opened[t] for t in CLOSES[tag]):
            nearest = next((e.tag for e in reversed(stack) if e.tag in CLOSES[tag] or e.tag in ("ul", "ol", "dl", "table", "select")), None)
            if nearest in CLOSES[tag]:
                close(nearest)
        elif tag == "body" and opened["head"]:
            close("head")
        if stack[-1].tag == "p":
            close("p")
        within = bool(opened["article"] or opened["main"])
        label, named, entry = _label(tag, attributes, AREA_NAMED if tag in AREAS or within and tag in QUOTES else NAMED)
        own = tag == "header" and within or entry and not named
        push(tag, label, tag in SKIPPED and not (forms and tag == "form") or tag == "header" and not own or named and by_name and not own, own)
    for block in found:
        block.text = " ".join("".join(block.parts).split())
    return [block for block in found if block.text and (not block.header or _standfirst(tree.label[block.path], block.text))], tree


def _standfirst(label: str, text: str) -> bool:
    tag, _, name = label.partition(".")
    return not LEADS.isdisjoint(_words(name)) or tag == "p" and len(text) >= LEAD and text[-1] in ".!?…。！？\"”’»"


def smooth(values: np.ndarray, sigma: float = 1.0, radius: int = 2) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights inside the page are scaled to one."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    total = np.convolve(values, kernel)[radius : radius + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel)[radius : radius + len(values)]


def _tag(label: str) -> str:
    return label.split(".")[0]


def around(tree: Tree, area: int) -> int:
    """The nearest article around the area, or else main, or the outermost section, or the nearest container."""
    upward = tree.upward(area)
    tags = [_tag(tree.label[path]) for path in upward]
    for tag in ("article", "main"):
        if tag in tags:
            return upward[tags.index(tag)]
    if "section" in tags:
        return upward[len(tags) - 1 - tags[::-1].index("section")]
    return next((path for path, tag in zip(upward, tags, strict=True) if tag in CONTAINERS), 0)


def select(blocks: list[Block], tree: Tree) -> list[Block]:
    """The content blocks, chosen by the fused ratios of their paths."""
    if not blocks:
        return []
    paths, at = np.unique([block.path for block in blocks], return_inverse=True)
    size = np.array([len(block.text) for block in blocks], float)
    free = np.maximum(size - [block.linked for block in blocks], 0)
    points = np.array([len(PUNCTUATION.findall(block.text)) for block in blocks], float) * (free > 0)
    count = np.bincount(at)
    by_text, by_points = np.bincount(at, free) / count, np.bincount(at, points) / count
    fused_each = smooth(by_text[at]) * (1 + smooth(by_points[at]))
    value = np.bincount(at, fused_each) / count
    linked = 1 - np.bincount(at, free) / np.bincount(at, size)
    mass = np.bincount(at, free) * (1 + by_points)
    # Paths are numbered after the paths around them, so one pass back sums what lies under each.
    under = [0.0] * len(tree.parent)
    for path, own in zip(paths.tolist(), mass.tolist(), strict=True):
        under[path] = own
    for path in range(len(under) - 1, 0, -1):
        under[tree.parent[path]] += under[path]
    area = int(paths[int(np.argmax(mass))])
    while area and under[area] < AREA * under[0]:
        area = tree.parent[area]
    area = around(tree, area)
    outside = set(tree.upward(area))
    within = [False] * len(tree.parent)
    for path in range(len(within)):
        within[path] = path == area or path > 0 and within[tree.parent[path]]
    inside = np.array([within[path] for path in paths.tolist()])
    heading = np.array([_tag(tree.label[path]) in HEADINGS for path in paths.tolist()])
    beside = heading & np.array([tree.parent[path] in outside for path in paths.tolist()])
    keep = np.where(inside, (linked <= LINKS) | (count == 1) | heading, beside | (value >= OUTSIDE * value.max()) & (linked <= 0.3))
    if not keep.any():
        keep = value >= value.max()
    out, content = [], False
    for block, k in zip(blocks, at.tolist(), strict=True):
        # A list of links in the area is a menu before its first text and a list of references after it.
        if keep[k] or inside[k] and content:
            out.append(block)
        content |= bool(inside[k] and keep[k] and not heading[k])
    return out


def weight(blocks: list[Block]) -> float:
    """Text outside links, each block's by its punctuation, as in ``select``."""
    return sum(max(0, len(block.text) - block.linked) * (1 + len(PUNCTUATION.findall(block.text))) for block in blocks)


def main_text(page: str | None) -> str:
    page = page or ""
    content = select(*blocks_of(page))
    if re.search("<form", page, re.IGNORECASE):
        with_forms = select(*blocks_of(page, forms=True))
        if weight(with_forms) > FORM * weight(content):
            content = with_forms
    if not content:
        content = select(*blocks_of(page, by_name=False))
    return "\n".join(block.text for block in content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html", 8 << 20):
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(text) for text in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.selectExpr("CAST(page_id AS LONG) AS page_id", "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
