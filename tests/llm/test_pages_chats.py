"""HTML extraction and chat formatting."""

import hashlib
import html
import math
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quillspar.llm import chat_format
from quillspar.llm import html_paths as rules
from quillspar.llm.html_paths import extract, main_text


def test_article_without_boilerplate():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href=a>x</a></nav>"
        "<div class='cookie-notice'>We use cookies, really.</div><article><h1>Head &amp; line</h1><p>One,\n two.<p>Three <b>four</b>.</article>"
        "<section id=comments><p>First! Nice, nice.</p></section><form>Name</form><aside>More</aside><script>var p='</p>'</script><footer>&copy; x</footer>"
    )
    assert main_text(page) == "Head & line\nOne, two.\nThree four."


def test_divisions_without_semantic_tags():
    body = "".join(f"<p>Paragraph number {k}, with some words, and a stop.</p>" for k in range(5))
    page = f"<body><div class='menu'><a href=a>A</a><a href=b>B</a></div><div id=links><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><div class=story>{body}</div>"
    assert main_text(page).split("\n") == [f"Paragraph number {k}, with some words, and a stop." for k in range(5)]


def test_names_of_the_layout_are_not_boilerplate():
    text = "<p>One sentence, and more.</p><p>Another one, with words.</p>"
    assert main_text(f"<body class=has-sidebar><div class='wrap no-sidebar'><main class='with-sidebar header-fixed'>{text}</main></div><div class=sidebar>Side.</div>") == "One sentence, and more.\nAnother one, with words."
    assert main_text(f"<div class=banner>{text}</div>") == "One sentence, and more.\nAnother one, with words."
    assert main_text(f"<article>{text}</article><article class='comment'><p>First, I say, first!</p></article>") == "One sentence, and more.\nAnother one, with words."


def test_odd_pages():
    assert [main_text(p) for p in (None, "", "<p>", "<!-- never closed", "<script>x")] == [""] * 5
    assert main_text("just text &lt; here") == "just text < here"
    assert len(main_text("<article>" + "<p>word, word. </p>" * 20000 + "</article>").split("\n")) == 20000


def test_extract_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)], key=str)
    assert extract(pages.limit(0)).count() == 0


def test_chats_round_trip(spark):
    rows = [
        (1, 0, "user", "a\\<|im_end|>|\\|", 9), (1, 1, "assistant", "<|im_start|>x", 9), (1, 2, "assistant", None, 9), (1, 2, "assistant", None, 9),
        (2, None, "us\ner\\L", "\\", 9), (2, 5, None, "é<|", 9), (None, 1, "assistant", "", 9),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    done = chat_format.format_chats(turns)
    read = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.read_chats(done).collect()}
    assert read[1] == [("user", "a\\<|im_end|>|\\|"), ("assistant", "<|im_start|>x"), ("assistant", ""), ("assistant", "")]
    assert read[2] == [("us\ner\\L", "\\"), ("", "é<|")]
    assert read[None] == [("assistant", "")]
    for row in done.collect():
        assert sum(m.outside + m.inside for m in row.mask) + len("<|im_end|>\n") == len(row.formatted)
        assert row.formatted.count("<|im_start|>") == row.formatted.count("<|im_end|>")
        assert row.formatted.count("<|im_start|>") == row.formatted.count("<|im_end|>")
    inside = {r.conv_id: r.inside for r in done.select("conv_id", chat_format.under_mask(F.col("formatted"), F.col("mask")).alias("inside")).collect()}
    assert inside == {1: ["<\\|im_start|>x"], 2: [], None: []}
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_very_long_texts_and_conversations(spark):
    long = "<|im_sep|>\\é😀" * 20_000
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", long), (1, 2, "assistant", long)] + [(2, n, ("user", "assistant")[n % 2], f"t{n}") for n in range(1500)]
    done = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    inside = chat_format.under_mask(F.col("formatted"), F.col("mask"))
    got = {r.conv_id: (r.turns, r.inside) for r in chat_format.read_chats(done.withColumn("inside", F.transform(inside, chat_format.unescape)), "inside").collect()}
    assert got[1][1] == [long, long] and [t.text for t in got[1][0]] == ["q", long, long]
    assert got[2][1] == [f"t{n}" for n in range(1, 1500, 2)] and len(got[2][0]) == 1500


def test_merged_turns_have_one_header(spark):
    turns = spark.createDataFrame([(1, k, role, str(k)) for k, role in enumerate(["user", "user", "assistant", "assistant"])], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chats(turns).first().formatted == "<|im_start|>user\n0<|im_sep|>1<|im_end|>\n<|im_start|>assistant\n2<|im_sep|>3<|im_end|>\n"


def test_query_digests(spark, small):
    row = chat_format.op7_chat_formatting(spark, small).where(F.col("conv_id") == -1).first()
    said = "<|im_end|><|im_start|>assistant ok"
    assert row.n_turns == 2 and row.loss_chars == len(said)
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_whole_articles():
    long = "This is a sentence of the article, and it says enough to weigh. " * 6
    nested = f"<body><article><h1>Title</h1><div class=body><p>{long}</p><p>{long}</p></div></article></body>"
    assert main_text(nested).split("\n")[0] == "Title"
    items = "".join(f"<li>{long}</li>" for _ in range(6))
    listed = f"<body><article><h1>Title</h1><p>Short lead.</p><h2>Part</h2><ul>{items}</ul><p>End.</p></article></body>"
    assert [line for line in main_text(listed).split("\n") if len(line) < 20] == ["Title", "Short lead.", "Part", "End."]
    deep = f"<body><div><h2>Part</h2><blockquote><ul>{items}</ul></blockquote></div></body>"
    assert main_text(deep).startswith("Part\n")
    linked = f"<body><article><h2><a href=x>One</a></h2><p>{long}</p><h2><a href=y>Two</a></h2><p>{long}</p></article></body>"
    assert [line for line in main_text(linked).split("\n") if len(line) < 20] == ["One", "Two"]
    beside = f"<body><div><h1>Title</h1><div class=text><p>{long}</p><p>{long}</p></div></div><div class=other><ul><li><a>x</a></li><li><a>y</a></li></ul></div></body>"
    assert main_text(beside).split("\n")[0] == "Title" and "x" not in main_text(beside).split("\n")


def test_no_text_is_lost_behind_odd_markup():
    assert main_text("<article><p>See <svg class='i'/> second, part.</p><p>Third <math/>line.</p></article>") == "See second, part.\nThird line."
    assert main_text("<article><p>One <svg><title>t</title><path d='x'/><text>drawn</text></svg>two.</p></article>") == "One two."
    assert main_text("""<article><p>Before.</p><script data-x='it"s>var code = "<p>";</script><p>After.</p></article>""") == "Before.\nAfter."
    assert main_text("<article><p>One <noscript><p>Enable it.</p></noscript>two.</p><p>Three <select><option>o</select> four.</p></article>") == "One two.\nThree four."
    assert main_text("<article><header class=entry-header><h1>Title</h1><p>By someone</p></header><p>The text, at last.</p></article>") == "Title\nThe text, at last."
    assert main_text("<article><p class='share-price'>Up by 3, to 5.</p><div class='search-results'><p>Found it.</p></div><div class='share-buttons'>Share!</div><div class='cookie-bar-2'>Yum.</div></article>") == "Up by 3, to 5.\nFound it."


def test_deep_pages_take_linear_time():
    deep = "<div>" * 60_000 + "<p>Deep, deep down.</p>" * 3000
    began = time.time()
    assert main_text(deep) == "\n".join(["Deep, deep down."] * 3000)
    assert main_text("<div>" * 30_000 + "<p>x, y.</p></i></u></section>" * 3000).count("x, y.") == 3000
    assert time.time() - began < 20


class PlainParser(HTMLParser):
    """Blocks with tuple paths, by the standard library's parser and the same rules."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack, self.blocks, self.open, self.links = [], [], False, False

    def skipped(self):
        return any(skip for _, skip in self.stack)

    def handle_starttag(self, tag, attrs):
        self.links = self.links or tag == "a"
        if tag == "br" and self.open:
            self.blocks[-1][1].append(" ")
        if tag in rules.INLINE:
            return
        self.open = False
        if tag in rules.VOID:
            return
        if tag == "body":
            self.handle_endtag("head")
        if tag in rules.CLOSES and self.stack and self.stack[-1][0].split(".")[0] in rules.CLOSES[tag]:
            self.stack.pop()
        if self.stack and self.stack[-1][0].split(".")[0] == "p":
            self.stack.pop()
        names = " ".join(v or "" for k, v in attrs if k in ("id", "class"))
        skip = tag in rules.SKIPPED or tag in rules.RAW.split() or tag == "header" or names in ("ad", "sidebar")
        self.stack.append((f"{tag}.{names}" if names else tag, skip))

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = False
        if tag in rules.INLINE:
            return
        self.open = self.links = False
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0].split(".")[0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        if self.skipped() or not self.open and not data.strip():
            return
        if not self.open:
            self.blocks.append((tuple(label for label, _ in self.stack), [], [0]))
            self.open = True
        self.blocks[-1][1].append(data)
        if self.links:
            self.blocks[-1][2][0] += len(data.strip())

    def handle_entityref(self, name):
        self.handle_data(html.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.handle_data(html.unescape(f"&#{name};"))


def plain_text(page):
    """The rules of ``select`` over tuple paths, one path at a time."""
    parser = PlainParser()
    parser.feed(page)
    parser.close()
    blocks = [(path, " ".join("".join(parts).split()), linked[0]) for path, parts, linked in parser.blocks]
    blocks = [b for b in blocks if b[1]]
    stats = {}
    for path, text, linked in blocks:
        entry = stats.setdefault(path, [0, 0, 0.0, 0])
        entry[0] += 1
        entry[1] += len(text)
        entry[2] += max(len(text) - linked, 0)
        entry[3] += len(rules.PUNCTUATION.findall(text)) * (len(text) > linked)
    smoothed = [[sum(w * column[i + d] for d, w in kernel if 0 <= i + d < len(blocks)) / sum(w for d, w in kernel if 0 <= i + d < len(blocks)) for i in range(len(blocks))]
                for kernel in [[(d, math.exp(-0.5 * d * d)) for d in range(-2, 3)]] for column in ([stats[p][2] / stats[p][0] for p, _, _ in blocks], [stats[p][3] / stats[p][0] for p, _, _ in blocks])]
    value = {p: sum(a * (1 + b) for (q, _, _), a, b in zip(blocks, *smoothed, strict=True) if q == p) / stats[p][0] for p in stats}
    mass = {p: s[2] * (1 + s[3] / s[0]) for p, s in stats.items()}
    area = max(mass, key=mass.get)
    while area and sum(m for p, m in mass.items() if p[: len(area)] == area) < rules.AREA * sum(mass.values()):
        area = area[:-1]
    tags = [label.split(".")[0] for label in area]
    if "article" in tags:
        area = area[: len(tags) - tags[::-1].index("article")]
    kept = []
    for path, text, _ in blocks:
        linked = 1 - stats[path][2] / stats[path][1]
        heading = path and path[-1].split(".")[0] in rules.HEADINGS
        if path[: len(area)] == area:
            good = linked <= rules.LINKS or stats[path][0] == 1 or heading
        else:
            good = heading and path[:-1] == area[: len(path) - 1] or value[path] >= rules.OUTSIDE * max(value.values()) and linked <= 0.3
        if good:
            kept.append(text)
    return "\n".join(kept)


def test_pages_equal_a_plain_version(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    article = "<article class=x><h1>A &amp; b</h1><p>One, two <a href=u>three</a>.<p>Four &eacute;&#233; five.<ul><li>six.<li><a href=v>seven</a></ul><h2><a href=w>Eight</a></h2><table><tr><td>9.<td>10, 11.</table></article>"
    pages += [f"<body><nav><a href=n>n</a></nav>{article}<aside>more</aside><div class=sidebar><p>side.</p></div></body>", f"<div><header>top</header>{article}<footer>f</footer></div>"]
    assert [main_text(page) for page in pages] == [plain_text(page) for page in pages]


def test_work_grows_with_the_turns_of_a_conversation(spark):
    """Twice the turns take about twice the time, and every assistant text is under the mask once."""

    def took(n):
        turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("té <| \\"), "id").alias("text"))
        frame = chat_format.format_chats(turns)
        began = time.perf_counter()
        row = frame.select(F.array_join(chat_format.under_mask(F.col("formatted"), F.col("mask")), "\n").alias("inside")).select(chat_format.unescape(F.col("inside")).alias("t")).first()
        assert row.t == "\n".join(f"té <| \\{k}" for k in range(n) if k % 3)
        return time.perf_counter() - began

    took(2_000)
    small, large = min(took(20_000) for _ in range(2)), min(took(40_000) for _ in range(2))
    assert large < 3 * small + 0.5


SENTENCE = "The committee met on Tuesday, and it decided, after a long debate, that the bridge would be repaired."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><form id=aspnetForm><div class=menu><a href=/>Home</a></div><div><h1>Title</h1><p>{SENTENCE}</p><p>{SENTENCE}</p></div><div class=footer>Imprint</div></form></body>", f"Title\n{SENTENCE}\n{SENTENCE}"),
        (f"<article><h1>Title</h1><p>{SENTENCE}</p></article><form><label>Your name, please.</label><textarea>x</textarea><p>We answer within a day.</p></form>", f"Title\n{SENTENCE}"),
        (f"<article><div class='entry-header'><h1>Title</h1></div><p>{SENTENCE}</p></article>", f"Title\n{SENTENCE}"),
        (f"<div id=page><div class='site-header'>Site</div><div class='post'><div class=post-header><h1>Title</h1><span>by X</span></div><p>{SENTENCE}</p><p>{SENTENCE}</p></div></div>", f"Title\n{SENTENCE}\n{SENTENCE}"),
        (f"<header>Site</header><main><header><h1>Title</h1><div>3 May</div></header><p>{SENTENCE}</p></main>", f"Title\n{SENTENCE}"),
        (f"<article><header><h1>Title</h1><p class='lead big'>Short lead</p><p>By X, 3 May</p></header><p>{SENTENCE}</p></article>", f"Title\nShort lead\n{SENTENCE}"),
        (f"<article><header><h1>Title</h1><p>{SENTENCE}</p><ul><li>Share</li></ul></header><p>{SENTENCE} Two.</p></article>", f"Title\n{SENTENCE}\n{SENTENCE} Two."),
        (f"<article><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><h1>Title</h1><p>{SENTENCE}</p><h2>Further reading</h2><ul><li><a href=3>A book</a></li><li><a href=4>A paper</a></li></ul></article>", f"Title\n{SENTENCE}\nFurther reading\nA book\nA paper"),
        (f"<article><p>{SENTENCE}</p><blockquote class=alert>They said: beware.</blockquote><div class=alert>Our shop is closed.</div></article>", f"{SENTENCE}\nThey said: beware."),
        (f"<article><p>{SENTENCE}</p><div class=comments><p>{SENTENCE} No!</p></div></article><div class=ad>{SENTENCE}</div><nav>{SENTENCE}</nav>", SENTENCE),
    ],
)
def test_whole_articles_on_common_pages(page, text):
    assert main_text(page) == text
