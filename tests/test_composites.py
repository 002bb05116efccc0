"""Composite reads, linkage, job queue and rule extraction: pinned cases and brute-force versions."""

import bisect
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspar.functions import extraction, scalars
from quillspar.operators import articles, composites, evidence, facts, graph, knowledge, linkage, maintenance
from quillspar.streaming import incremental


def test_detail_pages_and_stale_snapshots(spark):
    facts_ = spark.createDataFrame([("d1",), ("d2",)], "id string")
    fragments = spark.createDataFrame([("d1", n, f"c{n}") for n in range(45)], "doc string, seq int, id string")
    relations = spark.createDataFrame([("d1", "r1", "approved"), ("d1", "r2", "pending"), ("d2", "r3", "approved")], "doc string, id string, status string")
    page = composites.fact_detail(facts_, fragments, relations, "d1", offset=40).collect()
    assert [(r.position, r.id, r.total) for r in page if r.kind == "fragment"] == [(n, f"c{n}", 45) for n in range(40, 45)]
    assert [r.id for r in page if r.kind == "relation"] == ["r1"]
    assert composites.fact_detail(facts_, fragments, relations, "none").count() == 0
    with pytest.raises(composites.StaleSnapshot):
        composites.fact_detail(facts_, fragments, relations, "d1", pinned="old", current="new")


def test_relation_facts_keep_the_last_of_an_id(spark):
    rows = [(1, "a", "approved", "氨", "p", "x", "chemical", "site", "entity", "d", None), (2, "a", "modified", "氯", "p", "氨", "chemical", "chemical", "literal", "d", None), (3, "b", "rejected", "s", "p", "o", "site", "site", "entity", "d", None), (4, "", "approved", "s", "p", "o", "site", "site", "entity", "d", None)]
    schema = "seq int, id string, status string, subject string, predicate string, object string, subject_type string, object_type string, object_kind string, doc string, date string"
    got = composites.relation_facts(spark.createDataFrame(rows, schema)).collect()
    assert [(r.id, r.title, r.kind, r.chemicals) for r in got] == [("a", "氯 p 氨", "literal", ["氨", "氯"])]


def test_reviews_with_version_checks(spark):
    events = [("e", 1, 5, "approved", "", ""), ("e", 2, 5, "modified", "why", "new"), ("e", 3, 5, "approved", "", ""), ("e", 4, 6, "rejected", "", ""), ("e", 5, 6, "rejected", "bad", ""), ("e", 6, 6, "modified", "x", " "), ("e", 7, 6, "odd", "x", "y")]
    frame = spark.createDataFrame(events, "entity string, seq long, expected long, decision string, comment string, content string")
    got = composites.review_sections(spark.createDataFrame([("e", 5)], "entity string, revision int"), frame).orderBy("seq").collect()
    assert [(r.outcome, r.revision) for r in got] == [("approved", 5), ("modified", 6), ("conflict", 6), ("invalid", 6), ("rejected", 6), ("invalid", 6), ("invalid", 6)]


def test_instants_and_keys(spark):
    texts = ["2024-05-01", "2024-05-01T08:30:00+08:00", "2024-05-01 00:30:00Z", "2024-05-01T00:30:00", " ", None, "soon"]
    got = [str(r.at) for r in spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").orderBy("n").select(composites.instant(F.col("t")).alias("at")).collect()]
    assert got == ["2024-05-01 00:00:00", *["2024-05-01 00:30:00"] * 3, "None", "None", "None"]
    row = spark.createDataFrame([(None, "d", None, "x" * 100), ("", None, 3, None), ("c", "d", 1, "t")], "c string, d string, p int, t string")
    assert [r.k for r in row.select(composites.chunk_key(F.col("c"), F.col("d"), F.col("p"), F.col("t")).alias("k")).collect()] == ["d::" + "x" * 80, ":3:", "c"]


def test_append_checks(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    main = frame((1, [1.0, 0.0]), (2, [0.0, 1.0]))
    assert [r.vec_id for r in composites.checked_append(main, frame((2, [1.0, 0.0]), (3, [0.6, 0.8]), (3, [0.6, 0.8]))).collect()] == [3]
    for bad in (frame((3, [1.0, 0.0, 0.0])), frame((3, [1.0, 1.0]))):
        with pytest.raises(ValueError):
            composites.checked_append(main, bad)


def test_literal_like(spark):
    texts = ["50%", "500", "a_b", "axb", "c\\d", "cd"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for term, wanted in (("0%", ["50%"]), ("a_b", ["a_b"]), ("\\", ["c\\d"]), ("0", ["50%", "500"])):
        assert sorted(r.t for r in rows.where(facts.holds_literally(F.col("t"), term)).collect()) == sorted(wanted)


def test_article_rules(spark):
    rows = [("explosion", None, "aria_fr"), ("x", "report", "ntsb_news"), ("x", "leak", "ntsb_news"), ("Fined", None, "worksafe_vic"), ("Final report", "fire", None), ("killed", "standard", "s"), ("处罚", None, None), ("安全提示", None, "s"), (None, None, None)]
    got = [r.k for r in spark.createDataFrame(rows, "t string, s string, i string").select(scalars.article_type(F.col("t"), F.col("s"), F.col("i")).alias("k")).collect()]
    assert got == ["investigation", "investigation", "incident", "policy", "investigation", "incident", "policy", "education", "news"]


def test_titles_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 7)
    rng = random.Random(3)
    names = ["".join(rng.choices("abcd 甲乙", k=rng.randrange(0, 9))).strip() for _ in range(60)] + ["氯气泄漏处置规范", "氯气泄露处置规范(2019)", "old widget", "old widge"]
    left = spark.createDataFrame([("k" if n % 2 else "m", n, t) for n, t in enumerate(names)], "kind string, id int, title string")
    right = spark.createDataFrame([("k" if n % 3 else "m", n, t[:-1]) for n, t in enumerate(names)], "kind string, rid int, rtitle string")
    wanted = {}
    for i, a in enumerate(names):
        for j, b in enumerate(t[:-1] for t in names):
            if ("k" if i % 2 else "m") == ("k" if j % 3 else "m") and round(linkage.title_ratio(a, b), 4) >= 60:
                wanted[i, j] = round(linkage.title_ratio(a, b), 4)
    scored = linkage.score_titles(left, right, "kind", 60.0)
    assert {(r.id, r.rid): r.score for r in scored.collect()} == wanted
    taken, used, others = {}, set(), set()
    for (i, j), score in sorted(wanted.items(), key=lambda x: (-x[1], x[0])):
        if i not in used and j not in others:
            used.add(i), others.add(j)
            taken[i] = j
    assert {r.id: r.rid for r in linkage.assign(scored, 60.0).collect()} == taken


def test_ratios():
    assert linkage.partial_ratio("abc", "xxabcxx") == 100.0 and linkage.partial_ratio("", "x") == 0.0
    assert linkage.partial_ratio("abcd", "cdxx") == max(linkage.indel_ratio("abcd", w) for w in ("c", "cd", "cdx", "cdxx", "dxx", "xx", "x"))


def test_job_queue(spark):
    jobs = spark.createDataFrame([], "job string, key string, state string, owner string, until double, cancel boolean, created double")
    jobs = incremental.create_job(incremental.create_job(incremental.create_job(jobs, "a", "k1", 1), "b", "k2", 2), "c", "k1", 3)
    states = lambda: {r.job: (r.state, r.owner) for r in jobs.collect()}
    assert states() == {"a": ("queued", None), "b": ("queued", None)}
    jobs = incremental.claim(jobs, "w1", now=10, seconds=5)
    assert states()["a"] == ("analyzing", "w1")
    jobs = incremental.heartbeat(jobs, "a", "w1", now=12, seconds=5)
    with pytest.raises(ValueError):
        incremental.heartbeat(jobs, "a", "w2", now=12)
    jobs = incremental.claim(incremental.claim(jobs, "w2", now=13), "w3", now=14)
    assert states() == {"a": ("generating", "w1"), "b": ("analyzing", "w2")}
    jobs = incremental.claim(jobs, "w3", now=18)
    assert states()["a"] == ("analyzing", "w3")
    jobs = incremental.finish(incremental.cancel(jobs, "a"), "a", "w3", "ready_for_review")
    assert states()["a"][0] == "cancelled"
    with pytest.raises(ValueError):
        incremental.retry(jobs, "b")
    jobs = incremental.claim(incremental.retry(incremental.finish(jobs, "b", "w2", "failed"), "a"), "w4", now=20)
    assert states() == {"a": ("analyzing", "w4"), "b": ("failed", "w2")}


def test_signature_counts_repeated_rows(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "i int, t string")
    two = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a")], "i int, t string")
    three = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "i int, t string")
    assert len({incremental.snapshot_signature(f, "i", "t").first().signature for f in (one, two, three)}) == 3
    assert incremental.snapshot_signature(one.repartition(3), "i", "t").first() == incremental.snapshot_signature(one, "i", "t").first()


def test_annotations(spark):
    text = "2019年3月21日，某厂爆炸，造成78 人 死亡、76人重伤，另有3人失踪。CAS：7664-41-7。违反GB 18218-2018、AQ/ 3009-2007和第十二条、6.3.1及5.2 储存，应当不超过20mg/m3。记录 2020-1-5"
    found = extraction.annotations(F.col("t"))
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in found.items()]).first()
    assert (row.death_count, row.severe_injury_count, row.minor_injury_count, row.injury_count, row.missing_count) == (78, 76, None, None, 3)
    assert row.standard_codes == ["GB 18218-2018", "AQ/ 3009-2007"] and row.cas_numbers == ["7664-41-7"]
    assert row.dates == ["2019-03-21", "7664-41-07", "2020-01-05"] and row.clauses == ["第十二条", "6.3.1", "5.2"]
    assert row.modalities == ["应当", "应"] and "应当不超过20mg/m3" in row.quantities


def plain_places(text, needle):
    out, start = [], 0
    while (found := text.find(needle, start)) >= 0:
        out.append(found)
        start = found + len(needle)
    return out


def test_excerpts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(["aa", "b", "xyz ", "x" * 90], k=rng.randrange(0, 40))) for _ in range(80)] + ["", "aab"]
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    for source, target in (("aa", "b"), ("b", "b"), ("", "b")):
        got = {r.n: r.e for r in frame.select("n", extraction.pair_excerpt(F.col("t"), source, target, 150, 20).alias("e")).collect()}
        for n, text in enumerate(texts):
            pairs = [(abs(a - b), a, b) for a in plain_places(text, source or "\0") for b in plain_places(text, target) if source != target or a != b]
            wanted = ""
            if pairs and min(pairs)[0] <= 150:
                _, a, b = min(pairs)
                wanted = text[max(0, min(a, b) - 20) : max(a + len(source), b + len(target)) + 20]
            assert got[n] == wanted


def test_first_chunks(spark):
    texts = ["1 总则" + "甲" * 60 + "\n1.1 范围" + "乙" * 3000 + "。" + "丙" * 900 + "\n2 短", "第一条 " + "丁" * 40 + "第二条 短", "", None]
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    got = frame.orderBy("n").select(extraction.split_headed(F.col("t"), "standard").alias("s"), extraction.split_headed(F.col("t"), "regulation").alias("r"), extraction.split_long("t").alias("l")).collect()
    for row, text in zip(got, texts, strict=True):
        if text is not None:
            assert row.s == [p.strip() for p in re.split(r"(?=\n?\d+(?:\.\d+)*\s)", text) if len(p.strip()) > 50]
            assert row.r == [p.strip() for p in re.split(r"(?=\n?第[一二三四五六七八九十百]+条)", text) if len(p.strip()) > 30]
            assert "".join(row.l) == text and all(len(p) <= 1201 for p in row.l)
    assert got[3].l == []


def test_mentions_in_context(spark):
    row = spark.createDataFrame([("聚氯 氯气 氯酸 xair air airs 氯 (air)",)], "t string")
    got = row.select(extraction.mentions_in_context(F.col("t"), ["氯", "氯气", "air"], before="聚", after="酸").alias("m")).first().m
    assert got == ["氯气", "air", "氯", "air"]


def test_scores_against_plain_versions(spark):
    rng = random.Random(7)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(90)})
    frame = spark.createDataFrame(edges, "src int, dst int")
    around = {}
    for a, b in edges:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    import math

    pairs = [(a, b) for a in around for b in around if a < b]
    wanted = {(a, b): sum(1 / math.log(len(around[n])) for n in around[a] & around[b] if len(around[n]) > 1) for a, b in pairs if any(len(around[n]) > 1 for n in around[a] & around[b])}
    got = {(r.a, r.b): r.score for r in graph.adamic_adar(frame, spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got.keys() == wanted.keys() and all(abs(got[p] - wanted[p]) < 1e-9 for p in wanted)


def test_network_weights(spark):
    pages = spark.createDataFrame([(n, "odd" if n % 2 else "even") for n in range(8)], "page int, type string")
    direct = spark.createDataFrame([(0, 1), (1, 2), (3, 2), (2, 2)], "a int, b int")
    sources = spark.createDataFrame([(n, "hot") for n in range(8)] + [(0, "x"), (2, "x"), (2, "x")], "page int, doc string")
    got = {(r.a, r.b): r.weight for r in knowledge.wiki_network(pages, direct, sources, cap=3).collect()}
    import math

    assert got.keys() == {(0, 1), (1, 2), (0, 2), (2, 3)}
    assert got[0, 1] == 3 + 4 and got[2, 3] == 3 + 4 and got[0, 2] == pytest.approx(8 + 1.5 / math.log(2) + 1) and got[1, 2] == 3 + 4


def test_places_agree_with_search():
    assert bisect.bisect(plain_places("aaaa", "aa"), 0) == 1


def test_graph_merge(spark):
    schema = "seq long, assertion_id long, subject string, subject_name string, subject_type string, predicate string, object string, object_name string, object_type string, object_kind string, status string"
    rows = [(1, 1, "a", "A", "t", "p", "b", "B", "t", "entity", "approved"), (2, 2, "c", None, "t", "p", "5", "5", "t", "literal", "approved"), (3, 3, None, None, None, "p", "z", "Z", "t", "entity", "approved"), (4, 4, "a", "A2", "t", "p", "b", "B", "t", "entity", "withdrawn"), (5, 1, "a", "A3", "t", "q", "d", "D", "t", "entity", "modified")]
    nodes = spark.createDataFrame([("old", "Old", "t"), ("a", "was", "t")], "id string, name string, type string")
    edges = spark.createDataFrame([(4, "x", "p", "y", "approved"), (9, "x", "p", "y", "approved")], "assertion_id long, src string, predicate string, dst string, status string")
    got = maintenance.graph_merge(nodes, edges, spark.createDataFrame(rows, schema))
    assert {(r.id, r["name"]) for r in got[0].collect()} == {("old", "Old"), ("a", "A3"), ("b", "B"), ("c", "c"), ("d", "D")}
    assert {(r.assertion_id, r.src, r.predicate, r.dst) for r in got[1].collect()} == {(9, "x", "p", "y"), (1, "a", "q", "d")}


def test_copies_have_a_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "i int, t string")
    made = {r["name"]: (r.rows, r.checksum) for r in maintenance.copy_selected({"x": rows, "y": rows.repartition(3), "z": rows.where("i = 1")}, str(tmp_path / "one")).collect()}
    assert made["x"] == made["y"] != made["z"] and made["z"][0] == 1 and spark.read.parquet(str(tmp_path / "one" / "x")).count() == 3


def test_headed_chunks_against_a_plain_version(spark):
    known = re.compile("(?:第[一二三四五六七八九十百零]+[章节部分篇]|[一二三四五六七八九十]+[、.．]|[（(][一二三四五六七八九十]+[）)]|[0-9]{1,2}[、.．]|[0-9]{1,2}[.][0-9]{1,2})")

    def heading(line):
        line = line.strip()
        return len(line) <= 60 and bool(known.match(line) or any(line.startswith(w) and len(line) <= len(w) + 6 for w in articles.TITLES))

    def plain(text):
        sections, out = [["正文", []]], []
        for line in text.split("\n"):
            if heading(line):
                sections.append([line.strip(), []])
            else:
                sections[-1][1].append(line)
        for name, lines in sections:
            body, start = "\n".join(lines).strip(), 0
            while body:
                end = len(body) if len(body) <= 1200 else min(start + 1000, len(body))
                out.append((name, body[start:end].strip()))
                if end == len(body):
                    break
                start = end - 150
        return [(k + 1, *piece) for k, piece in enumerate(p for p in out if p[1])]

    rng = random.Random(3)
    lines = ["一、 概况", "事故经过", "事故经过如下所述", "事故经过如下所述的那些事情", "3.2 原因", "第二章 处置", "（三）责任", "", "  ", "字" * 61, "1." + "长" * 70, "词" * 400, "句 " * 300, "没有标题"]
    texts = {k: "\n".join(rng.choices(lines, k=rng.randint(1, 12))) for k in range(60)} | {60: "", 61: "字" * 1200, 62: "字" * 1201, 63: "一、", 64: "字" * 1850, 65: "字" * 1851}
    frame = spark.createDataFrame([*texts.items(), (66, None)], "doc_id int, text string")
    got = {}
    for row in articles.section_chunks(frame).orderBy("doc_id", "chunk").collect():
        got.setdefault(row.doc_id, []).append((row.chunk, row.section, row.text))
    assert got == {k: p for k, text in texts.items() if (p := plain(text))}


def test_targets_of_questions(spark):
    asked = ["液氯操作人员需要哪些个体防护", "液氯充装操作时的防护服", "LP G 泄漏", None]
    frame = spark.createDataFrame([(k, q) for k, q in enumerate(asked)], "k int, q string")
    entities, intents = articles.question_targets(F.col("q"), {"chlorine": ["液氯"], "lpg": ["lpg"]}, articles.INTENTS)
    got = frame.select("k", entities.alias("e"), intents.alias("i")).orderBy("k").collect()
    assert [(r.e, r.i) for r in got] == [(["chlorine"], ["protection"]), (["chlorine"], ["operation", "protection"]), (["lpg"], ["emergency"]), ([], [])]


def test_audit_plan_leaves_audited_ones_out(spark):
    rows = [(k, "c", "passed", True) for k in range(12)] + [(20, "c", "failed", True), (21, "c", "passed", False), (22, None, None, None)]
    got = articles.audit_plan(spark.createDataFrame(rows, "id int, chunk string, status string, located boolean"), spark.createDataFrame([(0,)], "id int"))
    found = {r.id: (r.reason, r.batch) for r in got.collect()}
    assert found == {k: (None, (k - 1) // 10) for k in range(1, 12)} | {20: ("validation", None), 21: ("quote", None), 22: ("validation", None)}


def test_encyclopedia_pages_and_excerpts(spark):
    long = "氯是一种有毒气体，使用时必须注意通风并佩戴用具"
    page = f"""<html><title>x</title><h1>other</h1><h1 class="J-lemma-title">液 氯</h1><div class="para_1">{long}<sup>[1]</sup>[2-3]<br>。</div><div class="para">short</div><h2>目录</h2>
      <div class="x"><div class="para"> {long}一</div></div><h2>毒理与健康危害</h2><div class="para">{long}二<script>x</script></div><h3>空</h3><h2>健康危害</h2><div class="para">{"毒" * 100}。{"性" * 100}；</div></html>"""
    rows = [("a", page, ["液氯"]), ("b", page, ["苯"]), ("c", "<title>百度安全验证</title>", ["x"]), ("d", "<p>none</p>", ["x"]), ("e", "<h1>x</h1><div class=para>short</div>", ["X"]), ("f", None, None)]
    found = articles.encyclopedia(spark.createDataFrame(rows, "url string, html string, names array<string>")).cache()
    got = {r.url: r for r in found.collect()}
    assert {u: r.status for u, r in got.items()} == {"a": "ok", "b": "other_title", "c": "challenge", "d": "no_title", "e": "no_sections", "f": "no_title"}
    assert [(s.heading, s.text) for s in got["a"].sections] == [("基本概述", f"{long}。\n{long}一"), ("毒理与健康危害", f"{long}二"), ("健康危害", "毒" * 100 + "。" + "性" * 100 + "；")]
    best = found.where("url = 'a'").select(articles.chapter_excerpt(F.col("sections"), ["毒理", "毒性", "健康危害"]).alias("x"), articles.chapter_excerpt(F.col("sections"), ["运输"]).alias("y"), articles.chapter_excerpt(F.slice("sections", 3, 1), ["健康"]).alias("z")).first()
    assert (best.x.heading, best.x.excerpt, best.y, best.z.excerpt) == ("毒理与健康危害", f"{long}二", None, "毒" * 100 + "。")


def test_unified_diffs(spark, small):
    import difflib

    rnd = random.Random(11)
    rows = [("p0", 1, None), ("p0", 2, "a\nb"), ("p1", 1, "same\n"), ("p1", 2, "same\n")]
    for k in range(40):
        lines = [rnd.choice("abcdef") + "\n" for _ in range(rnd.randrange(60))]
        other = [line for line in lines if rnd.random() > 0.1]
        for _ in range(rnd.randrange(4)):
            other.insert(rnd.randrange(len(other) + 1), "new\n")
        rows += [(f"q{k}", 1, "".join(lines)), (f"q{k}", 2, "".join(other).rstrip("\n"))]
    frame = spark.createDataFrame(rows, "page string, revision int, text string")
    pairs = frame.select("page", F.lit(1).alias("before"), F.lit(2).alias("after")).distinct().union(spark.createDataFrame([("p1", 2, 7)], "page string, before int, after int"))
    text = {(p, r): t or "" for p, r, t in rows}
    for row in evidence.compare(frame, pairs).collect():
        a, b = text[row.page, row.before], text.get((row.page, row.after), "")
        assert row["diff"] == "".join(difflib.unified_diff(a.splitlines(True), b.splitlines(True), fromfile=str(row.before), tofile=str(row.after)))
    found = evidence.x24_unified_diff(spark, small)
    assert found.count() == spark.read.parquet(f"{small}/conversations.parquet").select("conv_id").distinct().count() and found.where("diff LIKE '--- 1%'").count() > 0
