"""Findings of large tables: what must not grow, and results at sizes that the small tables do not reach."""

import math
import random

from pyspark.sql import functions as F

from quillspar.functions import extraction
from quillspar.operators import articles, graph, joins, knowledge, maintenance, postings, retrieval, routes
from quillspar.sources import registry_files, shared


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_standard_codes_of_numbers_with_seven_digits(spark, tmp_path):
    spark.createDataFrame([(1_234_567, 3), (8, 50)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.code for r in routes.x08_standard_codes(spark, str(tmp_path)).collect()}
    assert got == {1_234_567: "GB/T 1234577 2010", 8: None}


def plain_cuts(text):
    out, start = [], 0
    while len(text) - start > 1200:
        stop = text.rfind("。", start, start + 1200)
        end = (stop if stop >= 0 else start + 1200) + 1
        out.append(text[start:end])
        start = end
    return out + ([text[start:]] if text[start:].strip() else [])


def test_long_pieces_are_cut_without_python(spark):
    texts = ["甲" * 1200, "甲" * 1201, "甲" * 1202, "x" * 1199 + "。" + " " * 40, "x" * 1200 + "。" * 3, " " * 1201, " " * 2402 + "\n\x1f", "😀" * 1300 + "。\n" * 700, "a。" + "b\n" * 2000, " ", "\u00a0b"]
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").select("n", extraction.split_long("t").alias("cut"))
    assert {r.n: r.cut for r in frame.collect()} == {n: plain_cuts(t) for n, t in enumerate(texts)}
    assert "Python" not in plan_of(frame)


def test_excerpts_of_thousands_of_places(spark):
    text = "with " * 3000 + "x" * 200 + "from " * 3000 + "with"
    row = spark.createDataFrame([(text,)], "t string").select(extraction.pair_excerpt(F.col("t"), "with", "from", 500, 3).alias("e"), extraction.pair_excerpt(F.col("t"), "from", "with", 500, 3).alias("f")).first()
    assert row.e == row.f == "om from with"


def test_tasks_grow_in_number_with_the_rows(spark, small, monkeypatch):
    frame = spark.range(10)
    assert shared.dealt(frame, 10, "id").rdd.getNumPartitions() == 4
    assert shared.dealt(frame, 9_000_001, "id").rdd.getNumPartitions() == 10
    # What every part of the graph is made of is dealt out by a count of its own, and degrees take one shuffle after it.
    assert plan_of(graph.degrees(spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "src long, dst long"), 3)).count("Exchange") == 1
    assert {tuple(r) for r in graph.degrees(spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "src long, dst long"), 3).collect()} == {(1, 2), (2, 1), (3, 1)}


def test_links_in_both_directions(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 1), (4, None), (5, 4), (None, None)], "src long, dst long")
    assert sorted(map(str, map(tuple, graph.undirected(edges).collect()))) == sorted(map(str, [(1, 2), (2, 1), (3, 3), (None, 1), (1, None), (4, None), (None, 4), (5, 4), (4, 5), (None, None)]))


def test_triangles_give_the_scores_of_linked_pairs(spark):
    rng = random.Random(8)
    edges = {(rng.randrange(50), rng.randrange(50)) for _ in range(220)} | {(0, n) for n in range(50)}
    around = {}
    for a, b in edges:
        if a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    wanted = {(a, b): sum(1 / math.log(len(around[n])) for n in around[a] & around[b]) for a in around for b in around[a] if a < b and around[a] & around[b]}
    got = {(r.a, r.b): r.score for r in graph.adamic_adar_links(spark.createDataFrame(sorted(edges), "src int, dst int")).collect()}
    assert got.keys() == wanted.keys() and all(abs(got[p] - wanted[p]) < 1e-9 for p in wanted)


def test_shared_documents_in_parts_of_large_ones(spark):
    rng = random.Random(4)
    cited = {(rng.randrange(30), rng.randrange(12)) for _ in range(150)} | {(n, 99) for n in range(30)}
    shared_of = lambda a, b: len({d for p, d in cited if p == a} & {d for p, d in cited if p == b})
    wanted = {(a, b, s) for a in range(30) for s, b in sorted((-shared_of(a, b), b) for b in range(30) if a != b and shared_of(a, b))[:3] for s in [-s]}
    frame = spark.createDataFrame(sorted(cited), "page int, doc int")
    for part in (500, 3):
        assert {tuple(r) for r in joins.sharing_most(frame, 3, part).collect()} == wanted


def test_network_sends_lists_instead_of_pairs(spark, monkeypatch):
    rng = random.Random(9)
    pages = [(n, "abc"[n % 3]) for n in range(40)]
    direct = [(n, n % 3) for n in range(40)]
    cited = {(rng.randrange(40), f"d{rng.randrange(25)}") for _ in range(160)} | {(n, f"hot{n % 2}") for n in range(40)}
    of, links = {}, {(min(p), max(p)) for p in direct if p[0] != p[1]}
    for page, doc in cited:
        of.setdefault(doc, []).append(page)
    docs = {p: {d for q, d in cited if q == p} for p in range(40)}
    pairs = links | {(a, b) for group in of.values() for a in sorted(group)[:9] for b in sorted(group)[:9] if a < b}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    score = lambda a, b: sum(1 / math.log(len(near[n])) for n in near.get(a, set()) & near.get(b, set()) if len(near[n]) > 1)
    wanted = {(a, b): 3 * ((a, b) in links) + 4 * len(docs[a] & docs[b]) + 1.5 * score(a, b) + (a % 3 == b % 3) for a, b in pairs}
    made = []
    monkeypatch.setattr(knowledge, "dealt", lambda frame, rows, *keys, each=1: made.append(frame.columns) or shared.dealt(frame, rows, *keys, each=each))
    found = knowledge.wiki_network(spark.createDataFrame(pages, "page int, type string"), spark.createDataFrame(direct, "a int, b int"), spark.createDataFrame(sorted(cited), "page int, doc string"), cap=9)
    got = {(r.a, r.b): r.weight for r in found.collect()}
    assert got.keys() == wanted.keys() and all(abs(got[p] - wanted[p]) < 1e-9 for p in wanted)
    assert made[0] == ["a", "later"]


def test_network_of_all_pages_of_a_source(spark, monkeypatch):
    """Every page of a source makes pairs, in tiles of blocks and strips of rows, and no pair is shuffled."""
    rng = random.Random(10)
    pages = [(n, [None, "a", "b"][n % 3]) for n in range(139)]
    direct = [(n, n % 3) for n in range(140)] + [(rng.randrange(140), rng.randrange(140)) for _ in range(20)] + [(None, 4), (7, None)]
    cited = {(rng.randrange(140), f"d{rng.randrange(30)}") for _ in range(90)} | {(n, "hot") for n in range(0, 140, 2)} | {(None, "d1"), (3, None)}
    docs = {p: {d for q, d in cited if q == p and d} for p in range(140)}
    links = {(min(p), max(p)) for p in direct if None not in p and p[0] != p[1]}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    score = lambda a, b: sum(1 / math.log(len(near[n])) for n in near.get(a, set()) & near.get(b, set()) if len(near[n]) > 1)
    kind = dict(pages)
    wanted = {
        (a, b): 3 * ((a, b) in links) + 4 * len(docs[a] & docs[b]) + 1.5 * score(a, b) + (kind.get(a) == kind.get(b))
        for a in range(140) for b in range(a + 1, 140) if (a, b) in links or docs[a] & docs[b]
    }
    tables = lambda turn, t: (spark.createDataFrame([(turn(n), k) for n, k in pages], f"page {t}, type string"), spark.createDataFrame([(turn(a), turn(b)) for a, b in direct], f"a {t}, b {t}"), spark.createDataFrame([(turn(p), d) for p, d in sorted(cited, key=str)], f"page {t}, doc string"))
    assert {r.weight for r in knowledge.wiki_network(*tables(lambda n: n, "long")).where("a = 136 AND b = 138").collect()} == {wanted[136, 138]}
    for side, cells, turn, t in ((4096, 1 << 20, lambda n: n, "long"), (32, 200, lambda n: n, "int"), (32, 90, lambda n: n if n is None else f"p{n:03}", "string")):
        monkeypatch.setattr(knowledge, "SIDE", side)
        monkeypatch.setattr(knowledge, "CELLS", cells)
        found = knowledge.wiki_network(*tables(turn, t))
        got = {(r.a, r.b): r.weight for r in found.collect()}
        assert got.keys() == {(turn(a), turn(b)) for a, b in wanted} and all(abs(got[turn(a), turn(b)] - w) < 1e-9 for (a, b), w in wanted.items()) and found.count() == len(wanted)
        assert "Exchange" not in plan_of(found)[: plan_of(found).index("FlatMapGroupsInArrow")]


def test_dense_top_by_tiles_equals_a_plain_search(spark, monkeypatch):
    rng = random.Random(3)
    some = lambda: [rng.choice([0.5, -0.25, 0.125, rng.uniform(-1, 1)]) for _ in range(8)]
    vectors = {n: some() for n in range(300)} | {n: [1.0] * 8 for n in range(300, 340)} | {400: None, 401: [1.0] * 5, 402: [None] + [1.0] * 7, 403: [0.5] * 8}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    queries = [n for n in vectors if n % 50 == 0 or n == 320]
    wanted = set()
    for q in queries:
        scores = []
        for n, v in vectors.items():
            plain = v and vectors[q] and len(v) == len(vectors[q]) and None not in v
            scores += [(-round(sum(x * y for x, y in zip(v, vectors[q])), 6) if plain else math.inf, n)] if n != q else []
        wanted |= {(q, n, None if s == math.inf else -s) for s, n in sorted(scores)[:7]}
    monkeypatch.setattr(retrieval, "TILE", 90)
    found = retrieval.dense_top(frame, frame.where(F.col("vec_id").isin(queries)), 7)
    got = {(r.query_id, r.vec_id, None if r.score is None else r.score + 0.0) for r in found.collect()}
    assert {r[:2] for r in got} == {r[:2] for r in wanted} and "FlatMapCoGroupsInArrow" in plan_of(found)
    assert sorted((q, n) for q, n, s in got if s is None) == sorted((q, n) for q, n, s in wanted if s is None)


def test_reports_are_read_once(spark):
    frame = spark.createDataFrame([(1, "3 人死亡，GB 1-2018 第5条 6.3.1 CAS 7664-41-7 2020年1月5日"), (2, None), (3, "")], "doc long, text string")
    found = maintenance.rule_assertions(frame)
    assert {tuple(r) for r in found.collect()} == {
        (1, "has_death_count", "3", "literal"), (1, "references", "GB 1-2018", "entity"), (1, "involves_chemical", "7664-41-7", "entity"), (1, "violates", "第5条", "entity"),
        (1, "violates", "6.3.1", "entity"), (1, "occurred_on", "2020-01-05", "entity"), (1, "occurred_on", "7664-41-07", "entity"),
    }
    assert "Union" not in plan_of(found)


def test_pages_are_read_without_pandas(spark):
    frame = spark.createDataFrame([(f"u{k}", f"<h1>t{k}</h1><p>{'x' * 30}</p>", [f"t{k}"]) for k in range(120)] + [("n", None, None)], "url string, html string, names array<string>")
    found = articles.encyclopedia(frame, ("p",))
    assert {(r.url, r.status, r.title, len(r.sections)) for r in found.collect()} == {(f"u{k}", "ok", f"t{k}", 1) for k in range(120)} | {("n", "no_title", None, 0)}
    assert "MapInPandas" not in plan_of(found)


def test_pages_are_read_whole(spark):
    """A section keeps all its text, and a page that asks for a check says so however late."""
    long, check = "毒" * 7000, "<title>百度安全验证</title>"
    rows = [("a", f"<h1>t</h1><p>{long}</p><h2>h</h2><p>{long}</p><p>{'x' * 30}</p>"), ("b", f"<script>{'x' * 18000}</script>{check}<h1>t</h1><p>{long}</p>"), ("c", f"<title>{'x' * 18000}</title><h1>t</h1><p>{long}</p>")]
    found = {r.url: r for r in articles.encyclopedia(spark.createDataFrame([(*r, ["t"]) for r in rows], "url string, html string, names array<string>"), ("p",)).collect()}
    assert {u: r.status for u, r in found.items()} == {"a": "ok", "b": "challenge", "c": "ok"}
    assert [s.text for s in found["a"].sections] == [long, long + "\n" + "x" * 30] and found["c"].sections[0].text == long


def test_names_are_searched_without_python(spark):
    documents = spark.createDataFrame([(1, "Customer 0001", "AQ 77-2007"), (2, "Customer 0002", ""), (3, "absent words", None)], "doc_id long, title string, code string")
    files = spark.createDataFrame([("a/the Customer#0001 x.pdf",), ("a/AQ 77-2007 of none.pdf",), ("b/customer 0002.pdf",), ("b/ab.pdf",)], "path string")
    found = registry_files.resolve_sources(documents, files)
    assert {tuple(r) for r in found.collect()} == {(1, "a/AQ 77-2007 of none.pdf", 95), (2, "b/customer 0002.pdf", 100)}
    assert "InArrow" not in plan_of(found)


def test_files_of_many_documents_are_not_broadcast(spark):
    """Names that compare alike are one row, a year still decides between them, and no join of names passes the driver."""
    documents = [(n, f"Customer {n % 3:04}", "") for n in range(60)] + [(90, "X 《全省Quoted title》 Y", "AQ 1-2007"), (91, "only one of these", ""), (92, None, None)]
    files = [(f"{n}/Customer#{n % 2:04}.pdf",) for n in range(40)] + [("a/Customer#0002.pdf",), ("a/Customer#0002.pdf",), ("a/2007 quoted title.pdf",), ("b/2008 quoted title.pdf",), ("c/07 only one of these.pdf",), ("d/0-7 only ONE of these.pdf",)]
    found = registry_files.resolve_sources(spark.createDataFrame(documents, "doc_id long, title string, code string"), spark.createDataFrame(files, "path string"))
    assert {tuple(r) for r in found.collect()} == {(n, "a/Customer#0002.pdf", 100) for n in range(2, 60, 3)} | {(90, "a/2007 quoted title.pdf", 85)}
    assert "Broadcast" not in plan_of(found)


def test_an_index_counts_the_documents_of_a_term(spark, tmp_path):
    texts = [(k, "all" + (" even" if k % 2 == 0 else "") + (" one" if k == 7 else "")) for k in range(100)]
    index = postings.build(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), str(tmp_path / "i"))
    assert {(r.term, r.df) for r in index.postings(["all", "even", "one", "none"]).collect()} == {("all", 100), ("even", 50), ("one", 1)}
    assert {(r.term, r.df) for r in spark.read.parquet(f"{tmp_path}/i/frequencies").collect()} == {("all", 100), ("even", 50), ("one", 1)}
