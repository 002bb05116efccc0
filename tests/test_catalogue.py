"""Catalogue pages against a version that goes through the rows of every page."""

import random
import re

from pyspark.sql import functions as F

from quillspar.operators import catalogue


def plain_excerpt(text, terms, signs=520):
    text = (text or "").strip()
    at = next((text.find(t) for t in terms if t and text.find(t) >= 0), 0)
    start = max(0, at - 90)
    piece = max(re.split(catalogue.CONTROL, text[start : start + signs].strip()), key=len).strip()
    return piece if len(piece) >= 25 and not re.search(catalogue.CITATION, piece) and "�" not in piece else None


def plain_choose(rows, words, limit, terms):
    ranked = sorted(enumerate(rows), key=lambda p: (-sum(w in (p[1]["text"] or "") for w in words), p[0]))
    out = []
    for _, row in ranked:
        if words and not any(w in (row["text"] or "") for w in words):
            continue
        found = plain_excerpt(row["text"], terms)
        if found and len(out) < limit:
            out.append((row["chunk_id"], found))
    return out


def test_pages_links_and_readings(spark):
    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma", "储存", "应当", "事故", "x\x07y", "�", "[Wiki证据1]", "\n", "long words that fill the line", "适用"]
    chunks = []
    for k in range(160):
        doc = f"d{rnd.randrange(25):02}"
        text = rnd.choice([None, "short", *[" ".join(rnd.choices(words[: rnd.choice([6, 12])] + words[10:], k=rnd.randrange(3, 60))) for _ in range(8)]])
        chunks.append({"chunk_id": f"c{k:03}", "doc_id": doc, "page_start": rnd.choice([None, 1, 2, 10]), "text": text, "document_type": "事故报告" if int(doc[1:]) % 3 == 0 else "标准"})
    mentions = [(f"e{rnd.randrange(30):02}", rnd.choice(chunks)["chunk_id"]) for _ in range(400)] + [(f"e{k:02}", "c000") for k in range(30)] + [("e01", "none")]
    aliases = [(f"e{k:02}", rnd.choice([None, [], ["zzz", "", "gamma"], ["beta"]])) for k in range(29)]
    frame = spark.createDataFrame([tuple(c.values()) for c in chunks], "chunk_id string, doc_id string, page_start int, text string, document_type string").repartition(3)
    named = spark.createDataFrame(mentions, "name string, chunk_id string")
    sections = {"first": (("alpha", "储存"), 2), "second": (("gamma", "beta", "alpha"), 3), "free": ((), 4)}
    got = catalogue.entity_pages(named, spark.createDataFrame(aliases, "name string, aliases array<string>"), frame, sections)
    by_id, terms = {c["chunk_id"]: c for c in chunks}, dict(aliases)
    wanted, links, readings = set(), set(), set()
    docs_of = {}
    for name, chunk in mentions:
        if chunk in by_id:
            docs_of.setdefault(name, set()).add(by_id[chunk]["doc_id"])
    for name in {n for n, _ in mentions}:
        rows = sorted((by_id[c] for c in {c for n, c in mentions if n == name} if c in by_id), key=lambda r: (r["doc_id"], str(r["page_start"]), r["chunk_id"]))
        for section, (keys, limit) in sections.items():
            wanted |= {(name, section, n, chunk, text) for n, (chunk, text) in enumerate(plain_choose(rows, keys, limit, terms.get(name) or []), 1)}
        related = sorted({f"p-{d}" for d in docs_of[name]})[:8]
        peers = sorted({n for n, docs in docs_of.items() if n != name and docs & docs_of[name]})[:8]
        links |= {(name, kind, n, t) for kind, targets in (("document", related), ("neighbour", peers)) for n, t in enumerate(targets, 1)}
        seen = []
        for row in rows:
            if row["doc_id"] not in seen and "事故" in row["document_type"] and len(seen) < 4:
                seen.append(row["doc_id"])
                readings.add((name, len(seen), row["doc_id"], row["chunk_id"], plain_excerpt(row["text"], [], 220)))
    assert {tuple(r) for r in got.collect()} == wanted and got.count() == len(wanted)
    pages = frame.select("doc_id").distinct().select("doc_id", F.concat(F.lit("p-"), "doc_id").alias("page"))
    assert {tuple(r) for r in catalogue.page_links(named, frame, pages).collect()} == links
    assert {tuple(r) for r in catalogue.accident_readings(named, frame).collect()} == readings

    by_doc = set()
    for doc in {c["doc_id"] for c in chunks}:
        rows = sorted((c for c in chunks if c["doc_id"] == doc), key=lambda r: (int(r["page_start"] or 0), r["chunk_id"]))
        for section, (keys, limit) in catalogue.DOCUMENT_SECTIONS.items():
            by_doc |= {(doc, section, n, chunk, text) for n, (chunk, text) in enumerate(plain_choose(rows, keys, limit, []), 1)}
    assert {tuple(r) for r in catalogue.document_pages(frame).collect()} == by_doc
