"""Gates against plain versions that go through rows one by one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspar.operators import gates


def plain_section(s, high_risk):
    content, blocks, evidence = (s["content"] or "").strip(), s["blocks"] or [], s["evidence"] or []
    if s["applicable"] is False:
        return [] if s["skip_reason"] else ["skipped_without_reason"]
    if not content:
        return ["empty"]
    out, known = [], {e["evidence_id"] for e in evidence}
    numbers = [int(n) for n in re.findall(gates.CITATION, content)]
    if re.search("[\x00-\x08\x0b\x0c\x0e-\x1f�]", content):
        out.append("control_characters")
    if content.count("```") % 2:
        out.append("open_fence")
    if any(n < 1 or n > len(evidence) for n in numbers):
        out.append("citation_out_of_range")
    if not blocks:
        out.append("no_blocks")
    bound = set()
    for b in blocks:
        ids, refs = b["ids"] or [], b["refs"] or []
        if b["source"] not in gates.SOURCES:
            out.append("unknown_source")
        if b["source"] == "grounded" and not (ids or refs):
            out.append("grounded_without_reference")
        if b["source"] in ("model_prior", "external") and (ids or refs):
            out.append({"model_prior": "prior_with_reference", "external": "external_with_reference"}[b["source"]])
        if any(r not in known for r in refs):
            out.append("unknown_reference")
        for n in ids:
            if n is None or not 1 <= n <= len(evidence):
                out.append("block_out_of_range")
            else:
                bound.add(n)
        if not (b["text"] or "").strip() or b["text"].strip() not in content:
            out.append("block_not_in_content")
        if s["section"] in high_risk and b["source"] != "grounded":
            out.append("high_risk_unsupported")
    if set(numbers) - bound:
        out.append("citation_unbound")
    if any((evidence[n - 1]["status"] or "").lower() in gates.WITHDRAWN for n in bound):
        out.append("withdrawn_source")
    if s["validated"] is False:
        out.append("not_validated")
    if s["status"] in gates.UNDONE:
        out.append("not_done")
    return sorted(set(out))


SCHEMA = """page int, revision int, section string, content string, content_hash string, applicable boolean, skip_reason string, status string, validated boolean,
    blocks array<struct<source: string, ids: array<int>, refs: array<string>, text: string>>, evidence array<struct<evidence_id: string, status: string>>"""


def random_sections(rnd):
    pick = lambda *values: rnd.choice(values)
    rows = []
    for page in range(250):
        for n in range(rnd.randrange(4)):
            text = pick("Plain words", "Cites [Wiki证据1]", "Cites [Wiki证据2] and [Wiki证据9]", "Open ``` fence", "Closed ``` a ``` b", "bad \x07 sign", "")
            evidence = [{"evidence_id": f"e{k}", "status": pick("active", None, "Repealed", "废止")} for k in range(rnd.randrange(4))]
            blocks = [
                {"source": pick(*gates.SOURCES, "guess", None), "ids": pick(None, [], [1], [2, 1], [None], [7]), "refs": pick(None, [], ["e0"], ["zz"]), "text": pick(text, "Plain", " ", None, "other")}
                for _ in range(rnd.randrange(3))
            ]
            clean = rnd.random() < 0.5
            if clean:
                text, evidence, blocks = "Plain words", [{"evidence_id": "e0", "status": None}], [{"source": "grounded", "ids": [1], "refs": ["e0"], "text": "Plain"}]
            rows.append({
                "page": page, "revision": 1, "section": pick("storage", "use", f"s{n}"), "content": pick(text, text, text, None), "content_hash": pick("h1", "h2"), "applicable": pick(None, True, True, False),
                "skip_reason": pick(None, "", "why"), "status": pick(None, "done", "failed"), "validated": pick(None, True, True, False), "blocks": pick(blocks, blocks, None) if rnd.random() < 0.2 else blocks, "evidence": evidence or pick(None, []),
            })
            if clean:
                rows[-1] |= {"section": f"s{n}", "content": text, "applicable": True, "status": None, "validated": None, "blocks": blocks}
    return rows


def test_section_errors_and_the_gate(spark):
    rnd = random.Random(8)
    rows = random_sections(rnd)
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).withColumn("n", F.monotonically_increasing_id()).cache()
    order = sorted(frame.collect(), key=lambda r: r.n)
    got = {r.n: r.errors for r in gates.section_errors(frame, ["storage"]).collect()}
    wanted = {row.n: plain_section(row.asDict(recursive=True), ["storage"]) for row in order}
    assert {n: sorted(e) for n, e in got.items()} == wanted and all(len(set(e)) == len(e) for e in got.values())
    assert len({e for errors in wanted.values() for e in errors}) == 18

    reviews = [(r.page, 1, r.section, rnd.choice(["approved", "modified", "rejected", "approved"]), rnd.choice([r.content_hash, r.content_hash, "old"]), seq) for seq in range(2) for r in order if rnd.random() < 0.9]
    pages = [(page, 1, rnd.choice([1, 1, 1, 2, None]), rnd.choice(["fresh", "fresh", "fresh", "stale", None])) for page in range(250)]
    out = gates.publishable(
        spark.createDataFrame(pages, "page int, revision int, draft int, freshness string"), frame.drop("n"),
        spark.createDataFrame(reviews, "page int, revision int, section string, decision string, content_hash string, seq int"), ["storage"],
    )
    last = {}
    for page, _, section, decision, seen, seq in sorted(reviews, key=lambda r: r[5]):
        last.setdefault((page, section), {})[seq] = (decision, seen)
    unsure = {(p, s) for p, s in last if len([r for r in reviews if (r[0], r[2]) == (p, s) and r[5] == max(last[p, s])]) > 1}  # equal seq twice, as sections repeat
    found = {r.page: r for r in out.collect()}
    assert len(found) == 250
    for page, _, draft, freshness in pages:
        own = [r for r in order if r.page == page]
        if any((page, r.section) in unsure for r in own):
            continue
        reasons = set(["not_the_draft"] if draft != 1 else []) | set(["not_fresh"] if freshness != "fresh" else []) | set([] if own else ["no_sections"])
        for r in own:
            decision, seen = last.get((page, r.section), {}).get(max(last.get((page, r.section), {0: 0})), (None, None)) if (page, r.section) in last else (None, None)
            states = list(wanted[r.n])
            if decision not in ("approved", "modified"):
                states.append("not_approved")
            elif seen != r.content_hash:
                states.append("changed_since_review")
            if sum(x.section == r.section for x in own) > 1:
                states.append("repeated")
            reasons |= {f"{r.section}: {s}" for s in states}
        assert found[page].reasons == sorted(reasons) and found[page].publishable == (not reasons)
    assert any(r.publishable for r in found.values())


def plain_reason(hit, targets, intents, least):
    norm = lambda t: re.sub(r"\s+", "", (t or "").lower())
    text = hit["text"] or ""
    if not text:
        return "empty", None
    if len(text.strip()) < gates.LEAST:
        return "short", None
    if (hit["quality"] or "").lower() in gates.BAD_TAGS:
        return "quality:" + hit["quality"].lower(), None
    if least is not None and hit["score"] is not None and hit["score"] < least:
        return f"score:{hit['score']:.4f}", None
    whole = norm("\n".join([hit["title"] or "", hit["code"] or "", text]))
    if targets and not any(norm(a) in whole for names in targets.values() for a in names):
        return "entity:" + ",".join(targets), None
    told = []
    for name, rule in intents.items():
        score = 2 * sum(norm(w) in norm(text) for w in rule.strong) + sum(norm(w) in norm(text) for w in rule.weak)
        told.append(f"{name}={score}")
        if score >= rule.threshold and (not rule.required or any(norm(w) in norm(text) for w in rule.required)):
            return "accepted", name
    return ("intent:" + ",".join(told), None) if intents else ("accepted", None)


@pytest.mark.parametrize("least", [None, 0.5])
def test_evidence_gate(spark, least):
    rnd = random.Random(4)
    words = ["chlor ine", "CHLORINE", "valve", "Mask", "wear a", "leak", "stop the leak", "x" * 25, "store it"]
    hits = [(rnd.choice([None, "About chlorine", "t"]), rnd.choice([None, "GB 1"]), rnd.choice([None, "", "short", *[" ".join(rnd.choices(words, k=6)) for _ in range(9)]]), rnd.choice([None, "ok", "Failed"]), rnd.choice([None, 0.1, 0.9])) for _ in range(300)]
    frame = spark.createDataFrame([(n, *h) for n, h in enumerate(hits)], "n int, title string, code string, text string, quality string, score double")
    targets = {"chlorine": ("chlorine", "Cl2"), "valve": ("VALVE",)}
    intents = {"protection": gates.Intent(("mask",), ("wear",), ("wear a",)), "emergency": gates.Intent(("stop the leak",), ("leak", "valve")), "none": gates.Intent(("zzz",))}
    for some, asked in ((targets, intents), ({}, intents), (targets, {})):
        rows = gates.validate_evidence(frame, some, asked, least).collect()
        wanted = [plain_reason(dict(zip(("title", "code", "text", "quality", "score"), h)), some, asked, least) for h in hits]
        assert [(r.reason, r.matched_intent) for r in sorted(rows, key=lambda r: r.n)] == wanted


@pytest.mark.parametrize(
    "name, standard, regulation, attachment",
    [
        ("SN_T 2414.1-2010.pdf", "SNT2414.12010", None, None), ("DB11_T 1578-2025.PDF", "DB11T15782025", None, None), ("AQ 3011-2007.pdf", "AQ30112007", None, None), ("DB11_ 358-2016.pdf", "DB113582016", None, None),
        ("gb/T 1—2010", None, None, None), ("GB/T 13690–2009 x", "GBT136902009", None, None), ("国务院令第591号.pdf", None, "国务院令第591号", None), ("安监总管三〔2011〕95号", None, "安监总管三〔2011〕95号", None),
        ("x_00ab12CD34ef5678_y.pdf", None, None, "00AB12CD34EF5678"), ("应急管理部公告2020年第3号", None, "应急管理部公告2020年第3号", None), ("", None, None, None), (None, None, None, None),
    ],
)
def test_numbers_in_names(spark, name, standard, regulation, attachment):
    row = spark.createDataFrame([(name,)], "n string").select(gates.file_standard(F.col("n")).alias("s"), gates.file_regulation(F.col("n")).alias("r"), gates.file_attachment(F.col("n")).alias("a")).first()
    assert tuple(row) == (standard, regulation, attachment)


def test_keys(spark):
    rows = [("STD_AQ_4104_2025", "AQ41042025"), ("STD_SY_T_5857_2025", "SYT58572025"), ("STD_X_1", None), ("REG_1_2_3", None), (None, None)]
    frame = spark.createDataFrame([(a,) for a, _ in rows], "i string")
    assert [r[0] for r in frame.select(gates.id_standard(F.col("i"))).collect()] == [b for _, b in rows]
    codes = spark.createDataFrame([(" DB11/T 1578—2025 ", " 安监 ﹝2011﹞ 1号"), ("", "〔1〕"), (None, None)], "a string, b string")
    assert [tuple(r) for r in codes.select(gates.standard_key(F.col("a")), gates.regulation_key(F.col("b"))).collect()] == [("DB11T15782025", "安监[2011]1号"), (None, "[1]"), (None, None)]
