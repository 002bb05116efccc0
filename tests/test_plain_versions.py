"""Queries that SQL does not state, whole, against plain versions."""

import hashlib
import re
import struct
from collections import defaultdict

import xxhash

from quillspar.functions import parsing
from quillspar.operators import linkage, routes


def titles(spark, small):
    groups = defaultdict(set)
    for row in spark.read.parquet(f"{small}/part.parquet").select("p_type", "p_name").collect():
        groups[row.p_type].add(row.p_name)
    for kind, names in groups.items():
        ids = {f"{kind}:{name}": name for name in names}
        yield ids, {rid: name[:-1] for rid, name in ids.items()}


def test_top_three(spark, small):
    wanted = set()
    for left, right in titles(spark, small):
        for one, title in left.items():
            scored = sorted((-round(linkage.title_ratio(title, other), 4), rid) for rid, other in right.items())
            wanted |= {(one, rank, rid, -score) for rank, (score, rid) in enumerate(scored[:3], 1) if -score >= 1}
    got = linkage.j12_top_three(spark, small).collect()
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted


def test_best_title(spark, small):
    wanted = set()
    for left, right in titles(spark, small):
        for one, title in left.items():
            score, rid = max((round(linkage.indel_ratio(title, other), 4), rid) for rid, other in right.items())
            if score >= 70:
                wanted.add((one, rid, score))
    got = routes.j13_best_title(spark, small).collect()
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted


def test_quiz_sample(spark, small):
    """The ten customers of a nation whose number has the smallest hash, seed 7 after it."""
    drawn = defaultdict(list)
    for row in spark.read.parquet(f"{small}/customer.parquet").collect():
        first = xxhash.xxh64(struct.pack("<q", row.c_custkey), seed=42).intdigest()
        number = xxhash.xxh64(struct.pack("<i", 7), seed=first).intdigest()
        drawn[row.c_nationkey].append((number - (number >> 63 << 64), row.c_custkey))
    wanted = {(nation, place, key) for nation, keys in drawn.items() for place, (_, key) in enumerate(sorted(keys)[:10], 1)}
    assert {tuple(r) for r in routes.k33_quiz_sample(spark, small).collect()} == wanted


def plain_chunks(text, size=1200):
    """Line by line: a heading starts a clause; clauses are joined while they fit and cut where one alone does not."""
    clauses, held = [], []
    for line in (text or "").split("\n"):
        if re.match(r"第[一二三四五六七八九十百零\d]+[章条]|\d+(?:\.\d+)*\s", line + "\n") and held:
            clauses.append("\n".join(held))
            held = []
        held.append(line)
    clauses.append("\n".join(held))
    out, room = [], 0
    for clause in filter(None, map(str.strip, clauses)):
        if out and len(clause) < room:
            out[-1] += "\n" + clause
            room -= len(clause) + 1
        else:
            while clause:
                out.append(clause[:size])
                clause = clause[size:]
            room = size - len(out[-1])
    return out


def test_clause_chunks(spark, small):
    wanted = set()
    for row in spark.read.parquet(f"{small}/documents.parquet").collect():
        wanted |= {(row.doc_id, n, len(c), hashlib.md5(c.encode()).hexdigest()) for n, c in enumerate(plain_chunks(row.text))}
    got = parsing.x12_clause_chunks(spark, small).collect()
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)
    text = "前言\n第一条 " + "甲" * 700 + "\n1.2 " + "乙" * 600 + "\n第二章\n" + "丙" * 2500 + "\n3 end"
    frame = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    assert [r[0] for r in frame.select(parsing.clause_chunks("t")).collect()] == [plain_chunks(text), [], []]
