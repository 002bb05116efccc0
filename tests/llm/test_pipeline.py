"""The pipeline on a small table with odd rows, against a plain version of every stage."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_near_duplicates import plain_set
from test_scans import plain_passages
from tokenizers import Tokenizer

import corpus_pipeline
from quillspar.llm import decontamination, mixing, token_store, toxicity


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    """Documents, labels and benchmark, with nulls, empty and repeated rows, a long text, and columns whose names the stages use inside."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs += [
        (None, "A text without an id, of its own.", None, None), (9001, None, "en", "s"), (9002, "", " ", "s"), (9003, "word " * 60_000, "en", None), (9004, "Once said, twice kept.", "en", "s"), (9004, "Once said, twice kept.", "en", "s"),
        (9005, docs[0][1] + " x", "en", "s"), (9006, f"Before it. {items[3][1]} After it.", "de", "s"), (9007, "ordinary words " * 9 + items[5][1].upper(), "de", "s"),
    ]
    schema = "doc_id long, text string, lang string, source string, k int, row string, component_id long, draw double, found string, vec string, tokens string"
    spark.createDataFrame([(*d, 1, "r", 7, 0.5, "f", "v", "t") for d in docs], schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{small}/labels.parquet").collect()]
    spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*items, (None, None), (777, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def without_duplicates(rows):
    sets = [plain_set(r.text) for r in rows]
    owners = defaultdict(list)
    for n, found in enumerate(sets):
        for shingle in found:
            owners[shingle].append(n)
    parent = {r.doc_id: r.doc_id for r in rows if r.doc_id is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, found in enumerate(sets):
        for m, shared in Counter(m for s in found for m in owners[s] if m < n).items():
            if rows[n].doc_id is not None and rows[m].doc_id is not None and 100 * shared >= 75 * (len(found) + len(sets[m]) - shared):
                a, b = sorted((find(rows[n].doc_id), find(rows[m].doc_id)))
                parent[b] = a
    return [r for r in rows if r.doc_id is None or find(r.doc_id) == r.doc_id]


def without_passages(rows, items):
    prepared = {}
    for k, text in items:
        words = decontamination.words_of(text or "")[1]
        if len(words):
            prepared[k] = (len(words), Counter(decontamination.shingle_hashes(words, 5).tolist()))
    kept = []
    for r in rows:
        mine = set(decontamination.shingle_hashes(decontamination.words_of(r.text or "")[1], 5).tolist())
        near = {k: v for k, v in prepared.items() if mine & set(v[1])}
        if not (near and plain_passages(r.text, near)):
            kept.append(r)
    return kept


def mixed(rows):
    def value(text):
        return text if text and text.strip(" ") else "unknown"

    def topic(text):
        return next((name for name, pattern in mixing.TOPICS if re.search(pattern, text)), "prose")

    margins = [(value(r.source), value(r.lang), topic(r.text or "")) for r in rows]
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    tokens = Counter()
    for m, n in zip(margins, sizes, strict=True):
        tokens[m] += n
    cells = sorted(tokens)
    own = np.array([tokens[c] for c in cells], float)
    weight, targets = mixing.KEEP * own, []
    for at in range(3):
        by = {v: own[[c[at] == v for c in cells]].sum() for v in {c[at] for c in cells}}
        share = {v: t**mixing.TEMPER if t else 0.0 for v, t in by.items()}
        wanted = {v: s / sum(share.values()) * mixing.KEEP * own.sum() for v, s in share.items()}
        low, high = 0.0, 1e9
        for _ in range(300):
            middle = (low + high) / 2
            short = sum(min(mixing.SLACK * by[v], middle * wanted[v]) for v in by) < mixing.KEEP * own.sum()
            low, high = (middle, high) if short else (low, middle)
        targets.append({v: min(mixing.SLACK * by[v], low * wanted[v]) for v in by})
    for _ in range(300):
        for at in range(3):
            for v, target in targets[at].items():
                mine = np.array([c[at] == v for c in cells])
                if weight[mine].sum() > 0:
                    weight[mine] = np.minimum(own[mine], weight[mine] * target / weight[mine].sum())
    chance = {c: w / n if n else 0.0 for c, w, n in zip(cells, weight, own, strict=True)}
    draw = [int(hashlib.md5(f"{(r.text or '') if r.doc_id is None else r.doc_id}:mix".encode()).hexdigest()[:12], 16) / 16**12 for r in rows]
    return [r for r, m, d in zip(rows, margins, draw, strict=True) if d < chance[m]]


def test_stages_equal_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    plain = [
        lambda rows: [r for r in rows if model.score(r.text or "") < 0.5],
        without_duplicates,
        lambda rows: without_passages(rows, items),
        mixed,
    ]
    rows = docs.collect()
    for (_, stage), version in zip(corpus_pipeline.STAGES[:4], plain, strict=True):
        wanted = Counter(version(rows))
        made = stage(spark, spark.createDataFrame(rows, docs.schema).repartition(3), folder)
        assert made.columns == docs.columns
        rows = made.collect()
        assert Counter(rows) == wanted
    tokenizer = Tokenizer.from_str(token_store.tokenizer_file())
    start, wanted = 0, Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, token_store.END_ID], "<u4")
        wanted[r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == wanted


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
