"""Secrets, licences, benchmark passages and toxicity."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspar.llm import credentials, decontamination, license_rules, toxicity
from quillspar.llm.common import Scratch

BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def plain_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return [f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


TEXTS = [
    None, "", "token=abc secret:token:abcdefgh", "é😀 PassWord = 'hunter22'", "AKIA" + "A" * 16 + " AKIAAKIA" + "0" * 3, "x" + "0123456789abcdef" * 3 + "g", "apikey:api_key=abcdef" * 50,
    "api-key: " + "a" * 23, "token " * 1000 + "token=" + "z" * 50_000, "AKIA" + "B" * 30, " ".join("f" * 24 for _ in range(500)),
]


def test_base_spans(spark):
    rng = random.Random(2)
    pieces = ["token", "secret", "=", ":", " ", '"', "abcdef", "AKIA", "A0" * 9, "0a" * 13, "é", "\n", "api_key"]
    texts = TEXTS + ["".join(rng.choices(pieces, k=rng.randrange(1, 25))) for _ in range(200)]
    rows = [(n, t, "clash") for n, t in enumerate(texts)] + [(2, texts[2], "x"), (None, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = credentials.scan(Scratch(spark, "t"), docs).collect()
    assert len(got) == len(rows)
    for row in got:
        wanted = plain_spans(texts[3 if row.doc_id is None else row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(w.startswith(k) for w in wanted) for k in ("assign", "access", "hex")]
        assert [s for s in row.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == wanted
    assert credentials.scan(Scratch(spark, "t"), docs.limit(0)).count() == 0


def test_weak_parts_need_a_partner(spark):
    key = "aB3dE6gH9jK2mN5pQ8rS1tU4vW7xY0zA"
    texts = [f"client_id=svc-1 {key}", key, "client_id=svc-1", f"client_id=svc-1 {'x ' * 200}{key}", "https://db.example.com:5432/x password=hunter22", "https://db.example.com/x", f"token={key}"]
    got = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in credentials.scan(Scratch(spark, "t"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ["id", "mixed"], 1: [], 2: [], 3: [], 4: ["endpoint", "assign"], 5: [], 6: ["assign"]}


def test_licences(spark):
    bsd = [license_rules.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")]
    rows = [
        (1, "Text.\nReleased under the MIT License.\nmore"), (2, "Licensed under CC BY-NC 4.0."), (3, ". ".join(bsd) + "."), (4, "\n".join(bsd + [license_rules.SENTENCES["bsd-names"]])), (5, None), (6, ""), (6, ""),
        (7, "under no licence at all"), (8, "permission is hereby granted to no one"), (9, license_rules.SENTENCES["as-is"]), (10, "SPDX-License-Identifier: Apache-2.0\nx" + " y" * 100_000),
    ]
    got = Counter((r.doc_id, r.licences) for r in license_rules.scan(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id int, text string, licences int")).collect())
    wanted = [(1, "MIT"), (2, "CC-BY-NC-4.0"), (3, "BSD-2-Clause"), (4, "BSD-3-Clause"), (5, ""), (6, ""), (6, ""), (7, ""), (8, ""), (9, "unknown-notice"), (10, "Apache-2.0")]
    assert got == Counter(wanted)


def test_every_known_sentence_is_found_in_its_place():
    assert all(any(cue in text for cue in license_rules.CUES) for text in license_rules.KNOWN)
    for text, name in license_rules.KNOWN.items():
        lead = "Some words here.\n"
        assert license_rules.sentences(f"{lead}{text.capitalize()}.\nAnd more.") [0][0::2] == (len(lead), name)


def test_known_sentences_are_found_wherever_they_are_wrapped():
    for text, name in license_rules.KNOWN.items():
        if name.startswith("ref:") and not text.startswith(("licensed under the", "spdx")):
            continue
        words = text.capitalize().split()
        for at in range(1, len(words)):
            for around in ("{}", "A heading\n{}", "Copyright 2020 X. {}.\nMore words", "x\n\n# {}:\ny"):
                whole = around.format(" ".join(words[:at]) + "\n   # " + " ".join(words[at:]))
                assert [found[2] for found in license_rules.sentences(whole)] == [name], whole


@pytest.mark.parametrize(
    "text, licence",
    [
        ("This work is dedicated to the public\ndomain.", "public-domain"), ("All rights\nreserved.", "all-rights-reserved"),
        ("To the extent possible under law, the author has waived\nall copyright and related or neighboring rights\nto this work", "CC0-1.0"),
        ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in\ncompliance with the License.', "Apache-2.0"),
        ("İ MIT License\n\nCopyright (c) 2020 X\n\n" + license_rules.SENTENCES["mit-grant"].replace(" of ", "\nof ") + ":", "MIT"),
        ("nobody has all rights reserved here", ""), ("the public domain", ""),
    ],
)
def test_licences_of_wrapped_notices(text, licence):
    found = license_rules.sentences(text)
    assert ",".join(sorted({name for _, _, name in license_rules.apply_rules(found, text)} - {"unknown-notice"})) == licence


def plain_licences(text):
    """Every line and every run between stops is compared with every known sentence; rules try all places one by one."""
    cuts = {0, len(text)} | {k + 1 for k in range(len(text)) if text[k] == "\n"}
    stops = {0, len(text)} | {k + 1 for k in range(len(text)) if text[k] in ".!?;" and text[k + 1 : k + 2].isspace()}
    found = {}
    for bounds in (sorted(cuts), sorted(stops)):
        for a, b in zip(bounds, bounds[1:]):
            piece = text[a:b]
            words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in piece.lower()).split()
            for known, name in license_rules.KNOWN.items():
                if known.split() == words:
                    place = a + len(piece) - len(piece.lstrip())
                    found[place] = max(found.get(place, (0, "")), (b - (bounds == sorted(cuts) and piece.endswith("\n")), name))
    rows = []
    for a, (b, name) in sorted(found.items()):
        if not rows or a >= rows[-1][1]:
            rows.append((a, b, name))
    used, out = set(), []
    for licence, sequence in license_rules.RULES:
        for first, (_, _, name) in enumerate(rows):
            taken = [first]
            if first in used or name != sequence[0]:
                continue
            for wanted in sequence[1:]:
                later = [k for k in range(taken[-1] + 1, len(rows)) if k not in used and rows[k][2] == wanted]
                if later and license_rules.between(text, rows[taken[-1]][1], rows[later[0]][0]) <= license_rules.GAP:
                    taken.append(later[0])
            if [rows[k][2] for k in taken] == list(sequence):
                used.update(taken)
                out.append(licence)
    return ",".join(sorted({*out, *(["unknown-notice"] if len(used) < len(rows) else [])}))


def test_licences_equal_a_naive_matcher(spark):
    rng = random.Random(12)
    known = list(license_rules.SENTENCES.values())
    texts = []
    for _ in range(150):
        _, sequence = rng.choice([r for r in license_rules.RULES if not any(x.startswith("ref:") for x in r[1])])
        lines = [license_rules.SENTENCES[x].capitalize() + "." for x in sequence]
        for _ in range(rng.randrange(4)):
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["Some other words here.", rng.choice(known), "Licensed under the MIT License.", "# * //"]))
        texts.append(rng.choice(["\n", " ", "\n\n"]).join(lines))
    marks = "/*" + "*" * 5000 + "\n"
    texts += [None, "", "Released under the Apache License, Version 2.0", "*" * 5000 + license_rules.SENTENCES["mit-grant"] + "*" * 5000, marks + known[0]]
    rows = [(n if n else None, text, "x") for n, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    got = {r.doc_id: r.licences for r in license_rules.scan(docs).collect()}
    assert got == {i: plain_licences(text or "") for i, text, _ in rows}
    assert got[153] == "MIT" and license_rules.scan(docs.limit(0)).count() == 0


def plain_passages(text, items):
    words = decontamination.words_of(text or "")[1]
    found = decontamination.shingle_hashes(words, 5)
    out = set()
    for item, (size, weight) in items.items():
        m = min(size, len(words))
        for start in range(len(words) - m + 1 if len(words) else 0):
            mine = Counter(decontamination.shingle_hashes(words[start : start + m], 5).tolist())
            shared = sum((mine & weight).values())
            if shared / (mine.total() + weight.total() - shared) >= 0.75:
                out.add(item)
                break
    assert len(found) or not len(words)
    return out


def test_passages_against_all_windows(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    passage = lambda n: rng.choices(vocabulary, k=n)
    items = {k: passage(n) for k, n in enumerate([3, 5, 8, 20, 20, 40, 60, 120])}
    items[100] = ["the"] * 12
    docs = [(None, None), (1, ""), (2, "only"), (3, " ".join(items[3])), (4, "the " * 3000), (5, " ".join(items[0])), (6, " ".join(passage(30000)))]
    for n in range(10, 120):
        item = list(items[rng.choice(list(items))])
        for _ in range(rng.randrange(0, 4)):
            action, at = rng.choice("rid"), rng.randrange(len(item))
            item = item[:at] + {"r": ["new"], "i": ["new", item[at]], "d": []}[action] + item[at + 1 :]
        docs.append((n, " ".join([*passage(rng.randrange(0, 60)), *item, *passage(rng.randrange(0, 60))]).upper() + "!"))
    docs.append((3, docs[3][1]))
    prepared = {}
    for k, words in items.items():
        hashes = decontamination.words_of(" ".join(words))[1]
        prepared[k] = (len(hashes), Counter(decontamination.shingle_hashes(hashes, 5).tolist()))
    wanted = Counter((i, k) for i, t in docs for k in plain_passages(t, prepared))
    benchmark = spark.createDataFrame([(k, ", ".join(words), 1) for k, words in items.items()] + [(200, None, 1), (201, " !", 1)], "item_id int, text string, doc_id int")
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id int, text string, item_id int")
    for limit in (1 << 24, 300):
        monkeypatch.setattr(decontamination, "SLICE", limit)
        monkeypatch.setattr(decontamination.slices, "__defaults__", (limit,))
        got = Counter((r.doc_id, r.item_id) for r in decontamination.find_passages(frame, benchmark).collect())
        assert got == wanted
    kept = Counter(r.doc_id for r in decontamination.keep_uncontaminated(frame, benchmark).collect())
    assert kept == Counter(i for i, t in docs if not plain_passages(t, prepared))
    assert decontamination.find_passages(frame, benchmark.limit(0)).count() == 0


def test_passages_at_the_threshold_are_within_the_radius():
    rng = np.random.default_rng(11)
    similar = found = 0
    for size in (32, 60, 102):
        for _ in range(400):
            item = [f"w{k}" for k in rng.integers(0, 10**9, size)]
            cut = (size - 4) // 7
            window = item[: size - cut] + [f"v{k}" for k in rng.integers(0, 10**9, cut)]
            shared, all_ = size - 4 - cut, size - 4 + cut
            if shared < 0.75 * all_:
                continue
            similar += 1
            found += bool(decontamination.Index([(1, " ".join(item))]).matches(decontamination.words_of(" ".join(window))[1]))
    assert similar == 1200 and found >= 0.999 * similar


def test_blocks_find_all_prints_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 50, dtype=np.uint64)
    table = decontamination.Length.of(list(range(50)), prints.tolist())
    for item in range(50):
        for distance in range(decontamination.RADIUS + 1):
            flipped = prints[item] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, distance, replace=False)))
            assert (0, item, distance) in set(zip(*(x.tolist() for x in table.lookup(np.array([flipped]))), strict=True))


def test_an_index_of_many_items_stays_small(monkeypatch):
    monkeypatch.setattr(decontamination, "PAIRS", 1 << 16)
    rng = np.random.default_rng(4)
    table = decontamination.Length.of(list(range(50_000)), rng.integers(0, 2**63, 50_000, dtype=np.uint64).tolist())
    assert sum(x.nbytes for x in (table.items, table.prints, table.order, table.bounds)) < 60 * 50_000
    asked = rng.integers(0, 2**63, 20, dtype=np.uint64)
    got = set(zip(*(x.tolist() for x in table.lookup(asked)), strict=True))
    distance = np.bitwise_count(asked[:, None] ^ table.prints[None, :])
    assert got == {(w, i, int(distance[w, i])) for w, i in zip(*np.nonzero(distance <= decontamination.RADIUS), strict=True)}


def test_toxicity_learns_and_handles_odd_rows(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    rows, labels = [], []
    for n in range(600):
        toxic = n % 4 == 0
        text = rng.choices(words, k=40)
        if toxic:
            text[rng.randrange(40)] = rng.choice(["nasty", "vile"])
        rows.append((n, " ".join(text), 0.5))
        labels.append((n, int(toxic), "x"))
    rows += [(1000, None, 0.0), (1001, "", 0.0), (None, "vile", 0.0), (5, rows[5][1], 0.0), (1002, "fine " * 50_000 + "vile nasty", 0.0)]
    labels += [(3, None, "x"), (None, 1, "x"), (7, 0, "x")]
    docs, marks = spark.createDataFrame(rows, "doc_id int, text string, score double"), spark.createDataFrame(labels, "doc_id int, toxic int, text string")
    model = toxicity.fit(docs, marks)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) >= 0.95
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score < 0.5 and by[None].held_out is False and by[None].predicted == 1
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


@pytest.mark.parametrize(("label", "score"), [(0, 0.0), (1, 1.0)])
def test_one_class_gives_its_share(spark, label, score):
    docs = spark.createDataFrame([(n, f"text {n}") for n in range(20)], "doc_id long, text string")
    marks = spark.createDataFrame([(n, label) for n in range(20)], "doc_id long, toxic int")
    assert toxicity.score_documents(docs, toxicity.fit(docs, marks)).first().score == pytest.approx(score, abs=1e-6)
    assert toxicity.score_documents(docs, toxicity.fit(docs, marks.limit(0))).first().score == pytest.approx(0, abs=1e-6)


def test_fit_and_scores_equal_a_dense_version(spark):
    """Counts, ratios and selection recomputed with plain Python; the fit by plain gradient steps on a dense matrix."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdef", k=4)) for _ in range(60)]
    texts = {n: " ".join(rng.choices(words, k=25) + (["badword"] if n % 3 == 0 else [])) for n in range(240)}
    settings = toxicity.Settings(orders=(3, 4), rounds=4000, ridge=0.05)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(n, int(n % 3 == 0)) for n in texts], "doc_id long, toxic int"), settings=settings)
    train = [n for n in texts if zlib.crc32(str(n).encode()) % 5]
    sets = {n: set(np.concatenate(list(toxicity.grams(texts[n], settings))).tolist()) for n in texts}
    toxic, clean = [n for n in train if n % 3 == 0], [n for n in train if n % 3]
    ratio = {}
    for f in set().union(*(sets[n] for n in train)):
        a, b = (sum(f in sets[n] for n in side) for side in (toxic, clean))
        share = (a + b + 1) / (len(train) + 2)
        z = abs(a / len(toxic) - b / len(clean)) / (share * (1 - share) * (1 / len(toxic) + 1 / len(clean))) ** 0.5
        if z >= settings.least_z:
            ratio[f] = np.log((a + 0.5) / (len(toxic) + 1)) - np.log((b + 0.5) / (len(clean) + 1))
    order = sorted(ratio)
    dense = np.array([[ratio[f] * (f in sets[n]) for f in order] for n in train])
    truth = np.array([float(n % 3 == 0) for n in train])
    each = np.where(truth > 0, truth.sum() ** -0.5, (1 - truth).sum() ** -0.5)
    each /= each.sum()
    weights, bias = np.zeros(len(order)), np.log(truth.mean() / (1 - truth.mean()))
    for _ in range(60_000):
        error = each * (1 / (1 + np.exp(-(dense @ weights + bias))) - truth)
        weights, bias = weights - 0.02 * (dense.T @ error + settings.ridge * weights), bias - 0.02 * error.sum()
    for n in texts:
        wanted = 1 / (1 + np.exp(-(sum(w * ratio[f] for f, w in zip(order, weights, strict=True) if f in sets[n]) + bias)))
        assert abs(model.score(texts[n]) - wanted) < 0.01
