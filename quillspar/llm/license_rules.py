"""Licence scan by sentence rules.

Known licence sentences have identifiers; a text's sentences are normalised
(lower case, runs of other signs than letters and digits to one space) and
mapped to them by exact lookup. Rules are sequences of identifiers, longest
first: a rule holds where its sentences occur in order with at most GAP other
sentences between two of them, and takes the sentences it used, so that a
reference inside a longer notice is not reported again.

Sentences begin and end at line ends or stops, so notices wrapped over lines, under
headings or before lines without a stop are found as well. Texts without any cue of
the known sentences are not split: each known sentence holds a cue, which is looked
for in the normalised text, so nothing is missed.

Defined results: null and empty texts hold no licence; an empty table gives no rows;
sentences that no rule
uses are reported as ``unknown-notice``, once a text; repeated rows are scanned
and returned once each; null ids are kept; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspar.llm.common import small_batches, table

GAP = 3

#: Names of licences as references give them, by identifier.
NAMES = {
    "MIT": ("mit license", "mit licence", "expat license"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache software license version 2 0"),
    "GPL-2.0": ("gnu general public license version 2", "gnu gpl version 2", "gpl v2", "gplv2"),
    "GPL-3.0": ("gnu general public license version 3", "gnu gpl version 3", "gpl v3", "gplv3"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "lgpl v2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl v3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "agpl v3"),
    "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license", "2 clause bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license", "3 clause bsd license", "bsd license"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0"),
    "ISC": ("isc license",),
    "CC0-1.0": ("cc0 1 0", "creative commons zero v1 0 universal"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
}
#: What stands before a name in a reference.
LEADS = (
    "licensed under", "licensed under the", "released under", "released under the", "distributed under the", "available under the", "published under",
    "this work is licensed under", "this work is licensed under the", "this work is licensed under a", "this project is licensed under the",
    "this software is licensed under the", "this software is released under the", "this program is licensed under the", "code is licensed under the",
    "license", "spdx license identifier",
)
#: Sentences of licence texts, by identifier.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "no-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "apache-terms": "see the license for the specific language governing permissions and limitations under the license",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "cc0-waive": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc-share": "share copy and redistribute the material in any medium or format",
    "cc-adapt": "adapt remix transform and build upon the material",
    "cc-attribution": "you must give appropriate credit provide a link to the license and indicate if changes were made",
    "cc-noncommercial": "you may not use the material for commercial purposes",
    "cc-sharealike": "if you remix transform or build upon the material you must distribute your contributions under the same license as the original",
    "cc-noderivatives": "if you remix transform or build upon the material you may not distribute the modified material",
    "public-domain": "this work is dedicated to the public domain",
    "all-rights": "all rights reserved",
}
#: The family of GNU licences: identifier, name, version, what is licensed.
GNU = (
    ("GPL-2.0", "gnu general public license", "2", "program"), ("GPL-3.0", "gnu general public license", "3", "program"),
    ("LGPL-2.1", "gnu lesser general public license", "2 1", "library"), ("LGPL-3.0", "gnu lesser general public license", "3", "library"),
    ("AGPL-3.0", "gnu affero general public license", "3", "program"),
)
for _id, _name, _version, _what in GNU:
    _free = f"this {_what} is free software you can redistribute it and or modify it under the terms of the {_name}"
    SENTENCES[f"free:{_id}-or-later"] = f"{_free} as published by the free software foundation either version {_version} of the license or at your option any later version"
    SENTENCES[f"free:{_id}-only"] = f"{_free} version {_version} as published by the free software foundation"
    SENTENCES[f"details:{_name}"] = f"see the {_name} for more details"
    SENTENCES[f"copy:{_name}"] = f"you should have received a copy of the {_name} along with this {_what}"
#: Rules as sequences of sentence identifiers, longer ones first; ``ref:X`` is any reference to X.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "as-is", "no-liability")),
    ("ISC", ("isc-grant", "isc-warranty", "isc-liability")),
    ("Apache-2.0", ("ref:Apache-2.0", "apache-comply", "apache-copy", "apache-basis", "apache-terms")),
    ("Apache-2.0", ("ref:Apache-2.0", "apache-comply", "apache-basis")),
    ("Apache-2.0", ("apache-comply", "apache-basis")),
    ("MPL-2.0", ("mpl-subject", "mpl-copy")),
    ("CC-BY-NC-SA-4.0", ("cc-share", "cc-adapt", "cc-attribution", "cc-noncommercial", "cc-sharealike")),
    ("CC-BY-SA-4.0", ("cc-share", "cc-adapt", "cc-attribution", "cc-sharealike")),
    ("CC-BY-NC-4.0", ("cc-share", "cc-adapt", "cc-attribution", "cc-noncommercial")),
    ("CC-BY-ND-4.0", ("cc-share", "cc-attribution", "cc-noderivatives")),
    ("CC-BY-4.0", ("cc-share", "cc-adapt", "cc-attribution")),
    *(
        rule
        for _id, _name, _, _what in GNU
        for _kind in ("or-later", "only")
        for _free, _hope in [(f"free:{_id}-{_kind}", "lgpl-hope" if _what == "library" else "gpl-hope")]
        for rule in (
            (f"{_id}-{_kind}", (_free, _hope, f"details:{_name}", f"copy:{_name}")),
            (f"{_id}-{_kind}", (_free, _hope, f"details:{_name}")),
            (f"{_id}-{_kind}", (_free, _hope)),
            (f"{_id}-{_kind}", (_free,)),
        )
    ),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("CC0-1.0", ("cc0-waive",)),
    ("public-domain", ("public-domain",)),
    ("all-rights-reserved", ("all-rights",)),
    *((name, (f"ref:{name}",)) for name in NAMES),
)


def normalise(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def known() -> dict[str, str]:
    """Identifiers by normalised sentence; references are made from leads and names."""
    out = {text: name for name, text in SENTENCES.items()}
    for name, spellings in NAMES.items():
        for spelling in (*spellings, normalise(name)):
            for lead in LEADS:
                for article in ("", "the "):
                    out[f"{lead} {article}{spelling}"] = f"ref:{name}"
                    out[f"{lead} {article}{spelling} license"] = f"ref:{name}"
                    out[f"{lead} {article}{spelling} the license"] = f"ref:{name}"  # (the "License")
    return out


KNOWN = known()


def _by_beginning() -> dict[tuple[str, ...], list[tuple[list[str], str]]]:
    """Known sentences by their first two words, the longer ones first."""
    out: dict[tuple[str, ...], list[tuple[list[str], str]]] = {}
    for text in sorted(KNOWN, key=lambda text: -len(text.split())):
        words = text.split()
        out.setdefault(tuple(words[:2]), []).append((words, KNOWN[text]))
    return out


_BEGINNINGS = _by_beginning()
#: Every known sentence, normalised, holds one of these.
CUES = ("licen", "permission", "warranty", "liable", "redistribut", "public domain", "free software", "rights reserved", "neither the name", "released under", "distributed under", "available under", "published under", "substantial portions", "liability", "waived all", "the mpl", "the material", "the possibility of", "warranties")
_WORD = re.compile(r"[a-z0-9]+")
#: What stands between two words where a sentence may begin or end: a line's end, or a stop before white space or the text's end.
_BOUND = re.compile(r"\n|[.!?;:](?:\s|\Z)")


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of the known sentences, by place; of two that begin together the longer.

    A sentence begins and ends at a line's end or a stop, not at the same kind of both, so one that is wrapped over
    lines is found under a heading and before a line without a stop alike.
    """
    lower = text.lower()
    if len(lower) != len(text):  # a few signs have longer small letters; places are those of the text
        lower = "".join(low if len(low := sign.lower()) == 1 else " " for sign in text)
    # Cues of several words are looked for as sentences are: white space and marks between them are one space.
    if not any(cue in lower for cue in CUES if " " not in cue):
        flat = " ".join(_WORD.findall(lower))
        if not any(cue in flat for cue in CUES if " " in cue):
            return []
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(lower)]
    plain = [word for _, _, word in words]
    out: list[tuple[int, int, str]] = []
    for at in range(len(words)):
        candidates = _BEGINNINGS.get(tuple(plain[at : at + 2]))
        if not candidates or out and words[at][0] < out[-1][1] or at and not _BOUND.search(lower, words[at - 1][1], words[at][0]):
            continue
        for wanted, name in candidates:
            last = at + len(wanted)
            if plain[at:last] == wanted:
                after = words[last][0] if last < len(words) else len(lower)
                if after == len(lower) or _BOUND.search(lower, words[last - 1][1], after):
                    out.append((words[at][0], words[last - 1][1], name))
                    break
    return out


def apply_rules(found: list[tuple[int, int, str]], text: str) -> list[tuple[int, int, str]]:
    """(start, end, licence) of every rule that holds, rules in their order."""
    used = [False] * len(found)
    out = []
    for licence, sequence in RULES:
        for first in range(len(found)):
            if used[first] or found[first][2] != sequence[0]:
                continue
            taken = [first]
            for wanted in sequence[1:]:
                nearest = next((k for k in range(taken[-1] + 1, len(found)) if not used[k] and found[k][2] == wanted), None)
                if nearest is None or between(text, found[taken[-1]][1], found[nearest][0]) > GAP:
                    break
                taken.append(nearest)
            if len(taken) == len(sequence):
                for k in taken:
                    used[k] = True
                out.append((found[first][0], found[taken[-1]][1], licence))
    rest = [found[k] for k in range(len(found)) if not used[k]]
    if rest:
        out.append((rest[0][0], rest[0][1], "unknown-notice"))
    return sorted(out)


def between(text: str, start: int, end: int) -> int:
    """Sentences between two places."""
    return len([piece for piece in re.split(r"[.!?;]\s|\n", text[start:end]) if normalise(piece)])


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), licences (distinct, sorted) and spans of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 8 << 20):
            count, names, spans = [], [], []
            for text in batch.column("text").to_pylist():
                found = sentences(text or "")
                held = apply_rules(found, text or "") if found else []
                count.append(len(found))
                names.append(",".join(sorted({name for _, _, name in held})))
                spans.append(",".join(f"{name}:{start}:{end}" for start, end, name in held))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(names, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_sentences", "licences", "spans"],
            )

    rows = documents.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n_sentences long, licences string, spans string")


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
