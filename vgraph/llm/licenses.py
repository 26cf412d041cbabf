"""License scans by conditional compression.

Words that no wording of a template can do without mark where to look; the stretches around them whose
wording is near a template's are candidate blocks. Each block is compressed with every template as a
raw zstandard dictionary; of those that shrink it enough, against no dictionary, the one whose wording differs least is confirmed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vgraph.llm.arrays import chunks, lean

#: Common license notices, as their publishers word them or as pages cite them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License."],
    "BSD-2-Clause OR BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0."],
    "all-rights-reserved": ["All rights reserved."],
}
#: How people and tools name licenses in short: after these words, as SPDX tags, and as titles that stand alone on a line.
GRANTS = ("available under the", "distributed under the", "released under the", "licensed under the")
NAMES = {"MIT": ["MIT License"], "Apache-2.0": ["Apache License 2.0"], "GPL-3.0": ["GNU GPL v3"], "GPL-2.0": ["GNU GPL v2"], "BSD-3-Clause": ["BSD 3-Clause License"], "BSD-2-Clause": ["BSD 2-Clause License"], "MPL-2.0": ["Mozilla Public License 2.0"]}
TAGS = {"MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later"], "GPL-2.0": ["GPL-2.0-only", "GPL-2.0-or-later"], "BSD-3-Clause": ["BSD-3-Clause"], "BSD-2-Clause": ["BSD-2-Clause"], "MPL-2.0": ["MPL-2.0"], "CC-BY-4.0": ["CC-BY-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"], "CC0-1.0": ["CC0-1.0"]}
TITLES = {"MIT": ["MIT License", "The MIT License"], "Apache-2.0": ["Apache License, Version 2.0"], "BSD-3-Clause": ["BSD 3-Clause License"], "BSD-2-Clause": ["BSD 2-Clause License"], "MPL-2.0": ["Mozilla Public License Version 2.0"]}
SHORT = {name: [f"{grant} {x}" for x in NAMES.get(name, ()) for grant in GRANTS] + [f"SPDX-License-Identifier: {x}" for x in TAGS[name]] for name in TAGS}
#: Words by which a notice is known best; its line is that of the first of these.
CUES = r"(?i)licen[sc]|copyright|rights reserved|permission is hereby|redistribut|free software|public domain"
#: A winner's block must shrink by this share, an empty text's bytes aside, and its wording may differ in this share of the template's words.
REDUCTION, DIFFERENCE = 0.3, 0.15
#: Parts of words that tell one license from another, beside those with digits, and words that deny what follows.
DEFINING = frozenset("lesser library affero noderivatives noderivs noncommercial sharealike by nc nd sa not never no except exception".split())
DENIAL = frozenset("not never no isn't aren't wasn't cannot longer nor nothing none neither formerly".split())
#: So many words before a notice are looked at for a denial, as far back as its clause goes, and so many after it for one that takes it back.
DENIED_BEFORE, DENIED_AFTER = 12, 4
#: Characters of a block whose verdict a task remembers; longer ones are judged each time.
REMEMBERED = 4000
_MARKS_BEFORE, _MARKS_AFTER = re.compile(r"[^\w\s]*$"), re.compile(r"[^\w\s]*")
_CLAUSE_END = re.compile(r"[.!?;:,\n\r]|\b(?:but|and|yet|so)\b", re.IGNORECASE)
_SENTENCE_END = re.compile(r"[.!?;:\n\r]")
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def spelled(words: list[str]) -> list[str]:
    """The words with the noun's other spelling made equal to the verb's."""
    return [w.replace("licenc", "licens") for w in words]


def defining(words: list[str]) -> list[str]:
    """The parts of words that define a license, in sorted order: versions, qualifiers and denials."""
    return sorted(p for w in words for p in w.split("-") if p in DEFINING or any(map(str.isdigit, p)))


def differences(template: list[str], block: list[str]) -> int:
    """The least number of words to change, add or drop to turn the template into a stretch of the block."""
    row = [0] * (len(block) + 1)
    for i, t in enumerate(template, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(block, 1):
            last, row[j] = row[j], min(last + (t != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def stretches(template: list[str], block: list[str], most: int) -> Iterator[tuple[int, int, int]]:
    """(differences, start, end) of the stretches of the block that at most ``most`` changes turn into the template, one for each end."""
    row = [(0, j) for j in range(len(block) + 1)]
    for i, t in enumerate(template, 1):
        last, row[0] = row[0], (i, 0)
        for j, b in enumerate(block, 1):
            # of equal costs the later start, so that a stretch is no longer than need be
            cost, start = min((last[0] + (t != b), -last[1]), (row[j][0] + 1, -row[j][1]), (row[j - 1][0] + 1, -row[j - 1][1]))
            last, row[j] = row[j], (cost, -start)
    yield from ((cost, start, end) for end, (cost, start) in enumerate(row) if cost <= most and start < end)


def anchors(words: list[str]) -> list[str]:
    """One distinct word more than may differ: every confirmed wording of the template holds one of these."""
    return sorted(set(words), key=lambda w: (not re.search(CUES, w), -len(w), w))[: int(DIFFERENCE * len(words)) + 1]


def hint(templates: dict[str, list[str]]) -> str:
    """A pattern that each text with a notice fits."""
    found = sorted({w for texts in templates.values() for text in texts for w in anchors(words_of(text))})
    # a word that holds another needs no place of its own
    return "(?iu)" + "|".join(re.escape(w).replace("licens", "licen[sc]") for w in found if not any(x != w and x in w for x in found))


class Scanner:
    def __init__(self, templates: dict[str, list[str]], titles: dict[str, list[str]] | None = None):
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.known = []
        self.titles = sum(map(len, templates.values()))
        for name, texts in [*templates.items(), *(titles or {}).items()]:
            for text in texts:
                sample = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.known.append((name, text, words_of(text), zstandard.ZstdCompressor(level=3, dict_data=sample, write_content_size=False, write_dict_id=False)))
        self.seen: dict[str, tuple | None] = {}
        self.by_anchor: dict[str, list[int]] = {}
        for k, (_, _, words, _) in enumerate(self.known):
            for w in anchors(spelled(words)):
                self.by_anchor.setdefault(w, []).append(k)

    def judge(self, block: str) -> tuple[str, float, int] | None:
        """(license, reduction, differing words) of a block, or None."""
        if len(block) > REMEMBERED:
            return self._judge(block)
        if block not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            self.seen[block] = self._judge(block)
        return self.seen[block]

    def _judge(self, block: str) -> tuple[str, float, int] | None:
        raw, said = block.encode(), words_of(block)
        frame = len(self.plain.compress(b""))
        alone = max(len(self.plain.compress(raw)) - frame, 1)
        ranked = sorted(((1 - (len(c.compress(raw)) - frame) / alone, name, words) for name, _, words, c in self.known), key=lambda x: -x[0])
        # the template that shrinks the block most of those whose wording is confirmed; what defines a license may not differ
        for reduction, name, words in ranked:
            if reduction < REDUCTION:
                return None
            wrong = differences(words, said)
            if differences(spelled(words), spelled(said)) <= DIFFERENCE * len(words) and defining(words) == defining(said):
                return name, reduction, wrong
        return None

    @staticmethod
    def denied(text: str, spans: list[tuple[int, int]], start: int, end: int) -> bool:
        """Whether the clause before these words denies what they say, or what follows in their sentence takes it back."""
        before = _CLAUSE_END.split(text[spans[max(start - DENIED_BEFORE, 0)][0] : spans[start][0]])[-1].lower().split()
        after = _SENTENCE_END.split(text[spans[end - 1][1] : spans[min(end + DENIED_AFTER, len(spans)) - 1][1]])[0].lower().split()
        return not DENIAL.isdisjoint(before) or ("no", "longer") in zip(after, after[1:], strict=False)

    def scan(self, text: str) -> Iterator[tuple[int, str, str, float, int]]:
        """(line, block, license, reduction, differences) of each notice of a text, in order.

        A block reaches from a notice's first word to its last, with up to three marks that touch them, over as many lines as it takes.
        Of blocks that share words the one whose wording differs least counts, or else the longest template's.
        """
        spans = [m.span() for m in _WORD.finditer(text)]
        words = spelled([text[a:b].lower() for a, b in spans])
        # windows around anchors that hold enough of a template's words
        windows: dict[int, list[list[int]]] = {}
        for at, word in enumerate(words):
            for k in self.by_anchor.get(word, ()):
                asked = spelled(self.known[k][2])
                most = int(DIFFERENCE * len(asked))
                low, high = max(at - len(asked) - most, 0), at + len(asked) + most + 1
                if len(set(asked).difference(words[low:high])) > most:
                    continue
                mine = windows.setdefault(k, [])
                if mine and low <= mine[-1][1]:
                    mine[-1][1] = high
                else:
                    mine.append([low, high])
        near = []
        for k, mine in windows.items():
            asked = spelled(self.known[k][2])
            for low, high in mine:
                near += [(wrong, -len(asked), abs(end - start - len(asked)), k, low + start, low + end) for wrong, start, end in stretches(asked, words[low:high], int(DIFFERENCE * len(asked)))]
        taken: set[int] = set()
        found = []
        for *_, k, start, end in sorted(near):
            if not taken.isdisjoint(range(start, end)) or self.denied(text, spans, start, end):
                continue
            a, b = spans[start][0], spans[end - 1][1]
            a -= len(_MARKS_BEFORE.search(text, max(a - 3, 0), a)[0])
            b += len(_MARKS_AFTER.match(text, b, b + 3)[0])
            if k >= self.titles and (text[text.rfind("\n", 0, a) + 1 : a].strip() or text[b:].partition("\n")[0].strip()):
                continue
            block = " ".join(text[a:b].split())
            if x := self.judge(block):
                taken.update(range(start, end))
                cue = next((i for i in range(start, end) if re.search(CUES, words[i])), start)
                found.append((start, (text.count("\n", 0, spans[cue][0]), block, *x)))
        yield from (row for _, row in sorted(found))


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, line, license, reduction, differences, block), one row for each license notice in ``docs`` (doc_id, text).

    Without ``templates`` of your own, ``TEMPLATES`` and ``SHORT`` are looked for anywhere, ``TITLES`` where they stand alone on a line.
    A notice that its clause denies, or that is said to hold no longer, gives none. ``line`` counts from 0. Documents without a notice, null and empty texts give no rows; repeated rows and null doc_ids each give their own.
    """
    titles = {} if templates else TITLES
    templates = templates or {name: TEMPLATES.get(name, []) + SHORT.get(name, []) for name in [*TEMPLATES, *(n for n in SHORT if n not in TEMPLATES)]}

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, titles)
        for batch in chunks(batches):
            rows = [(doc, *x) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in scanner.scan(text)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(columns[0], pa.int64()), "line": pa.array(columns[1], pa.int64()), "license": pa.array(columns[3], pa.string()), "reduction": pa.array(columns[4], pa.float64()), "differences": pa.array(columns[5], pa.int64()), "block": pa.array(columns[2], pa.string())})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hinted = docs.where(F.col("text").rlike(hint({**templates, "": [x for texts in titles.values() for x in texts]})))
    return hinted.mapInArrow(run, "doc_id long, line long, license string, reduction double, differences long, block string")
