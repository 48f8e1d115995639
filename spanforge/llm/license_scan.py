"""License scans by conditional compression.

Cue words are chosen from the wordings: of each, so many that no match can do without all of them (a match may lack a tenth of the
words). Spark passes on the texts that have a cue, and a block is the words around one, as many on either side as the longest match spans,
with overlapping blocks joined. So every match lies in a block, wherever the text has its line breaks, and a block is never cut short.
Of a block the wordings of which enough words are there (an exact bound: no other can match) are its candidates. The block is compressed
alone and with each candidate as a zstandard raw dictionary, and the candidates are ranked by the bytes that this saves. In that order they are
confirmed by their exact differences: a wording is aligned word by word from each place where it can begin, and matches if at least MATCHED of its words
appear in order within a stretch that has few others. The first confirmed one wins, so of two wordings that both match, as of two versions of a license, the
one that explains the block best is reported; ranking goes on until every candidate has been tried, so a bad rank loses no match.

The winner's stretch parts the block in two, each of which is ranked and searched again by itself: no match reaches across a
stretch that is taken. The report names the differing words, and the share of the template that it saves on its own stretch.

Templates are short notices and the openings of common licenses; callers may pass their own.

Edge cases: a null or empty text has no blocks; of candidates that save equally much the match with fewest differences counts, then that of more words,
the first in the text and the template that comes first by id; so do a winner's places among themselves; rows that repeat an id are reported each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: License ids and wording; fixed values from the licenses' own texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.", "Released under CC0 1.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.",),
}
#: Words that are cues by preference, as other prose seldom has them.
RARE = re.compile(r"licen[cs]|copyright|reserved|spdx|warrant|redistribut|unencumbered|dedicated|cc0")
MATCHED, MAX_EXTRA = 0.9, 0.25
LEVEL = 3
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words_at(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


@dataclass(frozen=True)
class Wording:
    name: str
    words: tuple[str, ...]
    #: How many of the words a match has at least, and how many words of the text it spans at most.
    need: int
    reach: int
    counts: Counter
    own: zstandard.ZstdCompressor
    size: int

    @property
    def cues(self) -> set[str]:
        """The rarest words, as far as it seems, of which a match has at least one: more than may be missing."""
        out, n = set(), 0
        for w in sorted(self.counts, key=lambda w: (not RARE.search(w), -len(w), w)):
            if n > len(self.words) - self.need:
                break
            out.add(w)
            n += self.counts[w]
        return out

    @property
    def first(self) -> set[str]:
        """Words that a match can begin with: no more may be missing before it than in the whole."""
        return set(self.words[: len(self.words) - self.need + 1])


@dataclass(frozen=True)
class Match:
    item: int
    lo: int
    hi: int
    missing: list[str]
    extra: list[str]


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.least = len(self.plain.compress(b""))
        self.items = []
        for name in sorted(templates):
            for wording in templates[name]:
                words = tuple(w for w, _, _ in words_at(wording))
                raw = " ".join(words).encode()
                if not words:
                    continue
                own = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
                need = next(h for h in range(1, len(words) + 1) if h >= MATCHED * len(words))
                self.items.append(Wording(name, words, need, len(words) + max(2, int(len(words) * MAX_EXTRA)), Counter(words), own, max(1, len(self.plain.compress(raw)) - self.least)))

        self.cues = set().union(*[x.cues for x in self.items])
        self.reach = max((x.reach for x in self.items), default=0)

    def blocks(self, text: str) -> Iterator[list[tuple[str, int, int]]]:
        """The words around each cue, those of overlapping blocks together."""
        words, lo, hi = words_at(text), 0, 0
        for i in [i for i, (w, _, _) in enumerate(words) if w in self.cues]:
            if i - self.reach > hi:
                if hi:
                    yield words[lo:hi]
                lo = i - self.reach
            hi = min(len(words), i + self.reach)
            lo = max(0, lo)
        if hi:
            yield words[lo:hi]

    def saving(self, item: int, have: Sequence[str]) -> int:
        """The bytes that the wording as a dictionary saves on compressing words, wherever the text breaks its lines."""
        raw = " ".join(have).encode("utf-8", "surrogatepass")
        return len(self.plain.compress(raw)) - len(self.items[item].own.compress(raw))

    def candidates(self, have: list[str]) -> list[int]:
        """The wordings of which enough words are among those of a block; no other can match in it."""
        there = Counter(have)
        return [i for i, x in enumerate(self.items) if sum(min(n, there[w]) for w, n in x.counts.items()) >= x.need]

    def ranked(self, have: list[str]) -> list[list[int]]:
        """A block's candidates by what they save on it, those that save equally much together."""
        by: dict[int, list[int]] = {}
        for i in self.candidates(have):
            by.setdefault(self.saving(i, have), []).append(i)
        return [by[k] for k in sorted(by, reverse=True)]

    def matches(self, item: int, have: list[str]) -> Iterator[Match]:
        """Every stretch of the words that the wording matches, one at most for each place where it can begin."""
        x = self.items[item]
        for a in (i for i, w in enumerate(have) if w in x.first):
            part = have[a : a + x.reach]
            if sum(w in x.counts for w in part) < x.need:
                continue
            runs = [m for m in difflib.SequenceMatcher(None, x.words, part, autojunk=False).get_matching_blocks() if m.size]
            hit = sum(m.size for m in runs)
            if hit < x.need:
                continue
            lo, hi = runs[0].b, runs[-1].b + runs[-1].size
            if hi - lo - hit > MAX_EXTRA * len(x.words):
                continue
            seen = {i for m in runs for i in range(m.a, m.a + m.size)}
            used = {i for m in runs for i in range(m.b, m.b + m.size)}
            yield Match(item, a + lo, a + hi, [w for i, w in enumerate(x.words) if i not in seen], [part[i] for i in range(lo, hi) if i not in used])

    def winner(self, have: list[str]) -> Match | None:
        """The best place of the first ranked wording that its differences confirm."""
        for items in self.ranked(have):
            found = min((m for i in items for m in self.matches(i, have)), key=lambda m: (len(m.missing) + len(m.extra), -len(self.items[m.item].words), m.lo, m.item), default=None)
            if found:
                return found
        return None

    def scan(self, text: str) -> Iterator[dict]:
        """The licenses of a text: license, start, stop (code points), saved share, missing and extra words."""
        for words in self.blocks(text):
            yield from self.scan_block(words)

    def scan_block(self, words: list[tuple[str, int, int]]) -> Iterator[dict]:
        waiting = [words]
        while waiting:
            part = waiting.pop()
            have = [w for w, _, _ in part]
            m = self.winner(have)
            if m is None:
                continue
            share = self.saving(m.item, have[m.lo : m.hi]) / self.items[m.item].size
            yield {"license": self.items[m.item].name, "start": part[m.lo][1], "stop": part[m.hi - 1][2], "saved": round(share, 4), "missing": m.missing, "extra": m.extra}
            waiting += [part[m.hi :], part[: m.lo]]


def has_cue(text: Column, scanner: Scanner) -> Column:
    """Whether the text has a cue; word boundaries are looser than those of words_at."""
    cues = "|".join(re.sub(r"([^\w])", r"\\\1", w) for w in sorted(scanner.cues))
    return text.rlike(r"(?iu)(?<![A-Za-z0-9])(?:" + cues + ")") if cues else F.lit(False)


_FOUND = pa.struct([("license", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("saved", pa.float64()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))])


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """doc_id, license, start, stop (code points of the text), saved, missing and extra (words) of every license found."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            rows = [list(scanner.scan(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(_FOUND))], names=["doc_id", "found"])

    with_cue = docs.select("doc_id", "text").filter(has_cue(F.col("text"), Scanner(templates)))
    found = with_cue.mapInArrow(run, f"doc_id {kind}, found array<struct<license:string,start:bigint,stop:bigint,saved:double,missing:array<string>,extra:array<string>>>")
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.license", "f.start", "f.stop", "f.saved", "f.missing", "f.extra")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
