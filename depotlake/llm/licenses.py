"""License scans by conditional compression.

A candidate block is all words within reach of a license's cue words, where reach is the length of the longest template, so
it doesn't depend on how the text is wrapped; blocks that touch are one. Each block is cut into windows of twice the reach that
overlap by half, so that a saving doesn't depend on the block's length. Each window is compressed alone and with each license's
templates as a zstandard raw dictionary; licenses are ranked by how much smaller the window gets. The rank never drops any: all
are then confirmed, or not, by the exact differences of wording at every place where enough of a template's word triples are.

Up to a tenth of the words may differ, besides a name that is filled in, but not those that tell a template from the others that
it is like (versions, "affero", "lesser"), no word that tells other ones apart may come in, and a wording that goes on as a
longer template does (with a third clause) isn't the shorter one. Where places overlap, the one with the most words
in common counts (ties: fewer differences, the larger saving, then the order of the names). A block may hold any number of licenses; one without any is
reported as unknown.

Null and empty texts have no blocks and give no rows; texts are taken whole; repeated rows each give theirs; an empty table
gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlake.llm.common import per_batch, table

# Cue words, and templates of public licenses: notices and the texts' own wording. What is in <> is to be filled in.
CUES = r"(?i)licen[sc]e|copyright|\(c\)\s?[0-9]{4}|rights[\W_]+reserved|public[\W_]+domain|permission[\W_]+is[\W_]+hereby|redistribution[\W_]+and[\W_]+use|warranty|warranties|spdx|creative[\W_]+commons"
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    ],
    "MIT": [
        "Released under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    ],
    "LGPL-2.1": [
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed
in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE.""",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed
in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE.""",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed
in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["This work has been dedicated to the public domain under CC0 1.0 Universal."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "Apache-1.1": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. 3. The end-user documentation included with the redistribution, if any,
must include the following acknowledgment: "This product includes software developed by the Apache Software Foundation
(http://www.apache.org/)." Alternately, this acknowledgment may appear in the software itself, if and wherever such third-party acknowledgments
normally appear. 4. The names "Apache" and "Apache Software Foundation" must not be used to endorse or promote products derived from this
software without prior written permission.""",
    ],
    "BSD-4-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. 3. All advertising materials mentioning features or use of this software
must display the following acknowledgement: This product includes software developed by <the copyright holder>. 4. Neither the name of <the
copyright holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission.""",
    ],
    "BSD-3-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. 3. Neither the name of <the copyright holder> nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    ],
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.""",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.""",
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
and to alter it and redistribute it freely, subject to the following restrictions.""",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "EPL-2.0": [
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
http://www.eclipse.org/legal/epl-2.0.""",
    ],
    "MPL-1.1": [
        """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in
compliance with the License.""",
    ],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ],
    "Proprietary": ["All rights reserved.", "All Rights Reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
# Openings of the licenses' full texts.
OPENINGS = {
    "GPL-1.0": "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.0": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "GFDL-1.2": "GNU Free Documentation License Version 1.2, November 2002",
    "GFDL-1.3": "GNU Free Documentation License Version 1.3, 3 November 2008",
    "Apache-2.0": "Apache License Version 2.0, January 2004",
    "MPL-1.1": "MOZILLA PUBLIC LICENSE Version 1.1 1. Definitions",
    "MPL-2.0": "Mozilla Public License Version 2.0 1. Definitions",
    "CC0-1.0": "Creative Commons Legal Code CC0 1.0 Universal",
    "Artistic-1.0": "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package",
}
# What licenses are called in a line that grants them.
CALLED = {
    "MIT": ["MIT License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "Apache-2.0": ["Apache License 2.0", "Apache 2.0 License", "Apache License, Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "BSD-4-Clause": ["BSD 4-Clause License"],
    "GPL-2.0": ["GNU General Public License v2.0", "GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License v3.0", "GNU General Public License, version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, version 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "BSL-1.0": ["Boost Software License 1.0"],
    "CC-BY-3.0": ["Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-SA-3.0": ["Creative Commons Attribution-ShareAlike 3.0 Unported License"],
}
#: Lines that grant what is called so, or name it by its identifier.
GRANTS, IDENTIFIER = ("under the {}", "under a {}", "under the terms of the {}"), "SPDX-License-Identifier: {}"
#: Differing words in relation to the template's; words of a seed; level of zstandard; share of common words from which templates are like each other; words of a name that is filled in.
DIFFERING, SEED, LEVEL, ALIKE, FILL = 0.1, 3, 3, 0.5, 12
WORD = re.compile(r"[^\W_]+(?:[.'][^\W_]+)*")
CUE = re.compile(CUES)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Template:
    name: str
    words: list[str]
    #: Places of the words that are filled in.
    free: set[int]
    #: Places of the words that tell it from templates like it, words that those have instead, and words with which longer ones go on.
    telling: set[int] = field(default_factory=set)
    foreign: set[str] = field(default_factory=set)
    goes_on: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.slack = int(DIFFERING * len(self.words))
        self.fills = sum(i - 1 not in self.free for i in self.free)
        self.shift = self.slack + FILL * self.fills
        k = min(SEED, len(self.words))
        self.seeds = [(i, tuple(self.words[i : i + k])) for i in range(len(self.words) - k + 1) if self.free.isdisjoint(range(i, i + k))]

    def learn_from(self, other: Template) -> None:
        matcher = SequenceMatcher(None, self.words, other.words, autojunk=False)
        same = sum(m.size for m in matcher.get_matching_blocks())
        if self.name == other.name or same < ALIKE * max(len(self.words), len(other.words)):
            return
        for kind, a, b, c, d in matcher.get_opcodes():
            if kind == "equal":
                continue
            if a == b == len(self.words):
                self.goes_on.add(other.words[c])
            if b - a <= self.slack + 1 and d - c <= self.slack + 1:  # longer ones are too many differences anyway
                self.telling.update(set(range(a, b)) - self.free)
                self.foreign.update({other.words[i] for i in range(c, d) if i not in other.free} - set(self.words))


def wordings() -> list[tuple[str, str]]:
    """Names and texts of all templates: those that are listed, openings, and the lines made of names."""
    out = [(name, t) for name, texts in TEMPLATES.items() for t in texts] + list(OPENINGS.items())
    out += [(name, line.format(t)) for name, texts in CALLED.items() for t in texts for line in GRANTS]
    return out + [(name, IDENTIFIER.format(name)) for name in dict.fromkeys(n for n, _ in out) if name != "Proprietary"]


class Templates:
    def __init__(self):
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.all: list[Template] = []
        for name, text in wordings():
            free = {k for m in re.finditer("<[^>]*>", text) for k in range(len(words(text[: m.start()])), len(words(text[: m.end()])))}
            self.all.append(Template(name, words(text), free))
        for one in self.all:
            for other in self.all:
                one.learn_from(other)
        self.reach = max(len(t.words) + t.shift for t in self.all)
        self.compressors = {}
        for name in dict.fromkeys(t.name for t in self.all):
            known = zstandard.ZstdCompressionDict(" ".join(w for t in self.all if t.name == name for w in t.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.compressors[name] = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)

    def ranked(self, window: list[str]) -> dict[str, tuple[int, float]]:
        """For each license its rank, and how much smaller its templates make the window, in relation to the window's own size; the largest reduction first."""
        data = " ".join(window).encode()
        alone = len(self.plain.compress(data))
        found = sorted((len(c.compress(data)), name) for name, c in self.compressors.items())
        return {name: (k, (alone - size) / alone) for k, (size, name) in enumerate(found)}


@lru_cache(1)
def templates() -> Templates:
    return Templates()


@dataclass
class Found:
    name: str
    rank: int
    reduction: float
    begin: int
    end: int
    same: int
    lacking: int
    added: int


def places(at: dict[tuple[str, ...], list[int]], t: Template) -> list[tuple[int, int]]:
    """Where the template may begin, from the first to the last possible word, by its word triples and their offsets in it."""
    hits = sorted((place - offset, offset) for offset, s in t.seeds for place in at.get(s, ()))
    out, k = [], 0
    while k < len(hits):
        end = k
        while end + 1 < len(hits) and hits[end + 1][0] - hits[end][0] <= t.shift:
            end += 1
        # each differing word spoils SEED triples at most
        if len({offset for _, offset in hits[k : end + 1]}) >= max(1, len(t.seeds) - SEED * t.slack):
            out.append((hits[k][0], hits[end][0]))
        k = end + 1
    return out


def compared(block: list[str], t: Template, low: int, high: int, rank: int, reduction: float) -> Found | None:
    """The differences of wording where the template begins between low and high; None if they are too many or touch telling words."""
    low = max(0, low)
    part = block[low : high + len(t.words)]
    changes = [c for c in SequenceMatcher(None, part, t.words, autojunk=False).get_opcodes() if not (c[0] == "delete" and (c[1] == 0 or c[2] == len(part)))]
    kept = {i for kind, _, _, c, d in changes if kind == "equal" for i in range(c, d)}
    begin, end = low + changes[0][1], low + changes[-1][2]
    lacking = added = counted = 0
    for kind, a, b, c, d in changes:
        if kind == "equal":
            continue
        lacking, added = lacking + d - c, added + b - a
        if not (c < d and t.free.issuperset(range(c, d)) and b - a <= FILL):
            counted += d - c + b - a
            if t.foreign.intersection(part[a:b]):
                return None
    if counted > t.slack or not t.telling <= kept or (end < len(block) and block[end] in t.goes_on):
        return None
    return Found(t.name, rank, round(reduction, 4), begin, end, len(kept), lacking, added)


def licenses_in(block: list[str]) -> list[Found]:
    """Each confirmed license at each place, in the order of the text; none overlaps another."""
    at = defaultdict(list)
    for k in range(1, SEED + 1):
        for i in range(len(block) - k + 1):
            at[tuple(block[i : i + k])].append(i)
    own = templates()
    # a template that begins in the first half of a window ends in it
    half = own.reach
    windows = [own.ranked(block[k : k + 2 * half]) for k in range(0, max(len(block) - half, 1), half)]
    every = []
    for t in own.all:
        for low, high in places(at, t):
            rank, reduction = windows[min(max(low, 0) // half, len(windows) - 1)][t.name]
            if f := compared(block, t, low, high, rank, reduction):
                every.append(f)
    out: list[Found] = []
    for f in sorted(every, key=lambda f: (-f.same, f.lacking + f.added, f.rank, f.name, f.begin)):
        k = bisect_left(out, f.begin, key=lambda o: o.begin)
        if (k == 0 or out[k - 1].end <= f.begin) and (k == len(out) or out[k].begin >= f.end):
            out.insert(k, f)
    return out


def blocks_of(text: str) -> list[tuple[int, int, list[tuple[int, str]]]]:
    """First and last line with a cue of each candidate block, and its words with the place of each in the text."""
    every = [(m.start(), m[0].lower()) for m in WORD.finditer(text)]
    starts, reach, out = [at for at, _ in every], templates().reach, []
    for cue in CUE.finditer(text):
        k = bisect_right(starts, cue.start())
        low, high = max(0, k - 1 - reach), min(len(every), k + reach)
        if out and low <= out[-1][3]:
            out[-1][1], out[-1][3] = cue.start(), high
        else:
            out.append([cue.start(), cue.start(), low, high])
    return [(text.count("\n", 0, a), text.count("\n", 0, b), every[low:high]) for a, b, low, high in out]


def scan_text(text: str) -> list[tuple[int, int, int, str, float, int | None, int | None]]:
    """Block, first and last line, license, reduction, words lacking and added, of each license or unknown block of a text."""
    rows = []
    for n, (first, last, own) in enumerate(blocks_of(text)):
        found = licenses_in([w for _, w in own])
        for f in found:
            rows.append((n, text.count("\n", 0, own[f.begin][0]), text.count("\n", 0, own[f.end - 1][0]), f.name, f.reduction, f.lacking, f.added))
        if not found:
            rows.append((n, first, last, "unknown", 0.0, None, None))
    return rows


SCHEMA = "doc_id long, block int, first_line int, last_line int, license string, reduction double, lacking int, added int, exact boolean"


def license_blocks(docs: DataFrame) -> DataFrame:
    """One row for each license at each place, or one for a block with none, which is unknown; exact: word for word."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, *r, r[-2] == 0 and r[-1] == 0) for k, text in zip(*(c.to_pylist() for c in batch.columns)) for r in scan_text(text)]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return docs.select("doc_id", "text").where(F.col("text").rlike(CUES)).mapInArrow(per_batch(step), SCHEMA)


def op8_conditional_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_blocks(table(spark, sf_dir, "documents"))
