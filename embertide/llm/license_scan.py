"""License scans by conditional compression against templates, confirmed by wording differences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import spread, text_or_empty

#: Wordings of each licence (fixed values): notices, headers and grants as commonly published.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    "MPL-2.0": (
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "Proprietary": ("All rights reserved.", "All rights reserved. No part of this work may be reproduced without written permission.",),
}
#: Lower-case cues that make a line part of a candidate block.
CUES = ("licens", "licenc", "copyright", "spdx", "permission", "redistribut", "warrant", "rights reserved", "creative commons", "cc by", "cc0", "public license")
#: Lines without a cue that may stand inside a block.
GAP_LINES = 2
#: Share of a wording's words that may be missing.
MISSING = 0.1
#: Words of a block aligned at a time, in lengths of the wording, and how far apart such windows start. A match that can be confirmed
#: spans at most 1.2 lengths and a word, so one of them holds it whole.
WINDOW_LENGTHS, STEP_LENGTHS = 3, 1
#: Characters of a block whose licences a worker remembers, at most.
REMEMBERED_CHARS = 5_000
#: First words of a long grant. A reservation right before them is the heading of that licence.
OPENING = 10
_WORD = re.compile(r"[^\W_]+")
#: Words that tell licences of one wording apart: they must agree exactly.
_TELLING = frozenset("nc nd sa noncommercial noderivatives sharealike lesser affero library only mit apache bsd isc mozilla cc0 clause v1 v2 v3".split())


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(maxsize=1)
def _wordings() -> list[tuple[str, str, list[str], zstandard.ZstdCompressor]]:
    out = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append((name, text, words_of(text), zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False)))
    return out


def blocks_of(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of candidate blocks: lines with a cue, with up to GAP_LINES plain lines between."""
    at, start, end, gap = 0, -1, -1, 0
    for line in text.split("\n"):
        low = line.lower()
        if any(c in low for c in CUES):
            start = at if start < 0 else start
            end, gap = at + len(line), 0
        elif start >= 0:
            gap += 1
            if gap > GAP_LINES:
                yield start, end
                start = -1
        at += len(line) + 1
    if start >= 0:
        yield start, end


def _differences(block: list[str], wording: list[str]) -> Iterator[tuple[int, int, bool]]:
    """wording_difference with each window of the block that holds enough words of the wording; linear in the block."""
    n, wide = len(wording), max(WINDOW_LENGTHS * len(wording), len(wording) + 20)
    own, telling = Counter(wording), _telling(wording)
    for start in range(0, max(1, len(block) - wide + STEP_LENGTHS * n), STEP_LENGTHS * n):
        part = block[start : start + wide]
        held = Counter(part)
        if telling <= held.keys() and (own - held).total() <= MISSING * n:
            yield wording_difference(part, wording)


def _telling(words: list[str]) -> set[str]:
    return {w for w in words if w in _TELLING or any(c.isdigit() for c in w)}


def wording_difference(block: list[str], template: list[str]) -> tuple[int, int, bool]:
    """(template words missing, words of the block inserted within the match, telling words agree)."""
    match = SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks()
    kept = [m for m in match if m.size]
    if not kept:
        return len(template), len(block), False
    first, last = kept[0].a, kept[-1].a + kept[-1].size
    same = sum(m.size for m in kept)
    return len(template) - same, last - first - same, _telling(template) == _telling(block[first:last])


@lru_cache(maxsize=1)
def _headings() -> tuple[list[str], list[list[str]]]:
    """The words of the bare reservation, and the openings of all grants of two openings or more."""
    reserved, own = words_of(TEMPLATES["Proprietary"][0]), TEMPLATES["Proprietary"]
    return reserved, [w[:OPENING] for _, text, w, _ in _wordings() if len(w) >= 2 * OPENING and text not in own]


def _without_headings(block: list[str]) -> list[str]:
    """The block without reservations that head a grant ("All rights reserved. Redistribution and use ...")."""
    reserved, openings = _headings()
    out, i, n = [], 0, len(reserved)
    while i < len(block):
        if block[i : i + n] == reserved and block[i + n : i + n + OPENING] in openings:
            i += n
        else:
            out.append(block[i])
            i += 1
    return out


def scan_block(block: str) -> list[tuple[str, float, int, int]]:
    """Confirmed licences of a block: (licence, size reduction, words missing, words inserted), best first.

    The block is compressed alone and with each wording as raw dictionary; the share of bytes that saves
    orders the wordings and drops none. Every wording is aligned word by word, but for those that can't be confirmed
    because a telling word or too many words are nowhere in the block;
    a licence is confirmed with few enough words missing and inserted and
    all telling words (numbers, NC, SA and the like) in place. "All rights reserved." is Proprietary, unless
    a longer grant follows at once, whose heading it is. What one licence has matched counts for no other.
    """
    data = block.encode("utf-8", "surrogatepass")
    plain = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(data))
    ranked = sorted(
        ((1 - len(packer.compress(data)) / plain, name, words) for name, _, words, packer in _wordings()), key=lambda x: (-x[0], x[1], len(x[2]))
    )
    have, out = words_of(block), []
    held, reserved, bare = Counter(have), _headings()[0], _without_headings(have)
    for gain, name, words in ranked:
        if not _telling(words) <= held.keys() or (Counter(words) - held).total() > MISSING * len(words):
            continue
        fits = [d[:2] for d in _differences(bare if words == reserved else have, words) if d[2] and d[0] <= MISSING * len(words) and d[1] <= max(1, MISSING * len(words))]
        if fits:
            out.append((name, round(gain, 4), *min(fits, key=lambda d: (sum(d), d)), words))
    best: dict[str, tuple] = {}
    for found in out:
        name = found[0]
        if name not in best or len(found[4]) - found[2] > len(best[name][4]) - best[name][2]:
            best[name] = found
    names = list(best)
    inside = {n for n in names for m in names if n != m and _within(best[n][4], best[m][4])}
    kept = [best[n] for n in names if n not in inside]
    return [f[:4] for f in sorted(kept, key=lambda f: (f[2] + f[3], -f[1], f[0]))]


def _within(small: list[str], large: list[str]) -> bool:
    """Whether a wording is a part of a longer one, which then explains it."""
    return len(small) < len(large) and wording_difference(large, small)[:2] == (0, 0)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()), ("missing", pa.int64()), ("inserted", pa.int64())]))
    remembered: dict[str, list] = {}
    for b in batches:
        hits, n_blocks = [], []
        for text in b.column(1).to_pylist():
            own, n = [], 0
            for start, end in blocks_of(text) if text else ():
                n += 1
                block = text[start:end]
                found = remembered.get(block)
                if found is None:
                    found = scan_block(block)
                    if len(remembered) > 5000:
                        remembered.clear()
                    if len(block) <= REMEMBERED_CHARS:
                        remembered[block] = found
                own += [dict(zip(("license", "start", "end", "reduction", "missing", "inserted"), (name, start, end, *rest), strict=True)) for name, *rest in found]
            hits.append(own)
            n_blocks.append(n)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_blocks, pa.int64()), pa.array(hits, kind)], ["doc_id", "n_blocks", "hits"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_blocks (candidates), hits (license, start, end, reduction, missing, inserted).

    Offsets are code points of the block. Null and empty texts and texts without a cue have no blocks; a row without doc_id
    is scanned like any other; repeated rows repeat; other columns are ignored; an empty table gives an empty result.
    Licences that fit a block equally well go by compression gain, then name. Only texts with a cue
    leave the JVM. A row's work is on its own text, block by block; a long block (one line may be a whole text) is aligned
    window by window, in time linear in its length.
    """
    cue = F.lower(text_or_empty()).rlike("|".join(CUES))
    rows = spread(docs.select("doc_id", F.col("text")))
    rows = rows.select("doc_id", F.when(cue, F.col("text")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    hit = "struct<license: string, start: bigint, end: bigint, reduction: double, missing: bigint, inserted: bigint>"
    return rows.mapInArrow(_scan, f"doc_id {kind}, n_blocks long, hits array<{hit}>")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_blocks, licenses (distinct, sorted), n_hits, spans (license:start:end)."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.selectExpr(
        "doc_id",
        "n_blocks",
        "array_sort(array_distinct(hits.license)) as licenses",
        "cast(size(hits) as bigint) as n_hits",
        "array_join(transform(hits, h -> concat_ws(':', h.license, h.start, h.end)), ',') as spans",
    )
