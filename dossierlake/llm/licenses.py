"""License scans by conditional compression.

Blocks of a text that speak of licensing are compressed alone and with each license template as a raw
zstandard dictionary; the share of bytes that the template saves ranks the templates. They are compared word by word
in that order, and one is reported only if the wording bears it out: at least `AGREEING` of its words stand there in order.
The comparison goes down the ranking until no template below can agree in a larger share, by how many of
its words the block has at all; so the result is that of comparing all, and a good ranking saves the work. The differences
in wording are kept with the finding. What stands before a finding and behind it is searched on its own.

Templates are notices and short licenses, and the texts in `license_texts`, each cut at its paragraphs into sections of at most
`SECTION` words.

A block is a run of lines with at most `LINES_BETWEEN` lines between two that hold a cue word; where it holds a section
of a whole text, its surroundings are searched too, as far as that text can reach. Blocks much
longer than the templates are read in windows that overlap by the longest template, so a text of any length is searched whole.

Defined cases: null and empty texts, and texts without a cue, have no finding; repeated rows each have
theirs; of templates that agree in equal shares the longer one is taken, then the one first by name; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from importlib import resources
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F
import zstandard

AGREEING = 0.85
LINES_BETWEEN = 3
SECTION, SHORTEST = 300, 25
CUES = r"(?i)licen[sc]|copyright|warrant|redistribut|permission is hereby|public domain|spdx-"
CUE = re.compile(CUES)
WORDS = re.compile(r"\w+(?:[.'-]\w+)*")

BSD_WARRANTY = (
    "BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
# License notices as their publishers word them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission. THIS SOFTWARE IS PROVIDED " + BSD_WARRANTY,
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED "
        + BSD_WARRANTY,
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "CC0-1.0": (
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to "
        "the public domain worldwide. This software is distributed without any warranty.",
    ),
    "Unlicense": (
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
    ),
    "Proprietary": ("All rights reserved. Copyright.",),
}


def sections(text: str) -> list[str]:
    """The paragraphs of a license text, short ones joined with the next, none above `SECTION` words if it can be cut."""
    found, held = [], []
    for paragraph in re.split(r"\n\s*\n", text):
        words = paragraph.split()
        if held and len(held) + len(words) > SECTION:
            found.append(held)
            held = []
        held = held + words
        while len(held) > SECTION:
            found.append(held[:SECTION])
            held = held[SECTION:]
        if len(held) >= SHORTEST:
            found.append(held)
            held = []
    if held:
        found.append(held)
    return [" ".join(words) for words in found if len(words) >= SHORTEST]


def all_templates() -> dict[str, tuple[str, ...]]:
    """The notices above and the sections of the whole texts."""
    found = dict(TEMPLATES)
    for file in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        name = file.name.removesuffix(".txt")
        found[name] = (*found.get(name, ()), *sections(file.read_text(encoding="utf-8")))
    return found


@dataclass(frozen=True)
class Template:
    license: str
    words: tuple[str, ...]
    counted: Counter[str]
    compressor: zstandard.ZstdCompressor
    section: bool = False


def canonical(text: str) -> bytes:
    return " ".join(w.lower() for w in WORDS.findall(text)).encode("utf-8", "surrogatepass")


def prepared(templates: dict[str, tuple[str, ...]] | None = None) -> list[Template]:
    found = []
    for name, wordings in (templates or all_templates()).items():
        for wording in wordings:
            data = canonical(wording)
            words = tuple(data.decode("utf-8", "surrogatepass").split())
            data = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            compressor = zstandard.ZstdCompressor(level=9, dict_data=data)
            found.append(Template(name, words, Counter(words), compressor, wording not in TEMPLATES.get(name, ())))
    return found


@dataclass(frozen=True)
class Finding:
    license: str
    start: int
    end: int
    saved: float
    agreeing: float
    differences: tuple[str, ...]
    section: bool = False  # of a whole text


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of lines around cue words."""
    open_ = None
    for cue in CUE.finditer(text):
        if open_ and cue.start() < open_[1]:
            continue
        start = text.rfind("\n", 0, cue.start()) + 1
        end = text.find("\n", cue.end())
        end = len(text) if end < 0 else end
        if open_ and text.count("\n", open_[1], start) <= LINES_BETWEEN + 1:
            open_ = (open_[0], end)
        else:
            if open_:
                yield open_
            open_ = (start, end)
    if open_:
        yield open_


def compared(template: Template, words: list[str]) -> tuple[float, int, int, tuple[str, ...]]:
    """Share of the template's words that stand in order, the stretch they span, and the differences inside it."""
    match = SequenceMatcher(None, template.words, words, autojunk=False)
    parts = [m for m in match.get_matching_blocks() if m.size]
    if not parts:
        return 0.0, 0, 0, ()
    longest = max(range(len(parts)), key=lambda i: parts[i].size)
    low = high = longest
    while low > 0 and parts[low].b - parts[low - 1].b - parts[low - 1].size <= 8:
        low -= 1
    while high + 1 < len(parts) and parts[high + 1].b - parts[high].b - parts[high].size <= 8:
        high += 1
    chosen = parts[low : high + 1]
    differences = []
    for left, right in zip(chosen, chosen[1:], strict=False):
        gone, new = template.words[left.a + left.size : right.a], words[left.b + left.size : right.b]
        differences.append(f"{' '.join(gone)} > {' '.join(new)}")
    head, tail = template.words[: chosen[0].a], template.words[chosen[-1].a + chosen[-1].size :]
    differences += [f"{' '.join(x)} > " for x in (head, tail) if x]
    return sum(p.size for p in chosen) / len(template.words), chosen[0].b, chosen[-1].b + chosen[-1].size, tuple(differences)


def reachable(template: Template, counted: Counter[str]) -> float:
    """The largest share of the template's words that can stand in these words in any order."""
    return sum(min(n, counted[w]) for w, n in template.counted.items()) / len(template.words)


Span = tuple[str, int, int]


def best_of(words: list[str], templates: list[Template], plain: zstandard.ZstdCompressor) -> tuple | None:
    """(saved, template, share, first, end, differences) of the template that agrees best.

    Templates are compared in the order of what they save, as long as one below can still agree better.
    """
    counted = Counter(words)
    reach = {i: (share, len(t.words)) for i, t in enumerate(templates) if (share := reachable(t, counted)) >= AGREEING}
    if not reach:
        return None
    data = " ".join(words).encode("utf-8", "surrogatepass")
    alone = len(plain.compress(data))
    ranked = sorted((len(templates[i].compressor.compress(data)) - alone, templates[i].license, i) for i in reach)
    best, key = None, (AGREEING, 0)
    for place, (growth, _, i) in enumerate(ranked):
        if best and key > max(reach[j] for _, _, j in ranked[place:]):
            break
        if reach[i] < key:
            continue
        share, first, end, differences = compared(templates[i], words)
        this = (share, len(templates[i].words))
        if this > key or (this == key and best and templates[i].license < best[1].license):
            best, key = (-growth / alone, templates[i], share, first, end, differences), this
    return best


def findings_in(text: str, offset: int, templates: list[Template]) -> list[Finding]:
    """Findings of one block; the words before one and those behind it are searched on their own."""
    plain = zstandard.ZstdCompressor(level=9)
    spans = [(m.group().lower(), m.start(), m.end()) for m in WORDS.finditer(text)]
    longest = 2 * max(len(t.words) for t in templates)
    step = longest // 2
    found: list[Finding] = []
    for low in range(0, max(1, len(spans) - step), step):
        waiting = open_stretches(spans[low : low + longest], [(f.start - offset, f.end - offset) for f in found])
        while waiting:
            rest = waiting.pop()
            best = best_of([w for w, _, _ in rest], templates, plain)
            if best:
                saved, template, share, first, end, differences = best
                found.append(Finding(template.license, offset + rest[first][1], offset + rest[end - 1][2], saved, share, differences, template.section))
                waiting += [part for part in (rest[:first], rest[end:]) if part]
    return found


def open_stretches(spans: list[Span], taken: list[tuple[int, int]]) -> list[list[Span]]:
    """The stretches of words between what is taken."""
    out: list[list[Span]] = [[]]
    for span in spans:
        if any(a < span[2] and span[1] < b for a, b in taken):
            out.append([])
        else:
            out[-1].append(span)
    return [part for part in out if part]


def whole_length(templates: list[Template], license: str) -> int:
    """A bound on the characters of the license's whole text, between any two of its sections."""
    return sum(2 * len(w) + 2 for t in templates if t.license == license for w in t.words)


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(text: str, templates: list[Template]) -> list[Finding]:
    found = [f for a, b in blocks(text) for f in findings_in(text[a:b], a, templates)]
    sizes = {f.license: whole_length(templates, f.license) for f in found if f.section}
    for a, b in merged([(max(0, f.start - sizes[f.license]), min(len(text), f.end + sizes[f.license])) for f in found if f.section]):
        found = [f for f in found if f.end <= a or b <= f.start] + findings_in(text[a:b], a, templates)
    return sorted(found, key=lambda f: (f.start, f.end, f.license))


SCHEMA = "doc_id bigint, start int, end int, license string, saved double, agreeing double, exact boolean, differences array<string>"


def license_findings(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row for each license notice in a text: place, license, saved share, agreeing share, differences; no shuffle."""

    wanted = templates or all_templates()

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = prepared(wanted)
        for batch in batches:
            out = [
                (doc_id, f.start, f.end, f.license, f.saved, f.agreeing, not f.differences, list(f.differences))
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True) for f in scan(text, ready)]
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").rlike(CUES))
    return rows.mapInPandas(scanned, SCHEMA)
