"""License scan: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Words are lower-cased runs of letters and digits. The fingerprints of a template are the
winnowed hashes of its runs of ``GRAM`` words (the least of every ``WINNOW`` neighbours); they form an
inverted index hash -> (template, place). A document is looked up at every word, so it is
winnowed implicitly and no fingerprint of a template that stands in it can be missed. Hits of a
template that rise in both, with gaps of at most the template's length, are chained into one candidate;
of the chains through a hit the one with most hits and least change of diagonal is taken. The
template is then aligned with that part of the document within a band from ``band`` words below to ``band``
words above the chain's diagonals (equal words score, words may be missing on either side), giving the number of
matched template words, its share of the template (coverage) and the span of document words. A chain is
two occurrences where both sides of a jump along the diagonals are enough by themselves.

A template of fewer than ``SHORT`` words must stand in the document word for word: short notices of two
licenses differ in a word. A template may have several wordings.

All occurrences with a coverage of at least ``least`` are reported, those of one wording without overlap. Texts that are
alike (the notices of one family, a license and its parts) are all reported; the greatest coverage tells which one it is. Templates are few and given, so the index
goes to every task; ``MAX_TEMPLATE_BYTES`` is checked.

Defined cases: null or empty text, or a template without words, matches nothing; repeated rows
give repeated results; overlapping findings of several templates are all reported, ties in the
alignment go to the later start; an empty table gives an empty result; a null doc_id is kept;
other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import column, scan, texts_of

GRAM, WINNOW = 3, 3
BAND = 8
LEAST = 0.75
MAX_TEMPLATE_BYTES = 16 << 20

#: Templates of fewer words differ from each other in one word or two: they count only word for word.
SHORT = 16

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_MIT_DISCLAIMER = (
    _AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies."
)
_ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_BSD_SOURCE = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
)
_BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_PUBLIC_DOMAIN = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)


def _gpl_notice(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    )


#: Whole licenses, their parts, and the notices that go into files, as their authors publish them.
TEXTS = {
    "mit": f"{_MIT_GRANT} {_MIT_DISCLAIMER}",
    "mit-grant": _MIT_GRANT,
    "mit-disclaimer": _MIT_DISCLAIMER,
    "isc": f"{_ISC_GRANT} {_ISC_DISCLAIMER}",
    "isc-grant": _ISC_GRANT,
    "isc-disclaimer": _ISC_DISCLAIMER,
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_DISCLAIMER,
    "bsd": _BSD_SOURCE,
    "bsd-2-clause": f"{_BSD_SOURCE} {_BSD_BINARY} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"{_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "bsd-disclaimer": _BSD_DISCLAIMER,
    "unlicense": (
        _PUBLIC_DOMAIN + " In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS + " "
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "unlicense-grant": _PUBLIC_DOMAIN,
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
        "license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to "
        "permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, "
        "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all "
        "derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-notice": _gpl_notice("GNU General Public License", "3"),
    "gpl-2.0-notice": _gpl_notice("GNU General Public License", "2"),
    "lgpl-2.1-notice": _gpl_notice("GNU Lesser General Public License", "2.1"),
    "lgpl-3.0-notice": _gpl_notice("GNU Lesser General Public License", "3"),
    "agpl-3.0-notice": _gpl_notice("GNU Affero General Public License", "3"),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "epl-2.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
}

#: Names that the short notices give to a license.
NAMES = {
    "0bsd": ["BSD Zero Clause License"],
    "agpl-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "AGPLv3"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "bsd-2-clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "bsd-3-clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "bsl-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "epl-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GPLv2"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GPLv3"],
    "isc": ["ISC License"],
    "lgpl-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"],
    "lgpl-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3", "LGPLv3"],
    "mit": ["MIT License"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0"],
    "unlicense": ["Unlicense"],
    "zlib": ["zlib License"],
}
PHRASES = ["Licensed under", "Released under", "Distributed under", "Available under", "Under the terms of"]


def short_notices() -> dict[str, list[str]]:
    """Every phrase before every name of a license, with and without "the", and the license tag of its identifier."""
    names = {k: list(v) for k, v in NAMES.items()}
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        names[f"cc-{kind.lower()}-4.0"] = [f"CC {kind} 4.0", f"Creative Commons {kind} 4.0"]
    names["cc0-1.0"] = ["CC0 1.0", "Creative Commons CC0 1.0"]
    return {
        f"{key}-line": [f"{phrase} {the}{name}" for phrase in PHRASES for the in ("", "the ") for name in some] + [f"SPDX-License-Identifier: {key}"]
        for key, some in names.items()
    }


#: A template has one text or several wordings.
TEMPLATES: dict[str, str | list[str]] = {**TEXTS, **short_notices()}


class Templates:
    """Word hashes of each wording of a template and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str | list[str]]):
        pairs = [(name, text) for name in sorted(templates) for text in ([templates[name]] if isinstance(templates[name], str) else templates[name])]
        if sum(len(text) for _, text in pairs) > MAX_TEMPLATE_BYTES:
            raise ValueError("the templates are too large to be held by every task")
        self.names = [name for name, _ in pairs]
        self.words, grams, owner, at = [], [], [], []
        for k, (_, text) in enumerate(pairs):
            h = tx.Words([tx.as_bytes(text)], tx.ALNUM).hash
            self.words.append(h)
            g = tx.gram_hash(h, min(GRAM, max(len(h), 1))) if len(h) else np.zeros(0, np.uint64)
            if len(g):
                n = max(len(g) - WINNOW + 1, 1)
                # A short template counts only whole, so its last run of words, which ends its name, finds it.
                chosen = np.unique([i + int(np.argmin(g[i : i + WINNOW])) for i in range(n)]) if len(h) >= SHORT else np.array([len(g) - 1])
                grams.append(g[chosen])
                owner.append(np.full(len(chosen), k))
                at.append(chosen)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        order = np.argsort(cat(grams, np.uint64), kind="stable")
        self.key, self.owner, self.at = cat(grams, np.uint64)[order], cat(owner, np.int64)[order], cat(at, np.int64)[order]
        self.sizes = sorted({min(GRAM, len(h)) for h in self.words if len(h)})
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.key >> np.uint64(44)] = True

    def hits(self, w: tx.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the chunk, template, place in the template) of each fingerprint found."""
        out = []
        for k in self.sizes:
            g = tx.gram_hash(w.hash, k)
            p = np.flatnonzero(self.bits[g >> np.uint64(44)])
            p = p[w.doc[p] == w.doc[p + k - 1]]
            lo, hi = np.searchsorted(self.key, g[p], "left"), np.searchsorted(self.key, g[p], "right")
            n = hi - lo
            i = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((np.repeat(p, n), self.owner[i], self.at[i]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def align(template: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Longest common subsequence of a template and document words on diagonals low..high (place in doc less place in template).

    Returns (matched words, first, end) of the alignment with the shortest span, found row by row over the band only.
    """
    width = high - low + 1
    best = np.zeros(width + 1, np.int64)  # best[b]: matched words up to diagonal low + b; one spare column on the right
    begin = np.full(width + 1, -1, np.int64)
    end = np.full(width + 1, -1, np.int64)
    b = np.arange(width)
    for i, word in enumerate(template):
        j = i + low + b
        inside = (j >= 0) & (j < len(doc))
        equal = inside & (doc[np.clip(j, 0, len(doc) - 1)] == word)
        # From the diagonal (match or not), or with this template word missing in the document (diagonal + 1).
        diagonal, skip = best[:width] + equal, best[1 : width + 1]
        take = diagonal >= skip
        score = np.where(take, diagonal, skip)
        first = np.where(take, np.where(equal & (begin[:width] < 0), j, begin[:width]), begin[1 : width + 1])
        last = np.where(take, np.where(equal, j + 1, end[:width]), end[1 : width + 1])
        # A document word that the template lacks keeps what stands to the left.
        lead = np.maximum.accumulate(score)
        source = np.maximum.accumulate(np.where(score == lead, b, -1))
        best[:width], begin[:width], end[:width] = lead, first[source], last[source]
    top = int(np.argmax(best[:width]))
    return int(best[top]), int(begin[top]), int(end[top])


def chains(p: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Hits, given by place in the document, as disjoint chains that rise in both, the best first."""
    score, before = np.ones(len(p)), np.full(len(p), -1, np.int64)
    begin = np.searchsorted(p, p - size, "left")
    end = np.searchsorted(p, p, "left")
    for i in range(len(p)):
        j = slice(begin[i], end[i])
        if begin[i] < end[i]:
            gain = np.where(at[j] < at[i], score[j] - np.abs((p[i] - p[j]) - (at[i] - at[j])) / size, 0.0)
            k = len(gain) - 1 - int(np.argmax(gain[::-1]))
            if gain[k] > 0:
                score[i], before[i] = 1 + gain[k], begin[i] + k
    free, out = np.ones(len(p), bool), []
    for i in np.argsort(-score, kind="stable"):
        chain = []
        while i >= 0 and free[i]:
            free[i] = False
            chain.append(i)
            i = before[i]
        if chain:
            out.append(np.array(chain[::-1]))
    return out


def word_for_word(words: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, end, matched words) of a short template where a document has all of its words in a row, without overlap."""
    size, found = len(words), []
    for a in np.unique(starts).tolist():
        if a >= 0 and (not found or found[-1][1] <= a) and np.array_equal(doc[a : a + size], words):
            found.append((a, a + size, size))
    return found


def occurrences(words: np.ndarray, doc: np.ndarray, p: np.ndarray, at: np.ndarray, band: int, least: float) -> list[tuple[int, int, int]]:
    """(first, end, matched words) of the occurrences of a template around its hits in a document, without overlap."""
    size = len(words)
    if size < SHORT:
        return word_for_word(words, doc, p - at)

    def enough(some: np.ndarray) -> bool:
        return np.isin(words, some).sum() >= least * size  # no alignment matches more

    def settle(p, at, lo, hi):
        jump = np.abs(np.diff(p - at))
        if len(jump) and jump.max() > band:
            cut = int(jump.argmax()) + 1
            left = settle(p[:cut], at[:cut], lo, int(p[cut]))
            right = settle(p[cut:], at[cut:], left[-1][1], hi) if left else []
            if right:
                return left + right
        diagonal = p - at
        a, b = max(lo, int(diagonal[0]) - band), min(hi, int(diagonal[-1]) + size + band)
        if b <= a or not enough(doc[a:b]):
            return []
        matched, one, end = align(words, doc[a:b], int(diagonal.min()) - band - a, int(diagonal.max()) + band - a)
        return [(one + a, end + a, matched)] if matched >= least * size else []

    found: list[tuple[int, int, int]] = []
    if not enough(doc):
        return found
    order = np.lexsort((at, p))
    p, at = p[order], at[order]
    waiting = chains(p, at, size)[::-1]
    while waiting:
        chain = waiting.pop()
        # The part of the chain in the first free stretch is settled; the rest, and what a finding elsewhere leaves of it, is tried again.
        gap = np.array([bisect_right(found, (int(x), len(doc) + 1)) for x in p[chain]])
        taken = np.array([g > 0 and found[g - 1][1] > x for g, x in zip(gap, p[chain], strict=True)])
        chain, gap = chain[~taken], gap[~taken]
        if not len(chain):
            continue
        g = int(gap[0])
        here, rest = chain[gap == g], chain[gap != g]
        lo, hi = found[g - 1][1] if g else 0, found[g][0] if g < len(found) else len(doc)
        new = settle(p[here], at[here], lo, hi)
        found = sorted(found + new)
        waiting += [x for x in (rest, here if new else rest[:0]) if len(x)]
    return found


def scan_licenses(docs: DataFrame, templates: dict[str, str | list[str]] | None = None, band: int = BAND, least: float = LEAST) -> DataFrame:
    """doc_id, template, matched, coverage, first_word and end_word of each finding."""
    held = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))

    def work(batches):
        t = held.value
        for batch in batches:
            ids = column(batch, "doc_id").to_pylist()
            for first, texts in tx.chunks(texts_of(batch)):
                w = tx.Words(texts, tx.ALNUM)
                p, k, at = t.hits(w)
                d = w.doc[p]
                order = np.lexsort((k, d))
                p, k, at, d = p[order], k[order], at[order], d[order]
                new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])))) if len(p) else []
                out = {"doc_id": [], "template": [], "matched": [], "coverage": [], "first_word": [], "end_word": []}
                for a, b in zip(new, [*new[1:], len(p)] if len(new) else [], strict=True):
                    words = t.words[k[a]]
                    start, stop = w.offset[d[a]], w.offset[d[a] + 1]
                    for one, end, matched in occurrences(words, w.hash[start:stop], p[a:b] - start, at[a:b], band, least):
                        for c, v in zip(out, (ids[first + d[a]], t.names[k[a]], matched, matched / len(words), one, end), strict=True):
                            out[c].append(v)
                yield out

    schema = "doc_id long, template string, matched long, coverage double, first_word long, end_word long"
    return scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("coverage", F.round("coverage", 4))
