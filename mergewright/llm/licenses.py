"""License scans: winnowed fingerprints of templates pick candidates, and banded alignment measures them.

Templates and documents are sequences of words (letters and digits, lower case). Of every WINDOW neighbouring hashes of
GRAM words the least is a fingerprint; two texts that share GRAM + WINDOW - 1 words in a row share one. Fingerprints of
the templates form an inverted index, a few thousand numbers that travel to the tasks. In a document, hits of a template
are chained while each lies at most a template's length and GAP words behind the one before, forward in both texts; the
words around a chain are aligned with the template inside a band as wide as the chain's diagonals and BAND more on each
side, so words that were put into a notice, as a footer, don't part it. Matched words add; changed, added and missing words
cost. The words that tell a license from its siblings (MUST: versions, "nc", "lesser") have to match. Matches that cover
enough of the template are reported with their share, the words added in them and their span of characters; in a template
of less than SHORT words added words count against the share, for there they may change its meaning.

Cases: a null or empty text has no matches, and so no row; texts are read whole, and a match that comes several times is
reported each time; of overlapping matches the one that covers more of its template
(then the longer, the earlier, the first by name) stays; repeated rows repeat
their matches; an empty table gives none; only the key columns asked for are carried.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

GRAM, WINDOW, BAND, GAP, SHORT = 3, 2, 8, 64, 12
COVERAGE = 0.75
WORD = re.compile(r"[^\W_]+")

#: License texts and notices by SPDX identifier (fixed values: the licenses' own words).
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-1.1-notice": "Licensed under the Apache License, Version 1.1.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: Words that a match has to hold: they tell licenses apart (numbers always do).
MUST = {"lesser", "affero", "mozilla", "apache", "mit", "attribution", "sharealike", "noncommercial", "noderivatives", "by", "sa", "nc", "nd", "neither"}
#: Words that no match may add next to those: they would make another license of it.
OTHERS = ("lesser", "affero", "sharealike", "noncommercial", "noderivatives", "sa", "nc", "nd")


@lru_cache(maxsize=200_000)
def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def gram_hashes(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes) - GRAM + 1
    acc = np.zeros(max(n, 0), np.uint64)
    for i in range(GRAM):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + max(n, 0)]
    return acc


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """Places whose hash is the least of a window (the last of equal ones); short sequences keep their least."""
    g = gram_hashes(hashes)
    if len(g) == 0:
        return np.zeros(0, np.int64)
    w = min(WINDOW, len(g))
    view = np.lib.stride_tricks.sliding_window_view(g, w)[:, ::-1]
    return np.unique(np.arange(len(view)) + w - 1 - view.argmin(1))


def is_must(words: list[str]) -> np.ndarray:
    """Which words of a template have to match: those of MUST, and numbers that aren't a list's."""
    return np.array([w in MUST or (w.isdigit() and (i == 0 or words[i - 1] in ("version", "v", "attribution", "by", "sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives") or words[i - 1].isdigit())) for i, w in enumerate(words)], bool)


def index_of(templates: dict[str, str]) -> tuple[list[tuple[str, np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Templates as word hashes and which of the words must match, and the inverted index: sorted fingerprint hashes, with
    template and place."""
    words = []
    for name, text in sorted(templates.items()):
        ws = WORD.findall(text.lower())
        words.append((name, np.array([_hash(w) for w in ws], np.uint64), is_must(ws)))
    rows = [(int(gram_hashes(h)[p]), i, int(p)) for i, (_, h, _) in enumerate(words) for p in fingerprints(h)]
    rows.sort()
    return words, np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)


#: A cell of the alignment is one number: its score, then its matched words, then how early it begins; so a maximum takes
#: the best score, of equal ones the most words, of equal ones the earliest.
_SCORE, _MATCH, _EARLY = 1 << 44, 1 << 24, (1 << 24) - 1
_NONE = -(1 << 62)


def align(doc: np.ndarray, template: np.ndarray, low: int, high: int, must: np.ndarray | None = None) -> tuple[int, int, int]:
    """Matched words and the span (first, end) of doc in the best alignment on diagonals low to high (place in doc less
    place in the template); 0 matched words where there is none.

    The whole template is laid against any part of the document: a match adds 2; a changed, missing or added word costs 1, but
    words added at one place cost SHORT at most (a footer between two pages is one thing). Words that must match are neither changed nor missing. doc has less than 2**24 words.
    """
    k = np.arange(high - low + 1)
    at = low + k
    row = np.where((at >= 0) & (at <= len(doc)), _EARLY - np.clip(at, 0, _EARLY), _NONE)
    padded = np.append(doc, np.uint64(0))
    for i, w in enumerate(template.tolist()):
        j = at + i  # place in doc of the word that stands against this one, by diagonal
        inside = (j >= 0) & (j < len(doc))
        hit = inside & (padded[np.clip(j, 0, len(doc))] == np.uint64(w))
        fixed = must is not None and must[i]
        new = np.where(hit, row + 2 * _SCORE + _MATCH, _NONE if fixed else np.where(inside, row - _SCORE, _NONE))
        new[row <= _NONE // 2] = _NONE
        if not fixed:  # the template's word is missing
            new[:-1] = np.maximum(new[:-1], np.where((row[1:] > _NONE // 2) & (j[:-1] + 1 <= len(doc)), row[1:] - _SCORE, _NONE))
        # Words of the document are added: each step to a higher diagonal costs 1, and a jump of any width SHORT.
        new = np.maximum(np.maximum.accumulate(new + k * _SCORE) - k * _SCORE, np.maximum.accumulate(new) - SHORT * _SCORE)
        row = np.where((j >= -1) & (j < len(doc)) & (new > _NONE // 2), new, _NONE)
    best = int(row.argmax())
    if row[best] <= _NONE // 2:
        return 0, 0, 0
    value = int(row[best])
    return (value % _SCORE) // _MATCH, _EARLY - value % _MATCH, low + best + len(template)


def chains(places: np.ndarray, spots: np.ndarray, reach: int) -> list[tuple[int, int, int]]:
    """First place, lowest and highest diagonal of the runs of hits that may be one match, by place in the document.

    places: in the document, in order; spots: in the template. A hit goes on with the run, of those that end before it in
    both and within reach, whose last diagonal is nearest to its own (then the one of most hits), and begins one where there is
    none. A fingerprint that stands twice in the template has a hit for each spot, so some runs are such echoes, and an echo
    may take what belongs to its neighbour: each run is also given together with all that begin within reach behind it.
    """
    runs: list[list[int]] = []  # first place, last place, last spot, hits, low, high
    live: list[list[int]] = []
    for p, q in zip(places.tolist(), spots.tolist(), strict=True):
        live = [r for r in live if p - r[1] <= reach]
        fit = [r for r in live if r[1] < p and r[2] < q]
        if fit:
            run = min(fit, key=lambda r: (abs(p - q - r[1] + r[2]), -r[3]))
            run[1:] = p, q, run[3] + 1, min(run[4], p - q), max(run[5], p - q)
        else:
            run = [p, p, q, 1, p - q, p - q]
            runs.append(run)
            live.append(run)
    out = {(r[0], r[4], r[5]) for r in runs}
    for i, r in enumerate(runs):
        low, high = r[4], r[5]
        for other in runs[i + 1 :]:
            if other[0] - r[0] > reach:
                break
            # Diagonals further apart than the reach are no one match.
            if max(high, other[5]) - min(low, other[4]) <= reach:
                low, high = min(low, other[4]), max(high, other[5])
        out.add((r[0], low, high))
    return sorted(out)


def find(text: str, index, least: float = COVERAGE) -> list[tuple[str, int, int, float, int, int, int]]:
    """(template, matched words, words of the template, coverage, words added, first character, end character) of each
    match."""
    templates, keys, owner, place = index
    low = text.lower()
    ws = WORD.findall(low)
    if len(ws) < GRAM or not len(keys):
        return []
    h = np.array([_hash(w) for w in ws], np.uint64)
    g = gram_hashes(h)
    at = fingerprints(h)
    lo, hi = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
    some = hi > lo
    hits = np.array(sorted({(int(owner[k]), int(p), int(place[k])) for p, a, b in zip(at[some], lo[some], hi[some], strict=True) for k in range(a, b)}), np.int64).reshape(-1, 3)
    found = set()
    for t in np.unique(hits[:, 0]).tolist():
        name, words, must = templates[t]
        own = hits[hits[:, 0] == t]
        for _, d_low, d_high in chains(own[:, 1], own[:, 2], len(words) + GAP):
            # Few words before the first hit or behind the last one may stand apart from it without a fingerprint of their own:
            # where a good part of the template matched, but not all, the band is widened by as much as may be put in.
            best = (0, 0, 0)
            for wider in (BAND, BAND + GAP):
                start = max(0, d_low - wider)
                matched, first, end = align(h[start : d_high + len(words) + wider + 1], words, d_low - wider - start, d_high + wider - start, must)
                best = max(best, (matched, -start - first, start + end))
                if matched == len(words) or 3 * matched < len(words):
                    break
            matched, first, end = best[0], -best[1], best[2]
            added = max(0, end - first - len(words))
            spread = len(words) + (added if len(words) < SHORT else 0)
            if matched and matched >= least * spread and end > first and not _another(ws[first:end], words):
                found.add((name, matched, len(words), added, first, end))
    kept: list[tuple[str, int, int, int, int, int]] = []
    ends: list[tuple[int, int]] = []
    for m in sorted(found, key=lambda m: (-m[1], m[2], m[4], m[0])):
        k = bisect_left(ends, (m[4], 0))
        if (k == 0 or ends[k - 1][1] <= m[4]) and (k == len(ends) or ends[k][0] >= m[5]):
            kept.append(m)
            ends.insert(k, (m[4], m[5]))
    if not kept:
        return []
    # Lower case may change a text's length, so the spans are taken from a lower-cased text of equal length.
    same = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans = [m.span() for m in WORD.finditer(same)]
    return [(name, matched, n, matched / n, added, spans[min(a, len(spans) - 1)][0], spans[min(b, len(spans)) - 1][1]) for name, matched, n, added, a, b in sorted(kept, key=lambda m: (m[4], m[0]))]


def _another(span: list[str], template: np.ndarray) -> bool:
    """Whether the span holds one of OTHERS that the template doesn't."""
    own = set(template.tolist())
    return len(template) < 3 * SHORT + 10 and any(w in span and _hash(w) not in own for w in OTHERS)


def scan(docs: DataFrame, keys: list[str], templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """The key columns, license, matched_words, template_words, coverage, added_words, start_char and end_char of each match."""
    results = [("license", T.StringType()), ("matched_words", T.LongType()), ("template_words", T.LongType()), ("coverage", T.DoubleType()), ("added_words", T.LongType()), ("start_char", T.LongType()), ("end_char", T.LongType())]
    if clash := {n for n, _ in results} & set(keys):
        raise ValueError(f"key columns clash with results: {sorted(clash)}")
    schema = T.StructType([*(docs.schema[k] for k in keys), *(T.StructField(n, t) for n, t in results)])
    sent, n = docs.sparkSession.sparkContext.broadcast(templates or TEMPLATES), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(sent.value)
        for b in common.sliced(batches, "__text"):
            rows = [(i, *m) for i, t in enumerate(common.texts(b.column(n))) for m in find(t, index, least)]
            if rows:
                at, *columns = zip(*rows, strict=True)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns[:n]), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return docs.select(*keys, F.col("text").alias("__text")).mapInArrow(run, schema)
