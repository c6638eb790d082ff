"""Licence scans: passages of a text compared with licence templates.

A text is cut into segments at line ends and after sentences; a passage is a run of neighbouring
segments. Both sides are normalised to lower-case words, and a passage matches a template if the
Dice coefficient of their bags of word bigrams reaches the threshold. Passages and templates whose
sizes alone rule that out are never compared: with threshold t, sizes differ by a factor of
(2 - t) / t at most, and t / (2 - t) of a passage's bigrams must be known from templates.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import LOWER, UPPER, Batches, arrow_map, arrow_type

THRESHOLD = 0.8

# Notices as licences ask for them to be written.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed "
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal."],
}

_WORDS = bytes(LOWER[UPPER.index(b)] if b in UPPER else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_SEGMENT = re.compile(rb"\n|(?<=[.!?;])[ \t\r]")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Templates:
    """Bigrams of all templates, with counts, over one vocabulary."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold, self.least = threshold, threshold / (2 - threshold)
        self.vocabulary: dict[bytes, int] = {}
        self.names, self.bags = [], []
        for name, texts in templates.items():
            for text in texts:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text.encode())]
                if len(ids) > 1:
                    self.names.append(name)
                    self.bags.append(np.unique(np.array([a << 20 | b for a, b in zip(ids, ids[1:])], np.int64), return_counts=True))
        self.sizes = np.array([counts.sum() for _, counts in self.bags], np.int64)
        self.known = np.unique(np.concatenate([b for b, _ in self.bags])) if self.bags else np.empty(0, np.int64)

    def best(self, bigrams: np.ndarray, size: int) -> tuple[float, int]:
        """Best template for a passage of ``size`` bigrams, of which ``bigrams`` are known ones."""
        score, which = 0.0, -1
        codes, counts = np.unique(bigrams, return_counts=True)
        for k in np.flatnonzero((self.sizes >= self.least * size) & (self.least * self.sizes <= size)).tolist():
            of, most = self.bags[k]
            at = np.minimum(np.searchsorted(of, codes), len(of) - 1)
            dice = 2 * int(np.minimum(counts, most[at])[of[at] == codes].sum()) / (size + int(self.sizes[k]))
            if dice > score:
                score, which = dice, k
        return score, which

    def scan(self, text: bytes) -> list[tuple[int, int, str, float]]:
        """Best passages: first and last segment, licence, coefficient; none overlap."""
        if not len(self.known):
            return []
        segments = [words_of(s) for s in _SEGMENT.split(text)]
        words = [w for s in segments for w in s]
        if len(words) < 2:
            return []
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        codes = ids[:-1] << 20 | ids[1:]
        known = (ids[:-1] > 0) & (ids[1:] > 0)
        known[known] = self.known[np.minimum(np.searchsorted(self.known, codes[known]), len(self.known) - 1)] == codes[known]
        if not known.any():
            return []
        total = np.concatenate([[0], np.cumsum(known)])
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))
        begins = np.concatenate([[0], ends[:-1]])
        first, last = np.minimum(begins, len(codes)), np.maximum(ends - 1, 0)  # bigrams of segments i to j: first[i] to last[j]
        # A run needs hits >= least * bigrams: its surplus, a difference of two running ones, is not negative.
        surplus = total - self.least * np.arange(len(total))
        reach = np.maximum.accumulate(surplus[last][::-1])[::-1]
        # A run whose first segment begins no known bigram is worse than the same run without it.
        begun = total[np.minimum(ends, len(codes))] > total[first]
        longest = self.sizes.max() / self.least
        found = []
        for i in np.flatnonzero(begun & (reach >= surplus[first] - 1e-9)).tolist():
            stop = int(np.searchsorted(last, first[i] + longest, "right"))
            j = np.arange(i, stop)
            n = last[i:stop] - first[i]
            for k in j[(n > 0) & (surplus[last[i:stop]] >= surplus[first[i]] - 1e-9)].tolist():
                a, b = int(first[i]), int(last[k])
                score, which = self.best(codes[a:b][known[a:b]], b - a)
                if score >= self.threshold:
                    found.append((score, i, k, self.names[which]))
        found.sort(key=lambda f: (-f[0], f[1], f[2], f[3]))
        out, taken = [], set()
        for score, i, j, name in found:
            if taken.isdisjoint(range(i, j + 1)):
                taken.update(range(i, j + 1))
                out.append((i, j, name, score))
        return sorted(out)


def _scan(batches: Batches, schema: pa.Schema, templates: dict[str, list[str]], threshold: float) -> Batches:
    known = Templates(templates, threshold)
    for batch in batches:
        found = [known.scan(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        rows = [[{"first": a, "last": b, "licence": name, "dice": s} for a, b, name, s in f] for f in found]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, schema.field("matches").type)], schema=schema)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Licence passages of every row of ``docs`` (``doc_id``, ``text``): ``doc_id, matches``.

    A match has its first and last segment (counted from 0), the licence and the Dice coefficient;
    of overlapping passages the best stays, ties to the earlier and shorter one, then by template
    order. Null and empty texts have no matches. Repeated rows are scanned each; other columns are
    ignored. The templates are parameters of the tasks: a few kilobytes.
    """
    kind = docs.schema["doc_id"].dataType
    match = T.StructType(
        [T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType())]
    )
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("matches", T.ArrayType(match))])
    schema = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in out.fields])
    fn = partial(_scan, schema=schema, templates=TEMPLATES if templates is None else templates, threshold=threshold)
    return arrow_map(docs.select("doc_id", "text"), fn, out)
