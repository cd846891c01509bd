"""Operator 8, license scans: a positional index of rare licence words.

The index posts every word of the templates below with its positions; inverse document frequencies of these words
are counted over all documents. Of a file, the templates are looked at whose words it has, but for as many as may
be missing. For each of them, the file's licence words of highest inverse document frequency are looked up: one for
a short phrase, and for a long template so many that two of them stand in place in every match. Their occurrences
less their posted positions say where the template would start; places where the postings of two words agree, but for DRIFT of
the template's length (words put in or left out), are intersections. There, a short phrase must match in full;
a long template matches if SHARE of its words stand in the file in order and its mandatory key phrases do word for word.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import with_columns_from_text
from .words import slice_hashes, words

SHARE = 0.8
LONG = 10
DRIFT = 0.1
# Base phrases and their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_WARRANTY = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GNU = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation either version {1} of the license or at your option any later version "
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0}general public license for more details"
)
# Licences and licence notices as their publishers word them, the label, and the key phrases that must be there.
TEMPLATES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to "
        "use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _WARRANTY + "noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit", ("permission is hereby granted free of charge", "included in all copies or substantial portions of the software"),
    ),
    (_BSD + _BSD_WARRANTY, "bsd", ("source and binary forms", "retain the above copyright notice")),
    (
        _BSD + "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_WARRANTY,
        "bsd-3", ("source and binary forms", "endorse or promote products derived from this software"),
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc", ("for any purpose with or without fee",),
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
        "zlib", ("must not be misrepresented",),
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense", ("released into the public domain",),
    ),
    (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software "
        "and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
        "bsl-1", ("any person or organization",),
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache-2", ("in compliance with the license", "on an as is basis"),
    ),
    (_GNU.format("", "2"), "gpl-2", ("gnu general public license", "either version 2 of the license")),
    (_GNU.format("", "3"), "gpl-3", ("gnu general public license", "either version 3 of the license")),
    (_GNU.format("affero ", "3"), "agpl", ("gnu affero general public license",)),
    (_GNU.format("lesser ", "3"), "lgpl", ("gnu lesser general public license",)),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", ("permission is hereby granted free of charge",)),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2", ("in compliance with the license",)),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", ("source and binary forms",)),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", ("for any purpose with or without fee",)),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", ("gnu general public license",)),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl", ("gnu lesser general public license",)),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", ("mozilla public license",)),
    ("this is free and unencumbered software released into the public domain", "unlicense", ("released into the public domain",)),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc", ("attribution noncommercial",)),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa", ("attribution sharealike",)),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", ("attribution 4 0",)),
    ("gnu general public license version 3", "gpl-3", ()),
    ("gnu general public license version 2", "gpl-2", ()),
    ("gnu affero general public license", "agpl", ()),
    ("mozilla public license version 2", "mpl-2", ()),
    ("boost software license version 1", "bsl-1", ()),
    ("creative commons attribution 4 0", "cc-by", ()),
    ("cc by sa", "cc-by-sa", ()),
    ("cc by 4", "cc-by", ()),
    ("cc0 1 0 universal", "cc0", ()),
)
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_BITS = 16


def _hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(slice_hashes(b, np.array([0]), np.array([len(b)]))[0])


class LicenceWords:
    """The distinct words of all templates, found in texts by their hashes."""

    def __init__(self) -> None:
        by_hash = sorted((_hash(x), x) for x in {x for phrase, *_ in (*BASE_PHRASES, *TEMPLATES) for x in phrase.split()})
        self.words = [x for _, x in by_hash]
        self.number = {x: k for k, x in enumerate(self.words)}
        self.hashes = np.array([h for h, _ in by_hash], np.uint64)
        self.there = np.zeros(1 << _BITS, bool)
        self.there[self.hashes >> np.uint64(64 - _BITS)] = True

    def find(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of words of a text, and places and numbers of the licence words among them."""
        h = words((text or "").encode().translate(_FOLD))[2]
        places = np.flatnonzero(self.there[h >> np.uint64(64 - _BITS)])
        at = np.minimum(np.searchsorted(self.hashes, h[places]), len(self.hashes) - 1)
        same = self.hashes[at] == h[places]
        return len(h), places[same], at[same]


@dataclass
class Template:
    own: np.ndarray  # numbers of its words
    label: str
    keys: list[list[int]]
    anchors: list[int]  # its distinct words by inverse document frequency, highest first
    missing: int  # how many of its words may be missing
    where: dict[int, list[int]] = field(init=False)  # the places of each of its words, last first

    def __post_init__(self) -> None:
        self.where = {}
        for i, a in reversed(list(enumerate(self.own.tolist()))):
            self.where.setdefault(a, []).append(i)


@dataclass
class LicenseIndex:
    vocabulary: LicenceWords
    templates: list[Template]
    has: np.ndarray  # (templates, words): which words a template has
    base: int

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and (template, first word, share of its words in place) of each match."""
        n, places, number = self.vocabulary.find(text)
        if not len(places):
            return n, []
        present = np.zeros(self.has.shape[1], np.float32)
        present[number] = 1
        lacking = self.has.sum(1) - self.has @ present
        found = []
        for k, t in enumerate(self.templates):
            if lacking[k] <= t.missing:
                found += [(k, start, share) for start, share in self._places(t, places, number, present)]
        return n, found

    def _places(self, t: Template, places: np.ndarray, number: np.ndarray, present: np.ndarray) -> list[tuple[int, float]]:
        looked = [a for a in t.anchors if present[a]][: 1 if len(t.own) < LONG else t.missing + 2]
        votes = []  # (start, anchor)
        for a in looked:
            at = places[number == a]
            starts = (at[:, None] - np.flatnonzero(t.own == a)[None]).ravel()
            votes.append(np.stack([starts, np.full(len(starts), a)], 1))
        votes = np.concatenate(votes)
        if len(t.own) < LONG:
            return [(int(s), 1.0) for s in np.unique(votes[:, 0]) if s >= 0 and self._stand(t.own, int(s), places, number)]
        votes = votes[np.lexsort((votes[:, 1], votes[:, 0]))]
        drift = max(3, int(DRIFT * len(t.own)))
        # of a run of votes, up to one drift long, at least two anchors
        last = np.searchsorted(votes[:, 0], votes[:, 0] + drift, "right")
        changes = np.concatenate([[0], np.cumsum(votes[1:, 1] != votes[:-1, 1])])
        starts = np.unique(votes[changes[last - 1] > changes, 0])
        # the first of each band of half a drift: an alignment reaches two drifts to both sides
        starts = starts[np.unique(starts // max(1, drift // 2), return_index=True)[1]]
        starts = starts[self._in_place(t, starts, drift, places, number) >= SHARE * len(t.own) - 1e-9]
        found, until = [], -math.inf
        for start in starts.tolist():
            if start > until and (match := self._aligned(t, start, drift, places, number)):
                found.append(match)
                until = start + drift
        return found

    @staticmethod
    def _in_place(t: Template, starts: np.ndarray, drift: int, places: np.ndarray, number: np.ndarray) -> np.ndarray:
        """For each start, how many of the template's words stand at most 2 * drift off their places, in any order: no alignment has more."""
        at = {a: places[number == a] for a in t.where}
        out = np.zeros(len(starts), np.int64)
        if len(starts):
            for i, a in enumerate(t.own.tolist()):
                out += np.searchsorted(at[a], starts + (i + 2 * drift), "right") > np.searchsorted(at[a], starts + (i - 2 * drift), "left")
        return out

    @staticmethod
    def _stand(own, start: int, places: np.ndarray, number: np.ndarray) -> bool:
        """Whether these words stand from a place on."""
        at = int(np.searchsorted(places, start))
        end = at + len(own)
        return end <= len(places) and places[at] == start and places[end - 1] == start + len(own) - 1 and bool((number[at:end] == own).all())

    def _aligned(self, t: Template, start: int, drift: int, places: np.ndarray, number: np.ndarray) -> tuple[int, float] | None:
        """First word and share of the template's words that stand in order at most 2 * drift off their places, if it is a match."""
        low, high = np.searchsorted(places, [start - drift, start + len(t.own) + 2 * drift])
        tails: list[int] = []  # of increasing runs of template positions, by length
        first = None
        for p, a in zip(places[low:high].tolist(), number[low:high].tolist()):
            for i in t.where.get(a, ()):
                if abs(p - i - start) <= 2 * drift:
                    first = p if first is None else first
                    k = bisect_left(tails, i)
                    tails[k : k + 1] = [i]
        share = len(tails) / len(t.own)
        if share < SHARE:
            return None
        near = range(start - drift, start + len(t.own) + 2 * drift)
        if all(any(self._stand(key, int(p), places, number) for p in places[low:high][number[low:high] == key[0]] if p in near) for key in t.keys):
            return first, share
        return None


def word_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, list[int]]:
    """Number of documents, and of those with each licence word (as many rows as there are licence words)."""
    vocabulary = LicenceWords()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, each = 0, np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                each[np.unique(vocabulary.find(text)[2])] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(each)), -1], pa.int32()), pa.array([*each.tolist(), n], pa.int64())], names=["word", "n"])

    counts = {r["word"]: r["n"] for r in docs.select(text_col).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return counts.get(-1, 0), [counts.get(k, 0) for k in range(len(vocabulary.words))]


def build_index(n_docs: int, frequency: list[int]) -> LicenseIndex:
    v = LicenceWords()
    idf = [math.log((1 + n_docs) / (1 + n)) for n in frequency]
    templates = []
    for phrase, label, keys in [*((p, label, ()) for p, label in BASE_PHRASES), *TEMPLATES]:
        own = np.array([v.number[x] for x in phrase.split()])
        missing = int((1 - SHARE) * len(own) + 1e-9) if len(own) >= LONG else 0
        templates.append(Template(own, label, [[v.number[x] for x in k.split()] for k in keys], sorted(set(own.tolist()), key=lambda a: (-idf[a], v.words[a])), missing))
    has = np.zeros((len(templates), len(v.words)), np.float32)
    for k, t in enumerate(templates):
        has[k, t.own] = 1
    return LicenseIndex(v, templates, has, len(BASE_PHRASES))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`row` and `out` (SCHEMA) per row of docs.

    A null text is empty: no words, no places, labels "" and score 0. Labels are distinct, sorted and
    comma-joined; the score is the largest share of a matching template's words in place. Every row is
    scanned by itself, so repeated rows give the same.
    """
    index = build_index(*word_frequencies(docs, text_col))

    def compute(texts: list[str | None]) -> list[pa.Array]:
        rows = []
        for text in texts:
            n, matches = index.scan(text)
            base = [start for k, start, _ in matches if k < index.base]
            join = lambda ks: ",".join(sorted({index.templates[k].label for k in ks}))
            rows.append((n, len(base), min(base, default=None), max(base, default=None), join(k for k, *_ in matches if k < index.base), join(k for k, *_ in matches), max((s for *_, s in matches), default=0.0)))
        columns = list(zip(*rows)) or [()] * 7
        return [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()])]

    return with_columns_from_text(docs, text_col, SCHEMA, compute)
