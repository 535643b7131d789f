"""License scans by a positional rare-token index (operator 1).

Templates of licence notices and texts are posted by word and position. The weights of their words come from the whole corpus: the
inverse document frequency. All places of each template's rarest words are looked up: HITS more than may be missing. Each posting says where its template
would begin, (place - position). Postings whose beginnings lie within a slack of each other, so that words may be inserted or left out, are
intersected: HITS different words of a template must agree. Then the longest common subsequence of the template and the text there must hold `cover` of
the template's words, and the template's key phrases must stand in that text, word by word.

Frequency decides on cost, never on labels: a text that holds `cover` of a template in order has HITS of the words that are looked up.

Short phrases are templates too, without alternatives: each place of a phrase's rarest word is looked up, and all words
are compared, so all places of a phrase are found.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopmark.llm.common import bounded_batches, id_and_text, pieces, tidy

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases whose places are all counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]  # phrases that must stand in the covered text


#: Different words of a template that must agree on where it begins, and words that may be inserted or left out: SLACK, or a fifth of a longer template.
HITS, SLACK = 3, 8

#: Licence notices in common use and whole licence texts, as words only; spelling and punctuation do not count.
TEMPLATES = (
    Template("mit", "released under the MIT License", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    Template("apache-2.0", "licensed under the Apache License Version 2.0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the License", ("except in compliance with the license",)),
    Template("gpl-3.0", "this work is licensed under the GNU General Public License version 3", ("general public license version 3",)),
    Template("gpl-2.0", "under the terms of the GNU General Public License version 2", ("general public license version 2",)),
    Template("gpl", "redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("cc-by-nc-4.0", "licensed under CC BY NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under CC BY SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "this work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", ("attribution noncommercial 4 0",)),
    Template("cc0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0 universal",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the Mozilla Public License v 2.0", ("mozilla public license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ("permission is hereby granted", "provided as is without warranty"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ("with or without fee is hereby granted",),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        ("redistributions in binary form must reproduce",),
    ),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache license version 2 0",),
    ),
    Template(
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        ("gnu general public license", "version 3 of the license"),
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class Index:
    """Postings of the templates' words, and of the phrases under their rarest word."""

    def __init__(self, templates: tuple[Template, ...], phrases: dict[str, str], idf: dict[bytes, float] | None = None):
        self.templates = [(t.label, words_of(t.text.encode()), [words_of(k.encode()) for k in t.keys]) for t in templates]
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases.items()]
        self.vocabulary = {w for _, words, _ in self.templates for w in words} | {w for words, _ in self.phrases for w in words}
        self.idf = idf or {}
        self.looked_up: dict[float, dict[bytes, list[tuple[int, int]]]] = {}
        self.masks: list[dict[bytes, int]] = []
        for _, words, _ in self.templates:
            mask: dict[bytes, int] = defaultdict(int)
            for i, w in enumerate(words):
                mask[w] |= 1 << i
            self.masks.append(dict(mask))
        self.anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for p, (words, _) in enumerate(self.phrases):
            i = max(range(len(words)), key=lambda i: (self.weight(words[i]), -i))
            self.anchors[words[i]].append((p, i))

    def weight(self, word: bytes) -> float:
        return self.idf.get(word, 1e9)

    def postings(self, cover: float) -> dict[bytes, list[tuple[int, int]]]:
        """Template and position of the words that are looked up: of each template the rarest, HITS more than may be missing."""
        if cover not in self.looked_up:
            out = self.looked_up[cover] = defaultdict(list)
            for t, (_, words, _) in enumerate(self.templates):
                missing = len(words) - needed(words, cover)
                for i in sorted(range(len(words)), key=lambda i: (-self.weight(words[i]), i))[: missing + HITS]:
                    out[words[i]].append((t, i))
        return self.looked_up[cover]

    def common(self, t: int, text: list[bytes]) -> int:
        """Words of the longest common subsequence of a template and a text; a bit of `row` is 0 where it grows."""
        masks, size = self.masks[t], len(self.templates[t][1])
        row = full = (1 << size) - 1
        for w in text:
            if m := masks.get(w):
                both = row & m
                row = ((row + both) | (row - both)) & full
        return size - row.bit_count()

    def scan(self, words: list[bytes], cover: float) -> tuple[list[int], set[str], set[str], float]:
        """Places of the phrases, their labels, the templates' labels, and the share of words of the best template."""
        postings = self.postings(cover)
        wanted = (postings.keys() | self.anchors.keys()).intersection(words)
        if not wanted:
            return [], set(), set(), 0.0
        starts: set[int] = set()
        base: set[str] = set()
        proposed: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for place, w in enumerate(words):
            if w in wanted:
                for p, i in self.anchors.get(w, ()):
                    phrase, label = self.phrases[p]
                    if place >= i and words[place - i : place - i + len(phrase)] == phrase:
                        starts.add(place - i)
                        base.add(label)
                for t, i in postings.get(w, ()):
                    proposed[t].append((place - i, i))
        labels: set[str] = set()
        score = 1.0 if starts else 0.0
        for t, found in proposed.items():
            label, template, keys = self.templates[t]
            least, slack = min(HITS, needed(template, cover)), slack_of(template)
            if len({i for _, i in found}) < least:
                continue
            for lo, hi in clusters(sorted(found), slack, least):
                text = words[max(0, lo - slack) : hi + len(template) + slack]
                share = self.common(t, text) / len(template)
                if share >= cover - 1e-9 and all(any(text[i : i + len(k)] == k for i in range(len(text) - len(k) + 1)) for k in keys):
                    labels.add(label)
                    score = max(score, share)
        return sorted(starts), base, labels, score


def needed(template: list[bytes], cover: float) -> int:
    return math.ceil(cover * len(template) - 1e-9)


def slack_of(template: list[bytes]) -> int:
    return max(SLACK, len(template) // 5)


def clusters(found: list[tuple[int, int]], slack: int, least: int) -> Iterator[tuple[int, int]]:
    """Of (beginning, position) in ascending order: first and last beginning of each run of neighbours within `slack` of the run's first,
    if its postings have `least` different positions. Runs begin at each posting that a run before does not reach."""
    last = -1
    for i, (lo, _) in enumerate(found):
        if i <= last:
            continue
        j, seen = i, set()
        while j < len(found) and found[j][0] - lo <= 2 * slack:
            seen.add(found[j][1])
            j += 1
        if len(seen) >= least:
            yield lo, found[j - 1][0]
            last = j - 1


def document_frequency(texts: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many of all texts each licence word stands; a task sends at most one count for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        n = 0
        for batch in batches:
            for _, part in pieces(batch):
                n += len(part)
                for t in part:
                    counts.update(vocabulary.intersection(_WORD.findall(t.lower())))
        yield pa.RecordBatch.from_pydict({"word": pa.array([*counts, None], pa.binary()), "n": pa.array([*counts.values(), n], pa.int64())})

    rows = texts.mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in rows}
    return counts, counts.pop(None, 0)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<long>"


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = 0.8, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base and places (starts of all phrases, in words from 0), first_word, last_word, base_labels,
    labels (with those of templates), score (share of the best accepted template's words that the text has in order; 1 for a phrase).

    `cover`: least share of a template's words, in their order; others may stand between them. Null and empty texts have no words, no labels and score 0; first_word and
    last_word are null without a place. Labels are distinct, sorted and comma-joined, or empty. One row for each row of
    the input, in two passes without a shuffle of texts; the counts that come to the driver are one for each licence word.
    """
    bounded_batches(df.sparkSession)
    texts = id_and_text(df, id_col, text_col)
    counts, n = document_frequency(texts, Index(templates, phrases).vocabulary)
    idf = {w: float(np.log((n + 1) / (c + 1))) for w, c in counts.items()}
    index = Index(templates, phrases, idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, part in pieces(batch):
                rows = []
                for t in part:
                    words = words_of(t)
                    at, base, more, score = index.scan(words, cover)
                    rows.append((len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted(base | more)), score, at))
                n_words, n_base, first, last, base_labels, labels, score, places = zip(*rows, strict=True)
                longs = pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n_words, longs), pa.array(n_base, longs), pa.array(first, longs), pa.array(last, longs), pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(places, pa.list_(longs))],
                    [f.split(" ")[0] for f in SCHEMA.split(", ")],
                )

    return texts.mapInArrow(tidy(run), SCHEMA)
