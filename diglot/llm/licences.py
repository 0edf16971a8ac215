"""License scans: TF-IDF cosine of lines and files to templates, then inheritance from the nearest directory.

Templates are short public notices, the headers that licences ask for in source files, whole short licences, and
the heads of long ones. The weights of their words come from the corpus: a word that few
documents have weighs more. Each line of a document, and each run of as many words as a template has, across
lines or inside one, is a sparse TF-IDF vector (words outside the templates have the greatest weight); the best
cosine over templates names the licence if it is `least` or more. Words that are comment marks only don't count. Runs are looked at around anchors only: a
cosine of `least` needs template words with `least`**2 of its squared weight, so one at least of the rarest
words that hold more than the rest. A document whose licence lines and runs are four fifths of its words or
more, or that begins with the head of a long licence, is a licence file of its directory. A document without a notice of its own inherits from the nearest
ancestor directory that has a licence file: ancestors are exploded from the path and joined with the
directories' licences.

Counting and matching are map-only but for one row of counts a task; the path join moves ids and paths.
Equal (directory, licence) rows are summed first, so a directory with a third of all files is one row.

Defined cases: a null or empty text has no notice; a very long text is scanned whole; ties between templates go to the first name; a file
without a directory part lies in the root ''; a directory with several licences takes the most
frequent, then the first name; repeated rows are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diglot.llm import words
from diglot.storage import materialise

APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
)
MIT_TEXT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
    "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
MIT_GRANT = MIT_TEXT[: MIT_TEXT.index(" The above copyright notice")]
GNU_HEADER = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, "
    "either version {n} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."
)
GNU_GRANT = GNU_HEADER[: GNU_HEADER.index(" This {what} is distributed")]
GNU_HEAD = "GNU {kind}GENERAL PUBLIC LICENSE Version {n}, {date} Copyright (C) {year} Free Software Foundation, Inc. {where} Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_3 = BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_TEXT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE '
    "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
UNLICENSE_TEXT = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
    "binary, for any purpose, commercial or non-commercial, and by any means."
)
MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)
#: The heads of licences that fill a file: a document that begins with one is a licence file.
HEADS: dict[str, list[str]] = {
    "AGPL-3.0": [GNU_HEAD.format(kind="AFFERO ", n=3, date="19 November 2007", year=2007, where="<https://fsf.org/>")],
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "CC-BY-4.0": ["Attribution 4.0 International Creative Commons Corporation is not a law firm and does not provide legal services or legal advice."],
    "GPL-2.0": [GNU_HEAD.format(kind="", n=2, date="June 1991", year="1989, 1991", where="51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA")],
    "GPL-3.0": [GNU_HEAD.format(kind="", n=3, date="29 June 2007", year=2007, where="<https://fsf.org/>")],
    "LGPL-3.0": [GNU_HEAD.format(kind="LESSER ", n=3, date="29 June 2007", year=2007, where="<https://fsf.org/>")],
    "MPL-2.0": ["Mozilla Public License Version 2.0 1. Definitions"],
}
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": ["SPDX-License-Identifier: AGPL-3.0-or-later", GNU_HEADER.format(what="program", kind="Affero ", n=3), GNU_GRANT.format(what="program", kind="Affero ", n=3)],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");', APACHE_HEADER],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause", BSD_2 + BSD_END],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted.", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License.", BSD_3 + BSD_END],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0", GNU_HEADER.format(what="program", kind="", n=2), GNU_GRANT.format(what="program", kind="", n=2)],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0", GNU_HEADER.format(what="program", kind="", n=3), GNU_GRANT.format(what="program", kind="", n=3)],
    "ISC": ["SPDX-License-Identifier: ISC", ISC_TEXT],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0", GNU_HEADER.format(what="library", kind="Lesser ", n=3), GNU_GRANT.format(what="library", kind="Lesser ", n=3)],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, as in the MIT License.", "The MIT License (MIT)", MIT_GRANT, MIT_TEXT],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", MPL_HEADER],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", UNLICENSE_TEXT],
}
for _name, _heads in HEADS.items():
    TEMPLATES.setdefault(_name, []).extend(_heads)
_HEADS = frozenset(x for heads in HEADS.values() for x in heads)
FOUND = "line long, license string, score double, words long, licence_words long"


class Vectors:
    """The templates as unit TF-IDF vectors over their own words."""

    def __init__(self, templates: dict[str, list[str]], documents: int = 0, having: np.ndarray | None = None):
        flat = [(name, t) for name in sorted(templates) for t in templates[name]]
        self.names = [n for n, _ in flat]
        self.head = np.array([t in _HEADS for _, t in flat])
        w = words.split(pa.array([t for _, t in flat], pa.string()), lower=True)
        self.vocabulary, which = np.unique(w.hash, return_inverse=True)
        seen = np.zeros(len(self.vocabulary)) if having is None else having
        self.idf = np.log((1 + documents) / (1 + seen)) + 1
        self.idf_other = math.log(1 + documents) + 1
        tf = np.zeros((len(flat), len(self.vocabulary)))
        np.add.at(tf, (w.row, which), 1)
        full = tf * self.idf
        self.matrix = full / np.sqrt((full**2).sum(1, keepdims=True))
        self.length = tf.sum(1).astype(np.int64)
        self.screen = np.zeros(1 << 16, bool)
        self.screen[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def anchors(self, least: float) -> np.ndarray:
        """For each template, the words of which a vector with a cosine of least has one at least."""
        order = np.argsort(-np.where(self.matrix > 0, self.idf, -1.0), 1, kind="stable")
        held = np.cumsum(np.take_along_axis(self.matrix, order, 1) ** 2, 1)
        need = (held <= 1 - least * least + 1e-9).sum(1) + 1
        out = np.zeros(self.matrix.shape, bool)
        np.put_along_axis(out, order, np.arange(self.matrix.shape[1])[None] < need[:, None], 1)
        return out & (self.matrix > 0)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, or -1."""
        out = np.full(len(hashes), -1)
        maybe = np.flatnonzero(self.screen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        good = self.vocabulary[at] == hashes[maybe]
        out[maybe[good]] = at[good]
        return out

    def cosines(self, place: np.ndarray, hashes: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """The best template and its cosine for each group of words."""
        known = place >= 0
        tf = np.zeros((groups, len(self.vocabulary)))
        np.add.at(tf, (group[known], place[known]), 1)
        order = np.lexsort((hashes[~known], group[~known]))
        g, h = group[~known][order], hashes[~known][order]
        first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])])) if len(g) else np.zeros(0, int)
        times = np.diff(np.append(first, len(g)))
        other = np.bincount(g[first], (times * self.idf_other) ** 2, groups)
        full = tf * self.idf
        norm = np.sqrt((full**2).sum(1) + other)
        score = full @ self.matrix.T / np.where(norm == 0, 1, norm)[:, None]
        best = score.argmax(1)
        return best, score[np.arange(groups), best]


def without_marks(w: words.Words) -> words.Words:
    """w without the words that are comment marks only."""
    text = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(~_MARK[w.data], out=text[1:])
    keep = text[w.last] > text[w.first]
    return words.Words(w.hash[keep], w.row[keep], w.first[keep], w.last[keep], np.bincount(w.row[keep], minlength=len(w.count)), w.data, w.offsets)


_MARK = np.zeros(256, bool)
_MARK[list(b"*#/\\-;!<>%=|+~")] = True


def line_of_word(w: words.Words) -> np.ndarray:
    """For each word, the number of its line over all rows; a row begins a line."""
    cuts = np.zeros(len(w.data) + 1, np.int64)
    cuts[1:] = w.data == 10
    starts = w.offsets[:-1]
    np.add.at(cuts, starts, 1)
    return np.cumsum(cuts)[w.first]


def runs(w: words.Words, vectors: Vectors, place: np.ndarray, least: float) -> list[tuple[int, int, int, float]]:
    """(first word, words, template, cosine) of the runs as long as a template that come close to one of that length; longest and closest first."""
    out = []
    bounds = w.bounds()
    anchors = vectors.anchors(least)
    known = np.flatnonzero(place >= 0)
    for size in np.unique(vectors.length):
        wanted = anchors[vectors.length == size].any(0)
        at = known[wanted[place[known]]]
        if not len(at):
            continue
        low, high = bounds[w.row[at]], bounds[w.row[at] + 1] - size
        starts = (at[:, None] - np.arange(size)[None]).ravel()
        starts = np.unique(starts[(starts >= np.repeat(low, size)) & (starts <= np.repeat(high, size))])
        for a in range(0, len(starts), 1024):
            s = starts[a : a + 1024]
            which = (s[:, None] + np.arange(size)[None]).ravel()
            best, score = vectors.cosines(place[which], w.hash[which], np.repeat(np.arange(len(s)), size), len(s))
            out += [(int(s[k]), int(size), int(best[k]), float(score[k])) for k in np.flatnonzero(score >= least) if vectors.length[best[k]] == size]
    return sorted(out, key=lambda x: (-x[1], -x[3], x[0]))


def find(w: words.Words, vectors: Vectors, least: float) -> list[tuple[int, str | None, float, int]]:
    """For each row: line of the best notice, licence, cosine, words in licence lines and runs (all words of a row that begins with a head)."""
    w = without_marks(w)
    place = vectors.places(w.hash)
    covered = np.zeros(len(w.hash), bool)
    line = line_of_word(w)
    rows = len(w.count)
    out: list[list] = [[None, None, 0.0, 0] for _ in range(rows)]
    # lines where a quarter of the words is known can reach the least cosine; each word outside weighs the most
    ids, group = np.unique(line, return_inverse=True)
    if not len(ids):
        return [tuple(x) for x in out]
    size, known = np.bincount(group), np.bincount(group, place >= 0)
    hopeful = known >= least * least * size * 0.25
    keep = hopeful[group]
    renumber = np.cumsum(hopeful) - 1
    n = int(hopeful.sum())
    row_of = w.row[np.searchsorted(line, ids)]
    own_first = np.concatenate([[0], np.cumsum(w.data == 10)])
    for a in range(0, n, 4096):
        mine = keep & (renumber[group] >= a) & (renumber[group] < a + 4096)
        best, score = vectors.cosines(place[mine], w.hash[mine], renumber[group[mine]] - a, min(4096, n - a))
        for k in np.flatnonzero(score >= least):
            g = int(np.flatnonzero(hopeful)[a + k])
            at = out[int(row_of[g])]
            at[3] += int(size[g])
            if score[k] > at[2] + 1e-12:
                first = w.first[np.searchsorted(line, ids[g])]
                at[:3] = [int(own_first[first] - own_first[w.offsets[row_of[g]]]), vectors.names[int(best[k])], float(score[k])]
            covered[np.searchsorted(line, ids[g]) : np.searchsorted(line, ids[g], "right")] = True
    first_word = w.bounds()
    for start, many, template, cosine in runs(w, vectors, place, least):
        mine = slice(start, start + many)
        at = out[int(w.row[start])]
        # a run that is mostly counted already may still name the licence better
        if 2 * int(covered[mine].sum()) < many:
            at[3] += many - int(covered[mine].sum())
            covered[mine] = True
        if vectors.head[template] and start - first_word[w.row[start]] < 8:
            at[3] = int(w.count[w.row[start]])
        if cosine > at[2] + 1e-12:
            at[:3] = [int(own_first[w.first[start]] - own_first[w.offsets[w.row[start]]]), vectors.names[template], cosine]
    return [tuple(x) for x in out]


def document_counts(docs: DataFrame, templates: dict[str, list[str]]) -> tuple[int, np.ndarray]:
    """The number of documents, and of those with each word of the templates, over the whole corpus: one row a task."""
    size = len(Vectors(templates).vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vectors(templates)
        total, having = 0, np.zeros(size, np.int64)
        for batch in batches:
            for part in words.slices(batch, "text"):
                w = words.split(part.column("text"), lower=True)
                place = v.places(w.hash)
                known = place >= 0
                having += np.bincount(np.unique(w.row[known] * size + place[known]) % size, minlength=size)
                total += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(np.append(having, total))], names=["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(size + 1, np.int64)
    for r in counts.collect():
        out[r.word] = r.n
    return int(out[-1]), out[:-1]


def notices(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, path and FOUND for every document: its own notice, if it has one."""
    templates = templates or TEMPLATES
    total, having = document_counts(docs, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vectors(templates, total, having)
        for batch in batches:
            for part in words.slices(batch, "text"):
                w = words.split(part.column("text"), lower=True)
                line, name, score, many = zip(*find(w, v, least), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("path"), pa.array(line, pa.int64()), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(without_marks(w).count, pa.int64()), pa.array(many, pa.int64())], names=["doc_id", "path", *[x.split()[0] for x in FOUND.split(", ")]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "text").mapInArrow(run, f"doc_id long, path string, {FOUND}")


def parent(path: Column) -> Column:
    """The directory of a path; '' for the root."""
    return F.coalesce(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit(""))


def ancestors(directory: Column) -> Column:
    """(directory, depth) of a directory and all above it, the root with depth 0."""
    names = F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(names)), lambda i: F.struct(F.array_join(F.slice(names, F.lit(1), i), "/").alias("dir"), i.alias("depth")))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, path, license, origin ('notice', 'inherited' or null), from_dir, score and line for every document. docs: doc_id, path, text."""
    own = materialise(notices(docs, templates, least), "notices")
    files = own.where("license IS NOT NULL AND 5 * licence_words >= 4 * words").groupBy(parent(F.col("path")).alias("dir"), "license").agg(F.count(F.lit(1)).alias("n"))
    by_dir = materialise(files.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "license")).alias("best")).select("dir", F.col("best.license").alias("dir_license")), "directories")
    places = own.where("license IS NULL").select(parent(F.col("path")).alias("at")).distinct()
    above = places.select("at", F.explode(ancestors(F.col("at"))).alias("a")).select("at", "a.dir", "a.depth")
    nearest = above.join(by_dir, "dir").groupBy("at").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("up")).select("at", "up.dir", "up.dir_license")
    joined = own.withColumn("here", parent(F.col("path"))).join(nearest, F.col("license").isNull() & (F.col("here") == F.col("at")), "left")
    origin = F.when(F.col("license").isNotNull(), "notice").when(F.col("dir_license").isNotNull(), "inherited")
    return joined.select("doc_id", "path", F.coalesce("license", "dir_license").alias("license"), origin.alias("origin"), F.when(F.col("license").isNull(), F.col("dir")).alias("from_dir"), "score", "line")
