"""License scans: TF-IDF similarity of notices to templates, then inheritance by directory.

Templates and texts become sparse TF-IDF vectors over the templates' words; inverse document frequencies come from
all documents. A window as long as a template slides over a whole text, line breaks or not, and its cosine with the
template is taken; the best window of any template names the license, if it is near enough and clearly nearer than
any window is to another license. A file without a notice of its own takes that of the nearest directory above it
that has a licence file; directories are resolved first, once each, by joining their ancestors' paths, so a
directory with very many files costs one look-up.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, table, texts
from .components import attach

# The notices and texts by which licenses are known. Of the long licenses the titles and the notices
# that they ask for stand here; those of the short ones are whole.
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = "This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{sep2} either version {version} of the License, or (at your option) any later version."
_GNU_END = "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_NO_LATER = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {version} as published by the Free Software Foundation."


def _gnu(name: str, short: str, version: str, title: str, what: str = "program") -> tuple[str, ...]:
    seps = {"sep": ":", "sep2": ","}
    head = _GNU.format(what=what, name=name, version=version, **seps)
    return (head, f"{head} {_GNU_END.format(what=what, name=name)}", _NO_LATER.format(what=what, name=name, version=version), title, f"licensed under the GNU {name}, version {version}.", f"licensed under the {short} version {version}", f"licensed under the {short}v{version}", f"released under the {short} {version}")


TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Released under the Apache 2.0 License.",
    ),
    "GPL-3.0": _gnu("General Public License", "GPL", "3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "GPL-2.0": _gnu("General Public License", "GPL", "2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "LGPL-3.0": _gnu("Lesser General Public License", "LGPL", "3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "library"),
    "LGPL-2.1": _gnu("Lesser General Public License", "LGPL", "2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "library"),
    "AGPL-3.0": _gnu("Affero General Public License", "AGPL", "3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "BSD-3-Clause": (f"{_BSD} {_BSD_3} {_BSD_END}", "Licensed under the BSD 3-Clause License.", "Released under the 3-Clause BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", f"provided with the distribution. {_BSD_3}"),
    "BSD-2-Clause": (f"{_BSD} {_BSD_END}", "Licensed under the BSD 2-Clause License.", "Released under the 2-Clause BSD License.", f"provided with the distribution. {_BSD_END[:180]}"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "Released under the ISC License.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "Licensed under the Mozilla Public License, version 2.0."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Eclipse Public License - v 2.0", "Licensed under the Eclipse Public License, version 2.0."),
    "EPL-1.0": ("All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", "Eclipse Public License - v 1.0"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "Boost Software License - Version 1.0 - August 17th, 2003"),
    "Zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "WTFPL": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004",),
    "CC0-1.0": ("CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under CC0 1.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Creative Commons Attribution-NoDerivatives 4.0 International Public License"),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
}
GNU = ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0")
# What a text must hold to be worth comparing, and the names of licence files.
TRIGGER = re.compile(rb"licen[cs]|copyright|spdx|redistribut|public domain|permission|creative commons|cc0|free software|unencumbered|as is|as-is")
LICENCE_FILES = r"(?i)^(un)?licen[cs]e|^copying|^notice"

LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
CHUNK = 1 << 13  # words compared at a time; chunks overlap by the longest template


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(LETTERS).split()


def notices() -> list[tuple[str, list[bytes]]]:
    """(license, words) of every template, tags that name a license by its identifier included."""
    out = [(name, words(n.encode())) for name, found in TEMPLATES.items() for n in found]
    for name in TEMPLATES:
        out += [(name, words(f"SPDX-License-Identifier: {name}{end}".encode())) for end in ("", *(("-only", "-or-later", "+") if name in GNU else ()))]
    return [(name, list(w)) for name, w in dict.fromkeys((name, tuple(w)) for name, w in out)]


VOCABULARY = frozenset(w for _, n in notices() for w in n)


def window_norms(ids: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """The Euclidean norm of count times weight over the distinct words of every window of `size` places.

    A place that a window gains adds (2c + 1) times its squared weight, where c is how often its word stands among the
    places before it in the window, and takes as much away, by those after it, when it is lost."""
    n = len(ids)
    order = np.lexsort((np.arange(n), ids))
    keys = ids[order].astype(np.int64) * (n + 1) + order  # ascending by word and place
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    at = np.arange(n)
    before = rank - np.searchsorted(keys, ids.astype(np.int64) * (n + 1) + np.maximum(at - size + 1, 0))
    after = np.searchsorted(keys, ids.astype(np.int64) * (n + 1) + np.minimum(at + size, n)) - rank - 1
    squares = weights**2
    gained = np.concatenate(([0.0], np.cumsum((2 * before + 1) * squares)))
    lost = np.concatenate(([0.0], np.cumsum((2 * after + 1) * squares)))
    return np.sqrt(np.maximum(gained[size:] - lost[: n - size + 1], 1e-12))


class Scorer:
    """Templates as unit TF-IDF vectors, and the windows of a text that are nearest to them.

    A word's weight in a window is its count there times its inverse document frequency."""

    def __init__(self, frequencies: dict[str, int], documents: int):
        self.idf = {w: math.log((documents + 1) / (frequencies.get(w.decode(), 0) + 1)) + 1 for w in VOCABULARY}
        # a word of no template counts as much as a middling one of theirs
        self.other = sorted(self.idf.values())[len(self.idf) // 2]
        self.number = {w: i for i, w in enumerate(sorted(VOCABULARY))}
        self.templates = [(name, len(n), self.vector(n)) for name, n in notices()]
        self.longest = max(size for _, size, _ in self.templates)
        self.idfs = np.array([*(self.idf[w] for w in sorted(VOCABULARY)), self.other])
        # what a word at a place adds to the product with each template
        self.adds = np.zeros((len(self.idfs), len(self.templates)))
        for t, (_, _, vector) in enumerate(self.templates):
            for w, v in vector.items():
                self.adds[self.number[w], t] = v * self.idf[w]

    def vector(self, tokens: list[bytes]) -> dict[bytes, float]:
        weights = {w: n * self.idf.get(w, self.other) for w, n in Counter(tokens).items()}
        norm = math.sqrt(sum(v * v for v in weights.values())) or 1.0
        return {w: v / norm for w, v in weights.items()}

    def _windows(self, text: bytes) -> Iterator[list[bytes]]:
        """The words of a text in chunks that overlap by all but one word of the longest template."""
        held: list[bytes] = []
        for piece in pieces(text):
            held += words(piece)
            while len(held) >= CHUNK + self.longest:
                yield held[: CHUNK + self.longest - 1]
                held = held[CHUNK:]
        if held:
            yield held

    def all(self, text: bytes | None, least: float) -> dict[str, float]:
        """The best cosine of each license with a window of the text, of those that reach `least`."""
        out: dict[str, float] = {}
        if not text or not TRIGGER.search(text.lower()):
            return out
        for tokens in self._windows(text):
            own: dict[bytes, int] = {}
            # words of no template get numbers too, so that each counts by itself
            ids = np.array([self.number[w] if w in self.number else own.setdefault(w, len(self.idfs) + len(own)) for w in tokens])
            known = np.minimum(ids, len(self.idfs) - 1)
            idfs = self.idfs[known]
            products = np.concatenate((np.zeros((1, len(self.templates))), np.cumsum(self.adds[known], axis=0)))
            squares = np.concatenate(([0.0], np.cumsum(idfs**2)))
            norms: dict[int, np.ndarray] = {}
            for t, (name, size, _) in enumerate(self.templates):
                size = min(size, len(ids))
                product = products[size:, t] - products[:-size, t]
                # a word that repeats only makes the norm larger
                if (product < max(least, out.get(name, 0.0)) * np.sqrt(squares[size:] - squares[:-size]) - 1e-9).all():
                    continue
                if size not in norms:
                    norms[size] = window_norms(ids, idfs, size)
                score = float((product / norms[size]).max())
                if score >= least and score > out.get(name, 0.0):
                    out[name] = score
        return out

    def best(self, text: bytes | None, least: float, margin: float = 0.01) -> tuple[str | None, float]:
        """The likeliest license of a text and its cosine; (None, 0) if none reaches `least`, or if the second comes
        within `margin` of the first."""
        found = sorted(((score, name) for name, score in self.all(text, least).items()), reverse=True)
        if not found or (len(found) > 1 and found[0][0] - found[1][0] < margin):
            return None, 0.0
        return found[0][1], min(found[0][0], 1.0)


def frequencies(docs: DataFrame, text_col: str) -> tuple[dict[str, int], int]:
    """In how many of all documents each word of the templates stands, and how many documents there are. Only
    the templates' vocabulary comes to the driver."""

    def run(batches):
        import pyarrow as pa

        count: Counter = Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                count[b""] += 1
                own: set[bytes] = set()
                for piece in pieces(text or b""):
                    own |= VOCABULARY.intersection(words(piece))
                count.update(own)
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in count], pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    return found, found.pop("", 0)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", least: float = 0.85) -> DataFrame:
    """One row per row of `docs`: id, path, license (null if none), similarity.

    Null, empty and blank texts have none. Repeated rows are judged each. Other columns are not read."""
    held = docs.sparkSession.sparkContext.broadcast(Scorer(*frequencies(docs, text_col)))  # the templates, a fixed size

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [held.value.best(t, least) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["id", "path", "license", "similarity"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, path string, license string, similarity double")


def inherit(found: DataFrame) -> DataFrame:
    """Adds origin (`header`, `file`, `inherited` or `none`) and origin_dir to detect()'s rows, and fills in the
    license of rows without one from the nearest directory above, itself included, with a licence file in which
    one was found; of several such files in a directory that with the largest similarity, then the smallest
    license. Paths are parted by "/"; a null path has no directory and inherits nothing. `found` is read several
    times, so it should be a table. Adaptive execution splits a directory of very many files in the last join."""
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    name = F.regexp_replace("path", "^.*/", "")
    rows = found.withColumns({"dir": folder, "is_file": F.coalesce(name.rlike(LICENCE_FILES), F.lit(False))})
    held = rows.filter("is_file and license is not null and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "license")).alias("best"))
    held = cut(held.select(F.col("dir").alias("above"), F.col("best.license").alias("given")), "held")
    root = held.filter("above = ''").first()  # above every directory: one look-up, not a join
    dirs = rows.filter("license is null and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    # every directory on the way up but the root
    ways = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), lambda a: a != "")
    near = attach(dirs.select("dir", F.explode(F.array_distinct(ways)).alias("above")), "above", held.filter("above <> ''"))
    near = cut(near.groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "given")).alias("near")), "nearest")
    own = F.col("license").isNotNull()
    told = rows.join(near.withColumnRenamed("dir", "_dir"), F.when(~own, F.col("dir")) == F.col("_dir"), "left")
    top = F.when(F.col("dir").isNotNull(), F.lit(None if root is None else root["given"]).cast("string"))
    given = F.coalesce("near.given", top)
    origin = F.when(own & F.col("is_file"), F.lit("file")).when(own, F.lit("header")).when(given.isNotNull(), F.lit("inherited")).otherwise(F.lit("none"))
    from_dir = F.when(own, F.col("dir")).when(F.col("near").isNotNull(), F.col("near.above")).when(top.isNotNull(), F.lit(""))
    return told.select("id", "path", F.coalesce("license", given).alias("license"), "similarity", origin.alias("origin"), from_dir.alias("origin_dir"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", least: float = 0.85) -> DataFrame:
    """One row per row of `docs`: id, path, license, similarity, origin, origin_dir (see inherit()). Null and
    empty texts have no notice; other columns are not read; an empty table gives no rows."""
    return inherit(cut(detect(docs, id_col, text_col, path_col, least), "detected"))


def placed(documents: DataFrame) -> DataFrame:
    """Paths for a table that has none: <source>/<doc_id mod 13>/<doc_id mod 3>/ and, for every tenth
    document, LICENSE in the directory above; else doc<doc_id>.txt."""
    part = lambda n: F.pmod("doc_id", F.lit(n)).cast("string")
    licence = F.pmod("doc_id", F.lit(10)) == 0
    path = F.when(licence, F.concat_ws("/", "source", part(13), F.concat(F.lit("LICENSE"), F.col("doc_id").cast("string"))))
    return documents.withColumn("path", path.otherwise(F.concat_ws("/", "source", part(13), part(3), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")))))


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(placed(table(spark, sf_dir, "documents"))).select(F.col("id").alias("doc_id"), "path", "license", "similarity", "origin", "origin_dir")
