"""Licence scan: sparse TF-IDF cosine of blocks of lines to templates, then inheritance along directories.

Terms weigh by the lines of the corpus that hold them. Blocks that cannot reach a template
whatever their other terms weigh are left out exactly; the weights of the rest are joined.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaframe.llm.common import same_row, sized, text_key, write_table

_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(kind: str, version: str) -> list[str]:
    """The header of a file and the title of the licence file."""
    header = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
    rest = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} License for more details. You should have received a copy of the GNU {0} License along with this program. If not, see https://www.gnu.org/licenses/."
    title = "GNU {0} LICENSE Version {1}, Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    return [x.format(kind, version) for x in (header, header + " " + rest, title)]


# The notices by which public licences are declared.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is licensed under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _DISCLAIMER,
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", *_gnu("General Public", "2"), "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", *_gnu("General Public", "3"), "SPDX-License-Identifier: GPL-3.0"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", *_gnu("Lesser General Public", "3"), "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "This project is licensed under the MIT License.",
        "This project is released under the MIT License.",
        "This file is part of this project and is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["All rights reserved.", "Copyright (c) Inc. All rights reserved.", "Copyright, all rights reserved. Unauthorized copying of this file is strictly prohibited."],
}

#: Least cosine of a block of lines and a template.
COSINE = 0.75
#: A file is a licence file when its name says so or this share of its words stands in licence lines.
FILE_SHARE = 0.3
#: Lines with terms in a block. The longest template fills 32 lines of seven terms.
BLOCKS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
_TERM = re.compile(r"[a-z0-9]+")
_NAMED = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"


def terms(line: str) -> list[str]:
    return _TERM.findall(line.lower())


VOCABULARY = sorted({t for lines in TEMPLATES.values() for x in lines for t in terms(x)})


def document_frequencies(files: DataFrame) -> DataFrame:
    """t, n: in how many lines of the corpus each term stands; the empty term counts the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["t", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                for line in (text or "").split("\n"):
                    if words := terms(line):
                        held.update({"", *words})
                if len(held) > 200_000:
                    yield flush()
        yield flush()

    counts = files.select("text").mapInArrow(run, "t string, n bigint")
    return counts.groupBy("t").agg(F.sum("n").alias("n"))


class Matcher:
    """TF-IDF vectors of the templates."""

    def __init__(self, lines: int, counts: dict[str, int], least: float = COSINE) -> None:
        self.least = least
        self.rare = math.log(1 + lines) + 1
        self.idf = {t: math.log((1 + lines) / (1 + counts.get(t, 0))) + 1 for t in VOCABULARY}
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        self.names: list[str] = []
        self.terms: list[set[str]] = []
        for name, texts in sorted(TEMPLATES.items()):
            for text in texts:
                tf = Counter(terms(text))
                norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in tf.items()))
                for t, n in tf.items():
                    self.by_term.setdefault(t, []).append((len(self.names), n * self.idf[t] / norm))
                self.names.append(name)
                self.terms.append(set(tf))
        self.anchors = self._anchors()

    def _anchors(self) -> set[str]:
        """Terms of which every block that is near a template holds one: what is left of a template
        is too short a vector. The rarest are taken, so that few lines hold one."""
        own: dict[int, list[tuple[float, str]]] = {}
        for t, found in self.by_term.items():
            for i, w in found:
                own.setdefault(i, []).append((w, t))
        out = set()
        for rows in own.values():
            left = 1.0
            for w, t in sorted(rows, key=lambda x: (-self.idf[x[1]], x[1])):
                if left < self.least**2 - 1e-9:
                    break
                out.add(t)
                left -= w * w
        return out

    def blocks(self, text: str) -> Iterator[tuple[int, int, str, float, float, list[tuple[int, int]], int, list[tuple[str, int]]]]:
        """Blocks that may be near a template: first and last line, its licence, the dot product,
        the squared weights of terms inside the templates, the lines (number, words) that are mostly
        the template's, the words of the text, and the terms outside, which weigh 1 at least."""
        lines = [(k, w) for k, x in enumerate(text.split("\n")) if (w := terms(x))]
        marked = [k for k, (_, w) in enumerate(lines) if not self.anchors.isdisjoint(w)]
        if not marked:
            return
        total = sum(len(w) for _, w in lines)
        for size in BLOCKS:
            starts = sorted({s for k in marked for s in range(max(0, k - size + 1), min(k, len(lines) - size) + 1)})
            for s in starts:
                part = lines[s : s + size]
                tf = Counter(t for _, w in part for t in w)
                inside = sum((n * self.idf[t]) ** 2 for t, n in tf.items() if t in self.idf)
                outside = [(t, n) for t, n in tf.items() if t not in self.idf]
                most = self.least**2 * (inside + sum(n * n for _, n in outside)) - 1e-9
                if inside < most or not (near := self._nearest(tf)) or near[1] ** 2 < most:
                    continue
                i, dot = near
                held = [(k, len(w)) for k, w in part if 2 * sum(t in self.terms[i] for t in w) >= len(w)]
                yield part[0][0], part[-1][0], self.names[i], dot, inside, held, total, outside

    def _nearest(self, tf: Counter) -> tuple[int, float] | None:
        dots: dict[int, float] = {}
        for t, n in tf.items():
            for i, w in self.by_term.get(t, ()):
                dots[i] = dots.get(i, 0.0) + n * self.idf[t] * w
        return min(dots.items(), key=lambda x: (-round(x[1], 9), self.names[x[0]])) if dots else None

    def line(self, words: list[str]) -> tuple[str, float] | None:
        """The nearest template of a line and the cosine, if that is high enough; a term outside
        the templates weighs as one that no other line has."""
        tf = Counter(words)
        inside = sum((n * self.idf[t]) ** 2 for t, n in tf.items() if t in self.idf)
        total = inside + sum((n * self.rare) ** 2 for t, n in tf.items() if t not in self.idf)
        if not inside or inside < self.least**2 * total:  # no template can be nearer than the share inside
            return None
        i, dot = self._nearest(tf)
        cosine = dot / math.sqrt(total)
        return (self.names[i], cosine) if cosine >= self.least else None


def candidates(files: DataFrame, matcher: Matcher) -> DataFrame:
    """The blocks of each file (doc_id, path, _t, text) that may be near a template."""
    shared = files.sparkSession.sparkContext.broadcast(matcher)
    key = ["doc_id", "path", "_t"]
    fields = [
        ("s", pa.int32()), ("e", pa.int32()), ("own", pa.string()), ("dot", pa.float64()), ("inside", pa.float64()),
        ("held", pa.list_(pa.struct([("k", pa.int32()), ("n", pa.int32())]))), ("total", pa.int32()), ("out", pa.list_(pa.struct([("t", pa.string()), ("n", pa.int32())]))),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            row, found = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                for s, e, own, dot, inside, held, total, outside in m.blocks(text or ""):
                    row.append(at)
                    found.append((s, e, own, dot, inside, [{"k": k, "n": n} for k, n in held], total, [{"t": t, "n": n} for t, n in outside]))
            at = pa.array(row, pa.int64())
            columns = [pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in key), *columns], [*key, *(f for f, _ in fields)])

    kind = dict(files.dtypes)["doc_id"]
    return files.mapInArrow(run, f"doc_id {kind}, path string, _t bigint, s int, e int, own string, dot double, inside double, held array<struct<k: int, n: int>>, total int, out array<struct<t: string, n: int>>")


def declared(files: DataFrame, least: float = COSINE) -> DataFrame:
    """doc_id, path, _t, own, score, share of the files (doc_id, path, _t, text) that declare a
    licence: that of the best block (ties: by name), its cosine, the share of words in licence lines."""
    counts = write_table(document_frequencies(files), "license-terms")
    known = {r["t"]: r["n"] for r in counts.where(F.col("t").isin("", *VOCABULARY)).collect()}
    lines = known.pop("", 0)
    key = ["doc_id", "path", "_t"]
    blocks = write_table(candidates(files, Matcher(lines, known, least)).dropDuplicates([*key, "s", "e"]), "license-blocks")
    # an id, because a null doc_id must meet itself
    blocks = write_table(blocks.withColumn("_b", F.xxhash64(F.col("doc_id").cast("string"), "path", "_t", "s", "e")), "license-blocks")
    terms_out = blocks.select("_b", F.explode("out").alias("x")).select("_b", "x.t", F.col("x.n").alias("m"))
    weight = F.log(F.lit(1.0 + lines) / (1 + F.coalesce("n", F.lit(0)))) + 1
    rest = terms_out.hint("merge").join(counts, "t", "left").groupBy("_b").agg(F.sum(F.pow(F.col("m") * weight, F.lit(2.0))).alias("rest"))
    near = blocks.hint("merge").join(rest, "_b", "left").withColumn("cosine", F.col("dot") / F.sqrt(F.col("inside") + F.coalesce("rest", F.lit(0.0))))
    near = near.where(F.col("cosine") >= least)
    best = F.min(F.struct((-F.round("cosine", 9)).alias("c"), "own")).alias("b")
    out = near.groupBy(*key).agg(best, F.array_distinct(F.flatten(F.collect_set("held"))).alias("held"), F.max("total").alias("total"))
    share = F.expr("aggregate(held, 0L, (a, x) -> a + x.n)") / F.col("total")
    return out.select(*key, F.col("b.own").alias("own"), (-F.col("b.c")).alias("score"), share.alias("share"))


def scan(files: DataFrame, least: float = COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """One row per input row (doc_id, path, text): doc_id, path, license, how, score, from_dir.

    ``how`` is own, inherited or none. A file without a licence block inherits from the
    nearest directory above it that holds a licence file; where a directory's licence files
    disagree, the one that most of them name counts, then the first by name. A null path is
    the root; null and empty texts say nothing.
    """
    files = files.select("doc_id", F.coalesce(F.col("path"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    files = files.withColumn("_t", text_key(F.coalesce("text", F.lit(""))))
    said = write_table(declared(files, least), "license-said")
    found = files.drop("text").join(sized(said, 100), same_row(files, said) & (files["path"] == said["path"]), "left")
    found = write_table(found.select(files["doc_id"], files["path"], "own", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("share", F.lit(0.0)).alias("share")), "licenses")
    folder = lambda p: F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise("")
    holds = found.where(F.col("own").isNotNull() & (F.col("path").rlike(_NAMED) | (F.col("share") >= file_share)))
    votes = holds.groupBy(folder(F.col("path")).alias("dir"), "own").agg(F.count(F.lit(1)).alias("n"))
    dirs = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "own")).alias("b")).select("dir", F.col("b.own").alias("given"))
    dirs = write_table(dirs, "license-dirs")
    # each folder that has files, with all folders above it: one row a step, not a row for every file
    folders = found.where(F.col("own").isNull()).select(folder(F.col("path")).alias("dir")).distinct()
    above = folders.withColumn("_p", F.split("dir", "/")).select("dir", F.explode(F.expr("transform(sequence(0, size(_p)), i -> array_join(slice(_p, 1, i), '/'))")).alias("up"))
    near = above.distinct().hint("merge").join(dirs.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "up", "given")).alias("b"))
    near = write_table(near.select("dir", F.col("b.up").alias("from_dir"), "b.given"), "license-near")
    out = found.withColumn("dir", folder(F.col("path"))).join(sized(near, 200), "dir", "left")
    own = F.col("own").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("own", "given").alias("license"),
        F.when(own, "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.round("score", 6).alias("score"),
        F.when(~own, F.col("from_dir")).alias("from_dir"),
    )
