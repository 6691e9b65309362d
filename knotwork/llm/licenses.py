"""Licence scan: TF-IDF cosine to licence notices, headers and whole texts, then inheritance along directories.

Every line of a file, and every sentence of a line, is a possible notice; runs of consecutive lines are possible
headers, and the whole file is a possible header or licence text. Document frequencies of all terms are counted over
all lines. Those of the templates and of the most frequent terms go to every worker, others are joined to the files
that need them. Lines that can reach the least cosine hold one of a notice's heavy terms (without them the rest of the
notice's weight is too small), and files that can reach it hold enough of a template's weight, so others are passed over.
A file without a notice takes the licence of the nearest directory above it that holds a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from knotwork.llm.common import map_texts, stored

# Usual notices of common licences.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004"],
    "MIT": ["This project is licensed under the MIT License - see the LICENSE file for details", "Released under the MIT License", "The MIT License (MIT)", "Licensed under the MIT license"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007"],
    "GPL-2.0": ["This program is licensed under the GNU General Public License, version 2", "GNU General Public License Version 2, June 1991"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License", "Licensed under the 3-clause BSD license"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License", "Licensed under the 2-clause BSD license"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"],
    "ISC": ["Released under the ISC License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. """
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as
published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU {0} General Public License for more details. You should have received a copy of the GNU {0} General
Public License along with this program. If not, see https://www.gnu.org/licenses/."""
# Standard headers, and the licences that are no longer than one.
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": _GNU.format("", 3), "GPL-2.0": _GNU.format("", 2), "LGPL-3.0": _GNU.format("Lesser", 3), "AGPL-3.0": _GNU.format("Affero", 3),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD + _DISCLAIMER,
    "BSD-3-Clause": _BSD + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. """ + _DISCLAIMER,
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
}
LEAST = 0.75
#: Terms in one of so many lines or more go to every worker; of others no file set holds many.
HEAD = 1000
FILE_NAME = r"(?i)^(licen[sc]e|copying|notice)([-._].*)?$"
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_SENTENCE = re.compile(r"[.;:!?]\s+")


def terms(line: str) -> list[str]:
    return _TERM.findall(line.lower())


def _vocabulary() -> set[str]:
    return {t for lines in NOTICES.values() for line in lines for t in terms(line)}


def templates() -> list[tuple[str, bool, dict[str, int]]]:
    """(licence, whether it is a header, term counts) of the headers and of the whole texts beside this file."""
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    texts = [*((n, True, t) for n, t in HEADERS.items()), *((f.stem, False, f.read_text()) for f in files)]
    return [(name, header, dict(Counter(terms(text)))) for name, header, text in texts]


def term_counts(files: DataFrame) -> DataFrame:
    """(term, n): how many lines hold each term; the number of lines with a term stands with the empty one."""

    def compute(texts: list) -> dict:
        total, lines = Counter(), 0
        for text in texts:
            for line in (text or "").lower().split("\n"):
                found = set(_TERM.findall(line))
                lines += bool(found)
                total.update(found)
        rest = [[]] * (len(texts) - 1)
        return {"counts": [[{"term": t, "n": n} for t, n in total.items()] + [{"term": "", "n": lines}], *rest] if texts else []}

    counted = map_texts(files, [], compute, "counts array<struct<term: string, n: bigint>>").select(F.inline("counts"))
    return stored(counted.groupBy("term").agg(F.sum("n").alias("n")))


class Matcher:
    """Best notice, header or licence text of a text by TF-IDF cosine over its sentences, lines, runs of lines and itself."""

    def __init__(self, lines: int, counts: dict[str, int], least: float = LEAST, whole: list | None = None):
        self.least, self.lines = least, lines
        whole = templates() if whole is None else whole
        self.idf = {t: self.weight(counts.get(t, 0)) for t in {*_vocabulary(), *counts, *(t for *_, c in whole for t in c)}}
        self.rare = math.log((lines + 1) / 2) + 1
        self.whole = []
        self.place = {t: i for i, t in enumerate(sorted({t for *_, c in whole for t in c}))}
        self.mass = np.zeros((len(self.place), len(whole)))
        for k, (name, header, count) in enumerate(whole):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in count.items()))
            unit = {t: n * self.idf[t] / norm for t, n in count.items()}
            self.whole.append((name, unit, sum(count.values()) if header else 0))
            for t, w in unit.items():
                self.mass[self.place[t], k] = w * w
        self.notices, heavy = [], set()
        for name, texts in NOTICES.items():
            for text in texts:
                weight = {t: n * self.idf[t] for t, n in Counter(terms(text)).items()}
                norm = math.sqrt(sum(w * w for w in weight.values()))
                unit = {t: w / norm for t, w in weight.items()}
                self.notices.append((name, unit))
                left = 1.0
                for t, w in sorted(unit.items(), key=lambda x: (-x[1], x[0])):
                    if left < least * least:
                        break
                    heavy.add(t)
                    left -= w * w
        self.heavy = re.compile(r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, sorted(heavy, key=len, reverse=True))) + ")")

    def weight(self, count: int) -> float:
        return math.log((self.lines + 1) / (count + 1)) + 1

    def near(self, low: str) -> list[int]:
        """The templates of which a text in small letters holds weight enough, whatever else it holds."""
        held = [self.place[t] for t in self.place.keys() & set(_TERM.findall(low))]
        return np.flatnonzero(self.mass[held].sum(axis=0) >= self.least**2 - 1e-9).tolist()

    def unknown(self, text: str | None) -> list[str] | None:
        """Terms whose counts ``best`` needs beyond those given here; None if nothing can be found."""
        low = (text or "").lower()
        if self.near(low):
            return list(set(_TERM.findall(low)) - self.idf.keys())
        lines = [line for line in low.split("\n") if self.heavy.search(line)] if self.heavy.search(low) else []
        return list({t for line in lines for t in _TERM.findall(line)} - self.idf.keys()) if lines else None

    def best(self, text: str | None, counts: dict[str, int] | None = None) -> tuple[str | None, float | None]:
        """(licence, score); ``counts`` has the lines of terms that the matcher was not given, others count as one."""
        found: list[tuple[float, str]] = []
        low, others = (text or "").lower(), {t: self.weight(n) for t, n in (counts or {}).items()}
        idf = lambda t: self.idf.get(t) or others.get(t, self.rare)

        def add(name: str, dot: float, norm: float) -> None:
            score = round(dot / math.sqrt(norm), 9) if norm > 0 else 0.0
            if score >= self.least:
                found.append((-score, name))

        lines = low.split("\n")
        for line in lines if self.heavy.search(low) else []:
            if not self.heavy.search(line):
                continue
            for unit_text in {line, *_SENTENCE.split(line)}:
                weight = {t: n * idf(t) for t, n in Counter(_TERM.findall(unit_text)).items()}
                norm = sum(w * w for w in weight.values())
                for name, unit in self.notices:
                    add(name, sum(w * weight[t] for t, w in unit.items() if t in weight), norm)
        near = self.near(low)
        held = [Counter(_TERM.findall(line)) for line in lines] if near else []
        held = [h for h in held if h]
        for k in near:
            name, unit, size = self.whole[k]
            for start in range(len(held) if size else 1):
                seen, dot, norm, total = Counter(), 0.0, 0.0, 0
                for end in range(start, len(held)):
                    for t, n in held[end].items():
                        w = idf(t)
                        norm += ((seen[t] + n) ** 2 - seen[t] ** 2) * w * w
                        dot += n * w * unit.get(t, 0.0)
                        seen[t] += n
                        total += n
                    if size:
                        add(name, dot, norm)
                        # A run of more than twice the header's terms is no header; the whole file is compared below.
                        if total > 2 * size and not (start == 0 and end + 1 < len(held)):
                            break
                if start == 0:
                    add(name, dot, norm)
        if not found:
            return None, None
        score, name = min(found)
        return name, -score


def ancestors(path: str = "dir"):
    """The directory and all above it, the root ('') included."""
    parts = F.split(F.col(path), "/")
    return F.transform(F.sequence(F.lit(0), F.when(F.col(path) == "", 0).otherwise(F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, carry: list[str], least: float = LEAST) -> DataFrame:
    """The ``carry`` columns, path, licence, score, origin (own, inherited or none) and licence_dir of every file.

    ``files`` has path and text; null texts are empty, a null path has no directory and inherits nothing. Of several
    licence files in a directory the one of highest score counts, then the least licence name. A file's own notice
    comes before what it could inherit.
    """
    counted, whole = term_counts(files), templates()
    lines = (counted.filter("term = ''").first() or {"n": 0})["n"]
    vocabulary = sorted({*_vocabulary(), *(t for *_, c in whole for t in c)})
    known = counted.filter((F.col("n") * HEAD >= lines) | F.col("term").isin(vocabulary)).filter("term <> ''")
    counts = {r["term"]: r["n"] for r in known.collect()}
    made = {}

    def matcher() -> Matcher:
        return made.get("m") or made.setdefault("m", Matcher(lines, counts, least, whole))

    def ask(texts: list) -> dict:
        return {"_need": [matcher().unknown(t) for t in texts]}

    def judge(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts, given = part.column("_whole").to_pylist(), part.column("_given").to_pylist()
                found = [matcher().best(t, {g["term"]: g["n"] for g in gs or []}) for t, gs in zip(texts, given)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-2], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=[*part.schema.names[:-2], "own", "score"],
                )

    where = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), "")
    kept = files.select(*[F.col(f"`{c}`") for c in carry], "path", "text").withColumn("_whole", F.col("text"))
    asked = map_texts(kept, [*carry, "path", "_whole"], ask, "_need array<string>")
    asked = stored(asked.select(*carry, "path", F.when(F.col("_need").isNotNull(), F.col("_whole")).alias("_whole"), "_need").withColumn("_file", F.monotonically_increasing_id()))
    needs = asked.select("_file", F.explode("_need").alias("term")).join(counted, "term")
    given = needs.groupBy("_file").agg(F.collect_list(F.struct("term", "n")).alias("_given"))
    possible = asked.filter("_need IS NOT NULL").join(given, "_file", "left").select(*carry, "path", "_whole", "_given")
    out = StructType([*possible.schema[: len(carry) + 1], StructField("own", StringType()), StructField("score", DoubleType())])
    none = asked.filter("_need IS NULL").select(*carry, "path", F.lit(None).cast("string").alias("own"), F.lit(None).cast("double").alias("score"))
    rows = stored(possible.mapInArrow(judge, out).unionByName(none).withColumn("dir", where))
    name = F.element_at(F.split("path", "/"), -1)
    holders = rows.filter(F.col("own").isNotNull() & F.col("dir").isNotNull() & name.rlike(FILE_NAME))
    by_dir = holders.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "own")).alias("best")).select(F.col("dir").alias("up"), F.col("best.own").alias("given"))
    dirs = rows.filter("own IS NULL AND dir IS NOT NULL").select("dir").distinct().select("dir", F.explode(ancestors()).alias("up"))
    nearest = dirs.join(by_dir, "up").groupBy("dir").agg(F.max_by(F.struct("up", "given"), F.length("up")).alias("near"))
    joined = rows.join(nearest, "dir", "left")
    inherits = F.col("own").isNull() & F.col("near").isNotNull()
    return joined.select(
        *carry, "path", F.when(inherits, F.col("near.given")).otherwise(F.col("own")).alias("licence"), "score",
        F.when(F.col("own").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(inherits, F.col("near.up")).alias("licence_dir"),
    )
