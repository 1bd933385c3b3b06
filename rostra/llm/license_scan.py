"""License scans by diagonal voting of rolling word k-grams against license templates."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import text_or_empty, written
from ._words import NOT_ALNUM, Words, as_bytes, slices, window_hashes

K, NEAR = 4, 3
#: A run of diagonals is a candidate with votes for MIN_SHARE of its template's k-grams, two at least; a span is a find if
#: MIN_FOUND of its own words and of the template's words stand in both in one order.
MIN_SHARE, MIN_FOUND = 0.2, 0.8

# Phrases and labels of the contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# License notices in their published wording.
TEMPLATES = {
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "gpl-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "cc-by-4.0": """This work is licensed under a Creative Commons Attribution 4.0 International License.""",
    "cc-by-sa-4.0": """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.""",
    "cc-by-nc-4.0": """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.""",
}


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, NOT_ALNUM)


def of_texts(texts: list[str]) -> Words:
    return split(*as_bytes(pa.array(texts, pa.large_string())))


def templates(spark: SparkSession, known: dict[str, str], k: int) -> DataFrame:
    """gram, template, place: every k-gram of every template. Its size is that of the templates."""
    rows = []
    for name, text in known.items():
        w = of_texts([text])
        rows += [(int(g), name, p) for p, g in enumerate(window_hashes(w.hashes()[w.codes], k).view(np.int64))]
    return spark.createDataFrame(rows, "gram long, template string, place int")


def gram_batches(k: int):
    def run(batches):
        for batch in batches:
            data, offsets = as_bytes(batch.column(2))
            for first, part, cuts in slices(data, offsets):
                w = split(part, cuts)
                n = len(cuts) - 1
                count = np.maximum(np.diff(w.bounds) - k + 1, 0)
                grams = window_hashes(w.hashes()[w.codes], k).view(np.int64)
                keep = np.repeat(w.bounds[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(grams[keep] if len(keep) else grams[:0]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), lists], names=["doc_id", "mark", "grams"])

    return run


def spans(rows: DataFrame, known: dict[str, str] = TEMPLATES, k: int = K, near: int = NEAR, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, mark and a list of candidate spans (template, first and last word in the text).

    All k-gram hashes of all texts meet the templates' in a broadcast join (the templates' size bounds it); votes are summed by
    document, template and diagonal before anything is shuffled, and diagonals at most `near` apart become one run.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    places = templates(rows.sparkSession, known, k)
    grams = rows.mapInArrow(gram_batches(k), f"doc_id {kind}, mark long, grams array<bigint>")
    hits = grams.select("doc_id", "mark", F.posexplode("grams").alias("at", "gram")).join(F.broadcast(places), "gram")
    votes = hits.groupBy("doc_id", "mark", "template", (F.col("at") - F.col("place")).alias("shift")).agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("first"), (F.max("at") + k - 1).alias("last"))
    order = Window.partitionBy("doc_id", "mark", "template").orderBy("shift")
    new = F.coalesce((F.col("shift") - F.lag("shift").over(order) > near).cast("int"), F.lit(1))
    numbered = votes.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    merged = numbered.groupBy("doc_id", "mark", "template", "run").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    least = places.groupBy("template").agg(F.greatest(F.lit(2), F.ceil(F.count(F.lit(1)) * min_share)).alias("least"))
    found = merged.join(F.broadcast(least), "template").filter("votes >= least").select("doc_id", "mark", F.struct("template", "first", "last").alias("span"))
    return found.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def in_common(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """The longest common subsequence of two lists: its length, and its first and last place in a."""
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # for each length the lowest end in b, and where in a such a sequence begins and ends
    where: list[tuple[int, int]] = []
    for i, x in enumerate(a):
        for j in places.get(x, ()):
            n = bisect_left(ends, j)
            at = (where[n - 1][0] if n else i, i)
            if n == len(ends):
                ends.append(j)
                where.append(at)
            elif j < ends[n]:
                ends[n], where[n] = j, at
    return len(ends), *(where[-1] if ends else (0, -1))


def finds(words: np.ndarray, candidates: list[dict], pieces: dict[str, list[int]], min_found: float) -> dict[str, float]:
    """Templates that a text holds and the lesser of the two shares, span and template, that is in common. Of overlapping
    spans the one that explains most words stays, on ties the one that its template covers more closely."""
    tried = []
    for s in candidates:
        t = pieces[s["template"]]
        part = words[s["first"] : s["last"] + 1].tolist()
        if min_found * len(t) > len(part):
            continue
        same, first, last = in_common(part, t)
        share = min(same / len(t), same / max(1, last + 1 - first))
        if share >= min_found:
            tried.append((same, share, s["template"], s["first"] + first, s["first"] + last))
    out: dict[str, float] = {}
    taken: list[tuple[int, int]] = []
    for same, share, name, first, last in sorted(tried, key=lambda x: (-x[0], -x[1], x[2], x[3])):
        if all(last < a or b < first for a, b in taken):
            taken.append((first, last))
            out[name] = max(out.get(name, 0.0), share)
    return out


def base_batches(phrases: dict[str, str]):
    """Texts to doc_id, mark and the contract's phrases: n_words, n_base, first_word, last_word, base_labels."""

    def run(batches):
        wanted = [(p.encode().split(), label) for p, label in phrases.items()]
        for batch in batches:
            data, offsets = as_bytes(batch.column(2))
            out = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")}
            for _, part, cuts in slices(data, offsets):
                w = split(part, cuts)
                number = {x: i for i, x in enumerate(w.vocabulary)}
                base: dict[int, list] = {}
                for words, label in wanted:
                    ids = [number.get(x, -1) for x in words]
                    hit = np.ones(max(0, len(w.codes) - len(ids) + 1), bool)
                    for o, x in enumerate(ids):
                        hit &= w.codes[o : o + len(hit)] == x
                    at = np.flatnonzero(hit)
                    doc = np.searchsorted(w.bounds, at, "right") - 1
                    inside = at + len(ids) <= w.bounds[doc + 1]
                    for x, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
                        base.setdefault(d, []).append((x - int(w.bounds[d]), label))
                out["n_words"] += np.diff(w.bounds).tolist()
                for d in range(len(cuts) - 1):
                    b = base.get(d, [])
                    out["n_base"].append(len(b))
                    out["first_word"].append(min((x for x, _ in b), default=None))
                    out["last_word"].append(max((x for x, _ in b), default=None))
                    out["base_labels"].append(",".join(sorted({x for _, x in b})))
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]], names=["doc_id", "mark", *out])

    return run


def find_batches(known: dict[str, str], min_found: float):
    """Texts with candidate spans to doc_id, mark and what is found: a list of (template, share)."""

    def run(batches):
        templates_words = {name: [w.vocabulary[c] for c in w.codes] for name, w in ((n, of_texts([t])) for n, t in known.items())}
        for batch in batches:
            data, offsets = as_bytes(batch.column(2))
            candidates, out = batch.column(3).to_pylist(), []
            for begin, part, cuts in slices(data, offsets):
                w = split(part, cuts)
                number = {x: i for i, x in enumerate(w.vocabulary)}
                pieces = {name: [number.get(x, -1) for x in words] for name, words in templates_words.items()}
                for d in range(len(cuts) - 1):
                    found = finds(w.codes[w.bounds[d] : w.bounds[d + 1]], candidates[begin + d], pieces, min_found)
                    out.append([{"template": t, "share": s} for t, s in found.items()])
            kind = pa.list_(pa.struct([("template", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["doc_id", "mark", "found"])

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = K) -> DataFrame:
    """License phrases and template spans of every whole text.

    Returns one row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. score is 1 with
    a base phrase, else the best found template's share of words in common, else 0. A template is found where most of it
    stands in most of a span; of templates that claim the same words the one that explains most of them stays. Words are runs of ASCII letters and digits
    and of non-ASCII characters, A-Z lower-cased. Null and empty texts have no words. Rows stay apart even if repeated, and
    equal rows get equal results; other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("mark"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    of_row = lambda d, m: F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("mark") == F.col(m))
    candidates = written(spans(rows, known, k), "spans").withColumnsRenamed({"doc_id": "d", "mark": "m"})
    # texts meet candidate spans only; what is found in the few of them then meets the counts of all rows, without texts
    distinct = rows.join(candidates, of_row("d", "m")).select("doc_id", "mark", "text", "spans").dropDuplicates(["doc_id", "mark"])
    found = distinct.mapInArrow(find_batches(known, MIN_FOUND), f"doc_id {kind}, mark long, found array<struct<template:string,share:double>>")
    found = written(found.filter("size(found) > 0"), "finds").withColumnsRenamed({"doc_id": "d", "mark": "m"})
    base = rows.mapInArrow(base_batches(phrases), f"doc_id {kind}, mark long, n_words long, n_base long, first_word long, last_word long, base_labels string")
    both = base.join(found, of_row("d", "m"), "left")
    own = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_union(own, F.coalesce(F.col("found.template"), F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("found.share"), F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
