"""License scans: MinHash bands over overlapping text windows retrieve license templates,
exact shingle containment verifies them. DataFrame expressions only.

Texts and templates become lower-case words of letters and digits, and hashed runs of
SHINGLE words. For each template length n (in runs) a text is covered by windows of n runs
starting every n/4 runs. BANDS bands of one MinHash value each are compared with those of
the templates: a window that is off by n/8 at most from a passage holding 4/5 of a
template has similarity over 0.5 with it, and shares a band with a chance over
1 - 0.5**BANDS. For each retrieved window the runs from one window before it to one
behind it are taken, and the part of the template's distinct runs among them is the
containment; CONTAINMENT or more is a match.

Only windows that begin near an anchor word are made: anchors of a length are words of its
templates such that over 1 - CONTAINMENT of each template's runs hold one, so every match holds
an anchor, and the windows from 2n + 4 words before it to n behind it include those that lie
on the match.

Nulls: null and empty texts match nothing. Templates of fewer words than SHINGLE are
refused. A text that names a template twice has one row for it, the best, of equal ones the first. Rows that repeat
an id are taken as one document. An empty table gives no rows. Only the id and the text
are read. Very long texts are cut like others: a text's places are exploded first, and each
window is cut out of its runs after, so there is one window in memory at a time.
"""

from __future__ import annotations

import random
import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, BANDS, CONTAINMENT = 5, 16, 0.8

_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
#: Texts of public licenses, and their usual notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MIT", "Released under the MIT License."),
    ("MIT-full", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("BSD-2-Clause-full", _CLAUSES + _AS_IS),
    ("BSD-3-Clause-full", _CLAUSES + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS),
    ("ISC-full", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib-full", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def runs_of(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def anchors(templates: tuple[tuple[str, str], ...]) -> list[str]:
    """Words, the longest first, such that no match can do without all of them."""
    chosen: list[str] = []
    for _, text in templates:
        runs = [r.split() for r in dict.fromkeys(runs_of(words_of(text)))]
        for word in sorted(set(words_of(text)), key=lambda w: (w not in chosen, -len(w), w)):
            held = sum(any(a in r for a in chosen) for r in runs)
            if len(runs) - held < ceil(CONTAINMENT * len(runs) - 1e-9):
                break
            if word not in chosen:
                chosen.append(word)
    return sorted(chosen)


def shingle_hashes(words: Column) -> Column:
    """Hashes of the runs of SHINGLE words of an array of words, in order."""
    n = F.size(words) - SHINGLE + 1
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def band_keys(window: Column) -> Column:
    """One key for each band: the run that lies nearest to the band's constant, by XOR."""
    rng = random.Random(5)
    constants = [rng.getrandbits(63) for _ in range(BANDS)]

    def least(b: int) -> Column:
        return F.xxhash64(F.lit(b), F.array_min(F.transform(window, lambda s: s.bitwiseXOR(F.lit(constants[b])))))

    return F.array(*[least(b) for b in range(BANDS)])


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """license, n, runs (distinct hashes) and keys (of its bands): a row for each template."""
    short = [k for k, t in templates if len(words_of(t)) < SHINGLE]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    rows = spark.createDataFrame([(k, words_of(t)) for k, t in templates], "license string, words array<string>")
    hashed = rows.select("license", F.array_distinct(shingle_hashes(F.col("words"))).alias("runs"), F.size(shingle_hashes(F.col("words"))).alias("n"))
    return hashed.withColumn("keys", band_keys(F.col("runs")))


def starts_of(near: Column, n_runs: Column, n: int) -> Column:
    """Where windows of n runs begin about the word places near: array of (n, start), without repeats."""
    step = max(1, n // 4)

    def about(p: Column) -> Column:
        # whole steps from the text's first run on, so that starts of different anchors agree
        low = F.greatest(F.lit(0), p - (2 * n + 4))
        high = F.least(F.greatest(low + 1, p + n), n_runs)
        first = low - low % step + 1
        return F.when(first <= high, F.sequence(first.cast("int"), high.cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))

    return F.transform(F.array_distinct(F.flatten(F.transform(near, about))), lambda i: F.struct(F.lit(n).alias("n"), i.alias("start")))


def license_matches(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, license, containment and start_word: a row for each template in a document."""
    spark = docs.sparkSession
    by_length: dict[int, list[tuple[str, str]]] = {}
    for t in templates:
        by_length.setdefault(len(words_of(t[1])) - SHINGLE + 1, []).append(t)
    table = template_table(spark, templates)
    every = sorted({a for some in by_length.values() for a in anchors(tuple(some))})
    held = docs.select(F.col(key).alias("key"), F.col(text).alias("body")).where(F.lower("body").rlike("|".join(every)))
    words = held.select("key", F.split(F.trim(F.regexp_replace(F.lower("body"), "[^a-z0-9]+", " ")), " ").alias("words"))
    place = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.element_at("words", i).isin(every))
    near = F.transform(place, lambda i: F.struct(i.alias("at"), F.element_at("words", i).alias("word")))
    runs = words.select("key", near.alias("near"), shingle_hashes(F.col("words")).alias("runs"))
    of = lambda some: F.transform(F.filter("near", lambda p: p["word"].isin(anchors(tuple(some)))), lambda p: p["at"])
    starts = F.concat(*[starts_of(of(some), F.size("runs"), n) for n, some in sorted(by_length.items())])
    placed = runs.select("key", "runs", F.explode(starts).alias("p")).select("key", "runs", "p.n", "p.start", F.greatest(F.lit(1), F.col("p.start") - F.col("p.n")).alias("begin"))
    # from one window before the window to one behind it
    windows = placed.select("key", "n", "start", (F.col("start") - F.col("begin")).alias("lead"), F.slice("runs", F.col("begin"), F.col("start") + 2 * F.col("n") - F.col("begin")).alias("region"))
    keyed = windows.withColumn("keys", band_keys(F.slice("region", F.col("lead") + 1, F.col("n"))))
    # the template table is a constant of the program, so it may be sent to every task
    bands = F.broadcast(table.select("license", "n", "runs", F.explode("keys").alias("band")))
    found = keyed.withColumn("band", F.explode("keys")).drop("keys").join(bands, ["n", "band"])
    share = F.size(F.array_intersect("region", "runs")) / F.size("runs")
    checked = found.select("key", "license", "start", share.alias("containment")).where(F.col("containment") >= CONTAINMENT)
    best = checked.groupBy("key", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("b"))
    return best.select(F.col("key").alias(key), "license", F.col("b.containment").alias("containment"), (-F.col("b.back")).cast("long").alias("start_word"))


def op8_license_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices in all documents."""
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
