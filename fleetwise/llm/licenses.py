"""Licence scans: sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor folder.

Units of a file are its lines, its blocks (what blank lines part) and its windows: for every template,
also for whole notices, the runs of as many words as the template has, from each of its words on. Words
have no line ends and comment marks, so a wrapped header or a sentence inside a paragraph is a window like
any other. A unit's vector has a term for each distinct word that is no stop word: its count times its
inverse document frequency among the templates. The licence of a unit is that of the template with the largest cosine, if it reaches the
threshold.

Whole texts are searched, but only few units need vectors: take the terms of a template by falling
weight until the squares of the rest sum up to less than the squared threshold. By Cauchy-Schwarz a unit without
any of those heavy terms has a cosine below the threshold, so it is left out unseen. And a unit with i
words of the notices and o others has a squared cosine of i i / (i i + o) at most, as no word of the notices
weighs more than another word: long units with a licence line in them go, the line itself stays. Windows of
a template are taken only where its distinct words in them have squared weights that sum up to the squared
threshold at least, which is Cauchy-Schwarz again: first asked of the whole file, then of positions
(so many of its words within its length), then of each window.

A licence file is one whose name says so, or in which a matching unit makes up ``share`` of the words.
It speaks for its folder and everything below, unless a deeper licence file does; a file's own
header comes first. DataFrame functions alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetwise.llm.winnow import small, word_list
from fleetwise.shared import kept, scope, stored

# Public notices, as (licence, text). Fixed values.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. "
    "{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. "
    "You should have received a copy of the GNU {1} along with this {3}. If not, see <https://www.gnu.org/licenses/>."
)
_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# Whole notices, for windows alone: lines and blocks keep the weights of NOTICES. The near relatives of
# the GPL are here so that their headers go to them.
WHOLE = [
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("AGPL-3.0", _GNU.format("This program", "Affero General Public License", 3, "program")),
    ("BSD-2-Clause", _BSD + _BSD_TWO + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_TWO + _BSD_THREE + _BSD_END),
    ("GPL-2.0", _GNU.format("This program", "General Public License", 2, "program")),
    ("GPL-3.0", _GNU.format("This program", "General Public License", 3, "program")),
    ("LGPL-2.1", _GNU.format("This library", "Lesser General Public License", 2.1, "library")),
    ("LGPL-3.0", _GNU.format("This library", "Lesser General Public License", 3, "library")),
    ("MIT", _GRANT),
    (
        "MIT",
        _GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]

# Words without weight.
STOP = "a an and any are as at be by can for in is it may not of on or that the this to under with you".split()


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.75
    share: float = 0.25
    names: str = r"(?i)^(licen[cs]e|copying|notice)([.-]|$)"


def content_words(text: Column) -> Column:
    return F.filter(word_list(text), lambda w: ~w.isin(STOP))


def templates(spark: SparkSession, notices: list[tuple[str, str]]) -> DataFrame:
    """``template``, ``licence``, ``word``, ``weight`` (unit length), ``idf``."""
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(notices)], "template int, licence string, text string")
    terms = rows.select("template", "licence", F.explode(content_words(F.col("text"))).alias("word")).groupBy("template", "licence", "word").count()
    rare = terms.groupBy("word").agg((F.log((1 + F.lit(len(notices))) / (1 + F.count("*"))) + 1).alias("idf"))
    terms = terms.join(rare, "word").withColumn("raw", F.col("count") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("template")))
    return terms.withColumn("weight", F.col("raw") / norm).select("template", "licence", "word", "weight", "idf")


def heavy_words(terms: DataFrame, threshold: float) -> list[str]:
    """Words of which a unit must hold one to reach the threshold with any template."""
    up = Window.partitionBy("template").orderBy("weight", "word")
    light = F.sum(F.col("weight") * F.col("weight")).over(up) < threshold * threshold - 1e-9
    return sorted(r["word"] for r in terms.withColumn("light", light).where("NOT light").select("word").distinct().collect())


def lines_and_blocks(files: DataFrame, terms: DataFrame, settings: Settings) -> DataFrame:
    """``path``, ``mark``, ``all_words``, ``unit`` and its ``words`` of the lines and blocks that may match."""
    inside = "[0-9A-Za-z]"
    heavy = f"(?i)(?<!{inside})(?:{'|'.join(heavy_words(terms, settings.threshold))})(?!{inside})"
    known = [r["word"] for r in terms.select("word").distinct().collect()]  # the words of the notices
    texts = files.where(F.col("text").rlike(heavy))
    units = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", r"\n\s*\n")))
    cut = texts.select("path", "mark", F.size(word_list(F.col("text"))).alias("all_words"), F.explode(units).alias("unit"))
    cut = cut.where(F.col("unit").rlike(heavy)).withColumn("words", content_words(F.col("unit")))
    inner = F.size(F.filter("words", lambda w: w.isin(known)))
    most = (1 / settings.threshold**2 - 1) * inner * inner + 1e-6
    return cut.where(F.size("words") - inner <= most)


def windows(files: DataFrame, terms: DataFrame, notices: list[tuple[str, str]], settings: Settings) -> DataFrame:
    """``path``, ``mark``, ``all_words``, ``unit`` and its ``words`` of the windows that may match."""
    spark = files.sparkSession
    listed = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(notices)], "template int, text string")
    least, rows, known = settings.threshold**2 - 1e-9, [], set()
    weights: dict[int, dict[str, float]] = {}
    for r in terms.select("template", "word", "weight").collect():  # as many as the notices have words
        weights.setdefault(r["template"], {})[r["word"]] = r["weight"] ** 2
    for r in listed.select("template", word_list(F.col("text")).alias("w")).collect():
        own = weights.get(r["template"], {})
        at = [i for i, w in enumerate(r["w"]) if w in own]
        sums = list(accumulate(sorted(own.values(), reverse=True)))
        if at:
            known |= set(own)
            rows.append((at[-1] - at[0] + 1, 1 + sum(x < least for x in sums), sorted(own), sorted(own.items())))
    kinds = spark.createDataFrame(rows, "width int, least int, own array<string>, squares array<struct<word: string, square: double>>")

    def square(within: Column) -> Column:
        return F.aggregate("squares", F.lit(0.0), lambda a, x: a + F.when(F.array_contains(within, x["word"]), x["square"]).otherwise(0.0))

    texts = files.where("text IS NOT NULL").select("path", "mark", word_list(F.col("text")).alias("all"))
    mine = F.array_distinct(F.filter("all", lambda w: w.isin(sorted(known))))
    texts = texts.withColumn("mine", mine).where(F.size("mine") >= min((r[1] for r in rows), default=1))
    met = texts.join(F.broadcast(kinds), (F.size("mine") >= F.col("least")) & (square(F.col("mine")) >= least))
    at = F.filter(F.transform("all", lambda w, i: F.when(F.array_contains("own", w), i)), lambda i: i.isNotNull())
    met = met.drop("mine").withColumn("at", at)
    starts = F.filter("at", lambda p, j: F.get("at", j + F.col("least") - 1) < p + F.col("width"))
    cut = met.select("path", "mark", F.size("all").alias("all_words"), "all", "width", "squares", F.explode(starts).alias("start"))
    cut = cut.withColumn("run", F.slice("all", F.col("start") + 1, F.col("width"))).where(square(F.col("run")) >= least)
    unit = F.array_join("run", " ").alias("unit")
    return cut.select("path", "mark", "all_words", unit, F.filter("run", lambda w: ~w.isin(STOP)).alias("words")).distinct()


def matches(files: DataFrame, notices: list[tuple[str, str]], whole: list[tuple[str, str]], settings: Settings) -> DataFrame:
    """``path``, ``mark``, ``unit``, ``n``, ``all_words``, ``licence``, ``cosine`` of the units that match."""
    spark = files.sparkSession
    terms, every = (stored(templates(spark, x), "terms") for x in (notices, notices + whole))
    found = close(lines_and_blocks(files, terms, settings), terms, len(notices), settings)
    return found.unionByName(close(windows(files, every, notices + whole, settings), every, len(notices + whole), settings))


def close(cut: DataFrame, terms: DataFrame, n_notices: int, settings: Settings) -> DataFrame:
    """The units of ``cut`` that reach the threshold with a template of ``terms``."""
    own = ["path", "mark", "unit_key"]
    cut = stored(cut.withColumn("unit_key", F.xxhash64("unit")), "units")
    counted = cut.select(*own, F.explode("words").alias("word")).groupBy(*own, "word").count()
    idf = terms.select("word", "idf").distinct()
    other = F.log(F.lit(1.0 + n_notices)) + 1
    counted = stored(counted.join(F.broadcast(idf), "word", "left").withColumn("x", F.col("count") * F.coalesce("idf", other)).drop("idf", "count"), "vectors")
    norms = counted.groupBy(*own).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = counted.join(F.broadcast(terms.select("template", "licence", "word", "weight")), "word")
    dots = dots.groupBy(*own, "template", "licence").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    near = dots.join(norms, [dots[c].eqNullSafe(norms[c]) for c in own]).select(*(dots[c] for c in own), "licence", (F.col("dot") / F.col("norm")).alias("cosine"))
    near = near.where(F.col("cosine") >= settings.threshold - 1e-9)
    best = near.groupBy(*own).agg(F.min(F.struct((-F.round("cosine", 9)).alias("c"), "licence")).alias("b"))
    joined = best.join(cut, [best[c].eqNullSafe(cut[c]) for c in own])
    return joined.select(best["path"], best["mark"], "unit", F.size(word_list(F.col("unit"))).alias("n"), "all_words", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(
    files: DataFrame, notices: list[tuple[str, str]] = NOTICES, settings: Settings = Settings(), whole: list[tuple[str, str]] = WHOLE
) -> DataFrame:
    """Per row of ``files`` (``path``, ``text``): ``path``, ``mark``, ``licence``, ``cosine``, ``origin``, ``licence_folder``.

    ``mark`` is the hash of the text. ``origin`` is ``header`` (the file's own best unit, with its
    cosine), ``inherited`` (from ``licence_folder``, the nearest folder at or above the file's with a
    licence file; of several there the one with the largest cosine, then the smallest path), or
    null. Ties between licences go to the smaller name. Null and empty texts match nothing and may
    inherit; a null path inherits nothing. Repeated rows get equal results. Other columns are
    not looked at; an empty table gives no rows.
    """
    with scope():
        rows = files.select("path", F.xxhash64("text").alias("mark"), "text")
        found = stored(matches(rows, notices, whole, settings), "matches")
        best = found.groupBy("path", "mark").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
        best = stored(best.select("path", "mark", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine")), "headers")
        named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(settings.names)
        speaks = found.where(F.col("path").isNotNull() & (named | (F.col("n") >= settings.share * F.col("all_words"))))
        folders = speaks.groupBy(folder_of(F.col("path")).alias("above")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "licence")).alias("b"))
        folders = stored(folders.select("above", F.col("b.licence").alias("given")), "folders")
        places = rows.where("path IS NOT NULL").select(folder_of(F.col("path")).alias("folder")).distinct()
        parts = F.split("folder", "/")
        every = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
        )
        up = places.select("folder", F.explode(F.array_distinct(every)).alias("above"))
        nearest = up.join(small(folders), "above").groupBy("folder").agg(F.max(F.struct(F.length("above").alias("l"), "above", "given")).alias("b"))
        nearest = stored(nearest.select("folder", F.col("b.above").alias("licence_folder"), F.col("b.given").alias("given")), "nearest")
        placed = rows.select("path", "mark", folder_of(F.col("path")).alias("folder"))
        side = small(best)
        with_own = placed.join(side, placed["path"].eqNullSafe(best["path"]) & (placed["mark"] == best["mark"]), "left").select(placed["path"], placed["mark"], "folder", "licence", "cosine")
        whole = with_own.join(small(nearest), "folder", "left")
        has = F.col("licence").isNotNull()
        return kept(
            whole.select(
                "path", "mark", F.coalesce("licence", "given").alias("licence"), "cosine",
                F.when(has, "header").when(F.col("given").isNotNull(), "inherited").alias("origin"),
                F.when(~has, F.col("licence_folder")).alias("licence_folder"),
            ),
            "licences",
        )
