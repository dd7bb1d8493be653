"""Licence scans by Dice coefficient over word bigrams, DataFrame functions only.

A text is normalised (lower case, words of letters and digits, one blank
between) and compared with the templates wherever a licence may stand in it: on
one line, wrapped over several, as a comment, or amid other words. The Dice
coefficient of two sets of word bigrams is twice the number in common over the
sum of their numbers, and one of at least t needs sizes within a ratio of
(2 - t) / t and t / (2 - t) of the template's bigrams in common. So a template is
a candidate only for texts that have so many of its bigrams, which is found out
row by row without a shuffle; other texts go no further.

For a candidate, windows of the template's size, and of a quarter and a half
more, are laid at every sixteenth of the size; each is longer by that step, so
that some window holds a licence at any place. A window is trimmed to its outermost words
of the template's bigrams, and dropped if its size is out of bounds; what is
left is a unit with a coefficient of its own. Of the units of a template that
begin within its size of one another the closest stays.

Defined results: null and empty texts have no findings; a unit of one word has
no bigrams and matches nothing; a unit that is close to two templates has a
row for each; of units as close the shortest stays, then the first; a repeated row
repeats its findings; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselith.staging import stage

DICE = 0.8
#: A template's size over this is the step from window to window.
STEPS = 16
#: Sizes of windows over the template's size; the last is the most that the coefficient allows.
SIZES = (1.0, 1.25, 1.5)
PLACES = 1_000_000

# Words of the templates that any English text has.
COMMON_WORDS = frozenset("a and any are as at be by for from if in is it may must not of on one or other rights that the this to under use used we were with you".split())

# Paragraphs that several licences share.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_FIRST = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
)
BSD_CONDITIONS = (
    ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
BSD_WARRANTY = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# Licence notices and short licences.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": MIT_GRANT,
    "mit-full": MIT_GRANT + " " + MIT_WARRANTY,
    "isc-text": ISC_GRANT,
    "isc-full": ISC_GRANT + " " + ISC_WARRANTY,
    "bsd-text": BSD_FIRST,
    "bsd-2-clause-full": BSD_FIRST + BSD_CONDITIONS + BSD_WARRANTY,
    "bsd-3-clause-full": BSD_FIRST + BSD_CONDITIONS + BSD_THIRD + BSD_WARRANTY,
    "zlib-full": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved.",
}


def normalise(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def template_words(text: str) -> list[str]:
    """The words of a template, as ``normalise`` has them: runs of Unicode letters and numbers."""
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower()).split()


def _python_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def template_rows(templates: dict[str, str]) -> list[tuple[str, str, int, int]]:
    """(license, bigram, different bigrams of the license, all of them)."""
    return [(name, pair, len(pairs), len(template_words(text)) - 1) for name, text in templates.items() for pairs in [_python_bigrams(text)] for pair in pairs]


def anchors(templates: dict[str, str], dice: float) -> list[str]:
    """Words of which every unit has one that is close enough to a template.

    A unit shares at least t / (2 - t) of a template's bigrams. So where more than the rest of a template's
    bigrams have a word of the list, a unit without such words can't be close. Long words are rare ones, and
    words of COMMON_WORDS come last."""
    out: set[str] = set()
    for text in templates.values():
        pairs = [tuple(p.split(" ")) for p in _python_bigrams(text)]
        spare = len(pairs) - math.ceil(dice / (2 - dice) * len(pairs) - 1e-9)
        covered: set[tuple[str, ...]] = set()
        for word in sorted({w for p in pairs for w in p}, key=lambda w: (w in COMMON_WORDS, w not in out, -len(w), w)):
            if len(covered) > spare:
                break
            out.add(word)
            covered |= {p for p in pairs if word in p}
    return sorted(out)


def least_shared(n: int | Column, dice: float) -> int | Column:
    """Bigrams that a text must share with a template of n."""
    share = dice / (2 - dice)
    return max(1, math.ceil(share * n - 1e-9)) if isinstance(n, int) else F.greatest(F.lit(1), F.ceil(n * share - 1e-9).cast("int"))


def candidates(words: Column, templates: dict[str, str], dice: float) -> Column:
    """The names of the templates that have enough bigrams in common with the array of words.

    The array of one array binds the bigrams in common with any template, which each template then looks into."""
    pairs = F.transform(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b")), lambda p: F.concat(p["a"], F.lit(" "), p["b"]))
    own = {name: _python_bigrams(text) for name, text in templates.items()}
    literal = lambda values: F.array(*(F.lit(v) for v in values)).cast("array<string>")
    every = F.array_intersect(pairs, literal(sorted({p for ps in own.values() for p in ps})))
    fits = lambda b: F.array(*(F.when(F.size(F.array_intersect(b, literal(ps))) >= least_shared(len(ps), dice), F.lit(name)) for name, ps in own.items()))
    return F.array_compact(F.transform(F.array(every), fits)[0])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """(doc_id, license, first_word, words, shared, unit_bigrams, license_bigrams, dice) of all units that stay.

    ``first_word``: the place of the unit's first word in the text, from 0; ``words``: how many it has."""
    spark: SparkSession = docs.sparkSession
    ratio = (2 - dice) / dice
    # The templates are given with the call and small: a few thousand bigrams in all.
    inverted = F.broadcast(spark.createDataFrame(template_rows(templates), "license string, bigram string, license_bigrams int, length int"))
    named = F.lit(False)
    for word in anchors(templates, dice):
        # A short word may be part of many others.
        apart = F.col("lower").rlike(rf"(?<![\p{{L}}\p{{N}}]){word}(?![\p{{L}}\p{{N}}])")
        named = named | (F.contains(F.col("lower"), F.lit(word)) if len(word) > 4 else apart)
    lower = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.lower("text").alias("lower")).where(named)
    words = lower.select("doc_id", "row", F.split(normalise(F.col("lower")), " ").alias("words"))
    texts = stage(words.withColumn("licenses", candidates(F.col("words"), templates, dice)).where(F.size("licenses") > 0), "texts")
    each = texts.select("row", "words", "licenses", F.posexplode("words").alias("at", "word")).select("row", "licenses", "at", F.concat("word", F.lit(" "), F.get("words", F.col("at") + 1)).alias("bigram"))
    near = each.join(inverted, "bigram").where(F.array_contains("licenses", F.col("license"))).select("row", "at", "license", "bigram", "license_bigrams", "length")
    n, length, keys = F.col("license_bigrams"), F.col("length"), ["row", "license", "license_bigrams", "length"]
    # The bigrams of a step's stretch together, then each stretch in all windows that it is part of.
    step = F.greatest(F.lit(1), (length / STEPS).cast("int"))
    blocks = near.groupBy(*keys, F.floor(F.col("at") / step).alias("block")).agg(F.collect_set("bigram").alias("bigrams"), F.min("at").alias("low"), F.max("at").alias("high"))
    size = F.explode(F.array(*(F.lit(s) for s in SIZES)))
    spread = blocks.withColumn("size", size).withColumn("count", F.ceil(length * F.col("size") / step).cast("int") + 1)
    windows = spread.select(*keys, "size", "bigrams", "low", "high", F.explode(F.sequence(F.col("block") - F.col("count") + 1, F.col("block"))).alias("window"))
    trimmed = windows.groupBy(*keys, "size", "window").agg(F.size(F.array_distinct(F.flatten(F.collect_list("bigrams")))).alias("shared"), F.min("low").alias("low"), F.max("high").alias("high"))
    words = F.col("high") - F.col("low") + 2
    units = trimmed.where((F.col("shared") >= least_shared(n, dice)) & (F.col("shared") <= words)).select(*keys, F.col("low").alias("first_word"), words.alias("words"), "shared").distinct()
    of = texts.select("doc_id", "row", F.col("words").alias("all"))
    own = F.slice("all", F.col("first_word") + 1, F.col("words"))
    pairs = F.transform(F.arrays_zip(F.slice(own, 1, F.col("words") - 1).alias("a"), F.slice(own, 2, F.col("words") - 1).alias("b")), lambda p: F.concat(p["a"], F.lit(" "), p["b"]))
    sized = units.join(of, "row").withColumn("unit_bigrams", F.size(F.array_distinct(pairs))).drop("all")
    fits = sized.where((F.col("unit_bigrams") <= n * ratio + 1e-9) & (n <= F.col("unit_bigrams") * ratio + 1e-9))
    score = 2.0 * F.col("shared") / (F.col("unit_bigrams") + n)
    close = fits.withColumn("score", score).where(F.col("score") >= dice - 1e-9)
    # Places in millionths of the template's size, so that one range serves all templates.
    place = F.floor(F.col("first_word").cast("bigint") * PLACES / length)
    around = Window.partitionBy("row", "license").orderBy("place").rangeBetween(1 - PLACES, PLACES - 1)
    rank = F.struct("score", (-F.col("words")).alias("w"), (-F.col("first_word")).alias("f"))
    best = close.withColumn("place", place).withColumn("rank", rank).withColumn("best", F.max("rank").over(around)).where(F.col("rank") == F.col("best"))
    return best.select("doc_id", "license", "first_word", "words", F.col("shared").cast("bigint").alias("shared"), "unit_bigrams", "license_bigrams", F.round("score", 6).alias("dice"))
