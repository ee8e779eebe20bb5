"""License scans: normalised text against licence templates by Dice over word bigrams.

Every line of a text is compared, and a text of several lines also as a whole.  A
template can only reach the threshold t with a text of between t / (2 - t) and
(2 - t) / t times as many bigrams as its own; other templates are left out by size.
A window shares at least t / (2 - t) of a template's bigrams when it reaches the
threshold; in texts that hold as many, windows as long as the template slide over the
words, across lines, from every bigram of the template.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailvane.llm.shared import durable

THRESHOLD = 0.8

#: Notices by which texts state their licence.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "EPL-2.0": "Licensed under the Eclipse Public License, version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TOP = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by
the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

#: Standard headers and full texts; windows are compared with these, too.
LONG_TEMPLATES = [
    ("AGPL-3.0", _GNU.format("GNU Affero General Public License", 3)),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", f"{_BSD_TOP} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_TOP} {_BSD_NAMES} {_BSD_END}"),
    ("GPL-2.0", _GNU.format("GNU General Public License", 2)),
    ("GPL-3.0", _GNU.format("GNU General Public License", 3)),
    ("ISC", _ISC),
    ("LGPL-3.0", _GNU.format("GNU Lesser General Public License", 3)),
    ("MIT", _MIT),
    ("MPL-2.0", _MPL),
]


def _bigrams(text: Column) -> Column:
    """Distinct bigrams of the normalised text: lower case, letters and digits only."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.split(plain, " ")


def _pairs(array: str) -> Column:
    shorter = F.slice(F.col(array), F.lit(1), F.greatest(F.size(array) - 1, F.lit(0)))
    return F.array_distinct(F.transform(shorter, lambda w, i: F.concat_ws(" ", w, F.get(F.col(array), i + 1))))


def template_bigrams(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``license, size, bigram``; as large as the templates, which the caller gives as text."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    pairs = rows.select("license", _bigrams(F.col("text")).alias("_w")).select("license", _pairs("_w").alias("_pairs"))
    return pairs.select("license", F.size("_pairs").alias("size"), F.explode("_pairs").alias("bigram"))


def _window_templates(spark: SparkSession, texts: list[tuple[str, str]], share: float) -> DataFrame:
    """``license, grams, length, need``: bigrams, words, and the least number of bigrams to share."""
    rows = spark.createDataFrame(sorted(texts), "license string, text string").select("license", _bigrams(F.col("text")).alias("_w"))
    grams = rows.select("license", F.size("_w").alias("length"), _pairs("_w").alias("grams"))
    return grams.select("license", "length", "grams", F.greatest(F.lit(1), F.ceil(F.size("grams") * share - 1e-6)).cast("int").alias("need"))


def _windows(texts: DataFrame, templates: DataFrame, threshold: float, crowd: int) -> DataFrame:
    """``doc_id, line, last, license, dice, n_bigrams`` of the windows of ``texts`` that reach the threshold.

    ``line`` and ``last`` are the lines of a window's first and last word.  Of windows
    that overlap, one that has a better neighbour is left out, first within a template
    and then among all.  At most ``crowd`` windows of all templates, none overlapping
    another of its own, begin within the longest template's length.
    """
    word = lambda l, i: F.transform(F.filter(_bigrams(l), lambda w: w != ""), lambda w: F.struct(w.alias("w"), (i + 1).alias("line")))  # noqa: E731, E741
    words = texts.select(F.monotonically_increasing_id().alias("_n"), "doc_id", F.flatten(F.transform(F.split("_text", "\n"), word)).alias("_words"))
    n = F.size("_words")
    every = F.transform(
        F.slice(F.col("_words"), F.lit(1), F.greatest(n - 1, F.lit(0))),
        lambda w, i: F.concat_ws(" ", w["w"], F.get(F.col("_words"), i + 1)["w"]),
    )
    each = words.select("_n", "doc_id", F.col("_words.line").alias("_lines"), every.alias("_grams")).crossJoin(F.broadcast(templates))
    each = each.filter(F.size(F.array_intersect("_grams", "grams")) >= F.col("need"))
    starts = F.filter(F.transform("_grams", lambda g, i: F.when(F.array_contains(F.col("grams"), g), i)), lambda i: i.isNotNull())
    window = lambda i: F.array_distinct(F.slice(F.col("_grams"), i + 1, F.col("length") - 1))
    scored = F.transform(
        starts,
        lambda i: F.struct(
            i.alias("at"),
            F.size(window(i)).alias("n"),
            F.round(2 * F.size(F.array_intersect(window(i), F.col("grams"))) / (F.size(window(i)) + F.size("grams")), 9).alias("dice"),
        ),
    )
    good = each.select("_n", "doc_id", "_lines", "license", "length", F.filter(scored, lambda x: x["dice"] >= threshold).alias("_good"))
    size = F.col("length")
    better = lambda x, y: (F.abs(x["at"] - y["at"]) < size) & ((y["dice"] > x["dice"]) | ((y["dice"] == x["dice"]) & (y["at"] < x["at"])))
    # windows are in order, so only so many before and after can overlap
    near = lambda i, most: F.slice(F.col("_good"), F.greatest(i - most, F.lit(0)) + 1, 2 * most + 1)
    best = F.filter("_good", lambda x, i: ~F.exists(near(i, size), lambda y: better(x, y)))
    one = good.select("_n", "doc_id", "_lines", "license", "length", F.explode(best).alias("x"))
    one = one.select(
        "_n",
        "doc_id",
        F.struct(
            "x.at",
            F.col("x.n").alias("n"),
            "x.dice",
            "license",
            (F.col("x.at") + size).alias("end"),
            F.get(F.col("_lines"), F.col("x.at")).alias("line"),
            F.get(F.col("_lines"), F.least(F.col("x.at") + size, F.size("_lines")) - 1).alias("last"),
        ).alias("x"),
    )
    every_one = one.groupBy("_n", "doc_id").agg(F.sort_array(F.collect_list("x")).alias("_good"))
    rank = lambda x: F.struct(-x["dice"], -x["n"], x["license"], x["at"])
    over = lambda x, y: (x["at"] < y["end"]) & (y["at"] < x["end"]) & (rank(y) < rank(x))
    alone = F.filter("_good", lambda x, i: ~F.exists(near(i, F.lit(crowd)), lambda y: over(x, y)))
    out = every_one.select("doc_id", F.explode(alone).alias("x"))
    return out.select("doc_id", "x.line", "x.last", "x.license", "x.dice", F.col("x.n").alias("n_bigrams"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Best template of each line (``line`` from 1) or whole text (0) that reaches ``threshold``.

    Columns ``doc_id, line, license, dice, n_bigrams``; ties go to the first licence by
    name.  A window that reaches it, and touches no line that does (nor the whole text),
    counts for the line of its first word; ``dice`` and ``n_bigrams`` are the window's.
    Texts without a match, null and empty texts give no row.  Rows that repeat an
    id with the same text count once; null ids are kept as one id.
    """
    spark = docs.sparkSession
    given = TEMPLATES if templates is None else templates
    bigrams = template_bigrams(spark, given)
    known = bigrams.collect()  # bounded by the templates
    # a little wider than the bounds, which fractions may miss by a rounding
    share = threshold / (2 - threshold)
    low = min((r["size"] for r in known), default=1) * share - 1e-6
    high = max((r["size"] for r in known), default=0) / share + 1e-6
    sliding = _window_templates(spark, list(given.items()) + (LONG_TEMPLATES if templates is None else []), share)
    slid = [r for r in sliding.collect() if r["grams"]]  # bounded by the templates
    vocabulary = sorted({r["bigram"] for r in known} | {g for r in slid for g in r["grams"]})
    least = min((r["need"] for r in slid), default=1)
    longest = max((r["length"] for r in slid), default=1)
    crowd = sum(longest // r["length"] + 1 for r in slid)

    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    units = docs.select(F.col(id_col).alias("doc_id"), lines.alias("_lines")).select(
        "doc_id",
        (F.size("_lines") == 1).alias("_single"),
        F.posexplode(F.when(F.size("_lines") > 1, F.concat(F.array(F.array_join("_lines", "\n")), F.col("_lines"))).otherwise(F.concat(F.array(F.lit("")), F.col("_lines")))).alias("line", "_text"),
    )
    whole = F.col("_single") | (F.col("line") == 0)
    counted = units.select("doc_id", "line", whole.alias("_whole"), "_text", _bigrams(F.col("_text")).alias("_w"))
    counted = counted.select("doc_id", "line", "_whole", "_text", F.when(F.size("_w") > low, _pairs("_w")).otherwise(F.array().cast("array<string>")).alias("_pairs"))
    counted = counted.select("doc_id", "line", "_whole", "_text", F.size("_pairs").alias("n_bigrams"), F.filter("_pairs", lambda p: p.isin(vocabulary)).alias("_hits"))
    # the bounds stand inside explode(), and nothing above it can be null: a filter, inferred
    # ones too, would move below the projections and repeat their work for every word
    needed = F.array(*[F.struct(F.array(*map(F.lit, r["grams"])).alias("grams"), F.lit(r["need"]).alias("need")) for r in slid]) if slid else None
    enough = F.lit(False) if needed is None else F.exists(needed, lambda t: F.size(F.array_intersect(F.col("_hits"), t["grams"])) >= t["need"])
    slide = F.col("_whole") & (F.size("_hits") >= least) & enough
    fits = F.col("n_bigrams").between(low, high) & (F.size("_hits") > 0)
    row = F.struct("_hits", F.when(slide, F.col("_text")).alias("_text"))
    units = counted.select("doc_id", "line", "n_bigrams", F.explode(F.when(fits | slide, F.array(row))).alias("_unit"))
    # written once: both comparisons read it, and few units share a bigram with a template
    units = durable(units.select("doc_id", "line", "n_bigrams", "_unit.*"))
    shared = (
        units.filter(F.col("n_bigrams").between(low, high))
        .select("doc_id", "line", "n_bigrams", F.explode("_hits").alias("bigram"))
        .distinct()
        .join(F.broadcast(bigrams), "bigram")
        .filter(F.col("n_bigrams").between(F.col("size") * share - 1e-6, F.col("size") / share + 1e-6))
        .groupBy("doc_id", "line", "n_bigrams", "license", "size")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    dice = shared.withColumn("dice", F.round(2 * F.col("shared") / (F.col("n_bigrams") + F.col("size")), 9)).filter(F.col("dice") >= threshold)
    by_unit = _best(dice)
    taken = by_unit.select(F.col("doc_id").alias("_id"), F.col("line").alias("_line"))
    touches = F.col("doc_id").eqNullSafe(F.col("_id")) & ((F.col("_line") == 0) | F.col("_line").between(F.col("line"), F.col("last")))
    windows = _windows(units.filter("_text is not null").select("doc_id", "_text"), sliding, threshold, crowd).join(taken, touches, "left_anti")
    return by_unit.unionByName(_best(windows))


def _best(found: DataFrame) -> DataFrame:
    best = found.groupBy("doc_id", "line").agg(F.min(F.struct((-F.col("dice")).alias("worst"), "license", "n_bigrams")).alias("b"))
    return best.select("doc_id", "line", "b.license", (-F.col("b.worst")).alias("dice"), F.col("b.n_bigrams").cast("long").alias("n_bigrams"))


def scan_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The query's rows in DuckDB, without the pruning."""
    given = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted((TEMPLATES if templates is None else templates).items()))
    pairs = "list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"
    norm = r"string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    return f"""
WITH given(license, text) AS (VALUES {given}),
t AS (SELECT license, {pairs} AS tp FROM (SELECT license, {norm.format("text")} AS w FROM given)),
lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, text FROM documents),
units AS (SELECT doc_id, 0 AS line, text FROM lines WHERE len(ls) > 1
  UNION ALL SELECT doc_id, unnest(range(1, len(ls) + 1))::INT AS line, unnest(ls) AS text FROM lines),
u AS (SELECT doc_id, line, {pairs} AS up FROM (SELECT doc_id, line, {norm.format("text")} AS w FROM units)),
scored AS (SELECT doc_id, line, license, len(up) AS n_bigrams,
  round(2.0::DOUBLE * len(list_intersect(up, tp)) / (len(up) + len(tp)), 9) AS dice FROM u, t)
SELECT doc_id, line, license, dice, n_bigrams FROM scored WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) = 1
"""
