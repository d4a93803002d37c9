"""Find licence texts in documents with MinHash bands and exact shingle containment.

Templates of similar length form a class; documents are cut into overlapping windows of
twice the class's length, so any passage of that length lies whole in a window. Windows
that hold at least one template shingle are sketched; each band of a sketch is one
minimum, and equal bands retrieve templates. The shingles themselves then decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import stored

#: Words in a shingle, least share of a template's shingles that a window must hold, bands of one row each.
SHINGLE, LEAST, BANDS = 5, 0.8, 64

#: Licence notices by name; fixed values. Each has SHINGLE words at least.
TEMPLATES = {
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-bsd-3-clause": "SPDX-License-Identifier: BSD-3-Clause",
}


def collision_probability(bands: int = BANDS, least: float = LEAST) -> float:
    """Lower bound of the chance that a window with containment `least` shares a band with its template.

    A template of t shingles is in the class of step s, s / 2 < t <= s. A window has at
    most 2 * s < 4 * t shingles, of which least * t are shared, so the Jaccard similarity
    is at least least * t / (4 * t + (1 - least) * t).
    """
    return 1 - (1 - least / (4 + 1 - least)) ** bands


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _shingle(words: Column, i: Column) -> Column:
    return F.array_join(F.slice(words, i + 1, SHINGLE), " ")


def _places(n_words: Column) -> Column:
    """0, 1, ... for every shingle; an empty array for too few words."""
    return F.when(n_words >= SHINGLE, F.sequence(F.lit(0), n_words - SHINGLE)).otherwise(F.array().cast("array<int>"))


def _sketch(hashes: Column, bands: int) -> Column:
    def least(band: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))

    return F.array(*map(least, range(bands)))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once and not again for each element of an array."""
    return F.transform(F.array(value), f)[0]


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """template, step (the class), shingles (distinct) and hashes of each template."""
    rows = spark.createDataFrame(list(templates.items()), "template string, text string").withColumn("w", words_of(F.col("text")))
    rows = rows.where(F.size("w") >= SHINGLE).select("template", "w", F.array_distinct(F.transform(_places(F.size("w")), lambda i: _shingle(F.col("w"), i))).alias("shingles"))
    step = F.pow(F.lit(2), F.ceil(F.log2(F.size("w") - SHINGLE + 1))).cast("int")
    return rows.select("template", step.alias("step"), "shingles", F.transform("shingles", lambda s: F.xxhash64(s)).alias("hashes"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, bands: int = BANDS) -> DataFrame:
    """One row a document and template found in it: _row, doc_id, template, containment, first_word, windows.

    docs has _row, doc_id and text. containment is the best of its windows, first_word the
    place of the first window that holds LEAST or more, windows their number. Null, empty
    and short texts and an empty table have no row; very long texts are cut into windows
    whole; repeated rows have rows of their own; of equal containments the windows are
    counted, so there are no ties. Other columns of docs are not read. The templates are a
    parameter, some hundred thousand shingles at most, as a plan holds their hashes;
    windows without any cannot match and are not sketched.
    """
    spark = docs.sparkSession
    known = stored(template_table(spark, TEMPLATES if templates is None else templates))
    told = known.select("step", "hashes").collect()  # a row a template
    wanted, steps = sorted({h for r in told for h in r["hashes"]}), sorted({r["step"] for r in told})
    if not wanted:
        wanted, steps = [0], [1]

    def starts(hits: Column, step: int) -> Column:
        at = F.transform(hits, lambda i: (i / step).cast("int") * step)
        both = F.filter(F.array_distinct(F.concat(at, F.transform(at, lambda i: i - step))), lambda i: i >= 0)
        return F.transform(both, lambda i: F.struct(F.lit(step).alias("step"), i.alias("start")))

    def windows(w: Column) -> Column:
        hits = F.filter(_places(F.size(w)), lambda i: F.xxhash64(_shingle(w, i)).isin(*wanted))
        spans = _once(hits, lambda h: F.concat(*[starts(h, s) for s in steps]))
        cut = lambda x: F.slice(w, x["start"] + 1, x["step"] * 2 + SHINGLE - 1)
        return F.transform(spans, lambda x: F.struct(x["step"].alias("step"), x["start"].alias("start"), cut(x).alias("w")))

    # The row number in the same projection keeps the optimizer from working the windows out a second time in a filter.
    found = docs.select("_row", "doc_id", _once(words_of(F.col("text")), windows).alias("windows"), F.monotonically_increasing_id().alias("doc"))
    cut = found.select("_row", "doc_id", "doc", F.explode("windows").alias("x")).select("_row", "doc_id", F.struct("doc", "x.step", "x.start").alias("id"), "x.step", "x.start", "x.w")
    shingles = _once(F.col("w"), lambda w: F.array_distinct(F.transform(_places(F.size(w)), lambda i: _shingle(w, i))))
    cut = stored(cut.select("id", "_row", "doc_id", "step", "start", shingles.alias("shingles")))

    hashes = F.transform("shingles", lambda s: F.xxhash64(s))
    sketches = cut.select("id", "step", F.posexplode(_once(hashes, lambda h: _sketch(h, bands))).alias("band", "least"))
    filed = known.select("template", "step", F.posexplode(_sketch(F.col("hashes"), bands)).alias("band", "least"))
    pairs = sketches.join(filed, ["step", "band", "least"]).select("id", "template").distinct()
    share = F.size(F.array_intersect("t", "shingles")) / F.size("t")
    checked = pairs.join(cut.select("id", "_row", "doc_id", "start", "shingles"), "id").join(known.select("template", F.col("shingles").alias("t")), "template")
    checked = checked.withColumn("containment", share).where(F.col("containment") >= LEAST)
    return checked.groupBy("_row", "template").agg(
        F.first("doc_id").alias("doc_id"), F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_word"), F.count(F.lit(1)).alias("windows")
    )


def op3(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    return scan(rows).drop("_row")


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    words = "string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
ds AS (SELECT r, doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
t AS (SELECT template, {words} AS w FROM (VALUES {values}) v(template, text)),
ts AS (SELECT DISTINCT template, CAST(pow(2, ceil(log2(len(w) - 4))) AS INT) AS step, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - 4)) AS i FROM t)),
n AS (SELECT template, count(*) AS n FROM ts GROUP BY template),
hits AS (SELECT r, doc_id, template, g, step, unnest([i // step * step, i // step * step - step]) AS start FROM ds JOIN ts USING (g)),
shares AS (SELECT r, any_value(doc_id) AS doc_id, template, start, count(DISTINCT g) / any_value(n) AS share FROM hits JOIN n USING (template) WHERE start >= 0 GROUP BY r, template, start)
SELECT any_value(doc_id) AS doc_id, template, max(share) AS containment, CAST(min(start) AS BIGINT) AS first_word, count(*) AS windows FROM shares WHERE share >= 0.8 GROUP BY r, template
"""


SQL = _sql()
