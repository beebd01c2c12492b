"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment verifies them.

DataFrame functions only.  Words are runs of ASCII letters and digits, lower-cased;
shingles are five words.  A template of L shingles is looked for in windows of 2 L
shingles that begin at every (L / 4)-th shingle (rounded down, at least one), so any
7 L / 4 shingles in a row lie within one window: a template is found at every place,
with a passage of up to three quarters of its length in its middle too.  A window that
holds 0.8 of a template has a Jaccard similarity to it of 0.8 / 2.2 at least, and
with 32 bands of one MinHash value each at least one agrees with a probability of
1 - (1 - 0.36) ** 32 > 0.999999.  A band can agree only if the window holds the
template's own minimal shingle of that band.  So texts are read once for the places
of such shingles, by a join with the templates' table (broadcast where it is counted
to be small), and once more for those windows, whose bands and containment are then
compared.  Only places and windows, small rows, are shuffled.

Defined cases: a null text has no words; fewer than five words have no shingle, so
no match; rows of equal doc_id and text are reported once, rows of equal (or null)
doc_id and other text each for itself; of a text's windows the one with most of the
template, of equal ones the first; templates without a shingle match nothing, of
templates of one name the greatest text counts; of licenses that share 0.8 of their
texts (BSD-2-Clause and BSD-3-Clause) each is reported, with its own containment;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, few, written

SHINGLE, BANDS, LEAST, STEPS = 5, 32, 0.8, 4
#: Templates are broadcast up to so many shingles in all (some 100 MB); beyond, Spark joins them by a shuffle.
BROADCAST_SHINGLES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: License lines, notices and whole texts of licenses (their copyright lines left out), as their stewards publish them.
TEMPLATES: dict[str, str] = {
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "MIT line": "Released under the MIT License.",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0 notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "BSD notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0 text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit("[0-9a-z]+"), F.lit(0))


def shingles(w: Column) -> Column:
    """Shingles of an array of words, as texts."""
    return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))).otherwise(F.array().cast("array<string>"))


def band(shingle: Column, b: int | Column) -> Column:
    return F.xxhash64(F.lit(b) if isinstance(b, int) else b, shingle)


def prepared(templates: DataFrame, bands: int) -> DataFrame:
    """(license, n, step, s, least, hashes): a template's shingles, its values by band, and the hashes of the shingles that have them."""
    rows = templates.groupBy("license").agg(F.max("text").alias("text")).where("license is not null")
    rows = rows.withColumn("s", F.array_distinct(shingles(words(F.col("text"))))).where(F.size("s") > 0)
    lowest = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform("s", lambda x: F.struct(band(x, b).alias("v"), x.alias("s")))))
    rows = rows.withColumn("m", lowest)
    return rows.select(
        "license", F.size("s").alias("n"), F.greatest(F.lit(1), F.floor(F.size("s") / STEPS)).cast("int").alias("step"), "s",
        F.transform("m", lambda x: x["v"]).alias("least"), F.array_distinct(F.transform("m", lambda x: F.xxhash64(F.split(x["s"], " ")))).alias("hashes"),
    )


def scan(docs: DataFrame, templates: DataFrame | dict[str, str] | None = None, bands: int = BANDS, least: float = LEAST) -> DataFrame:
    """(doc_id, license, containment, first_word): the best window of each template that a text holds to ``least`` or more.

    templates: (license, text) rows, or texts by name; ``TEMPLATES`` if None.
    """
    if templates is None or isinstance(templates, dict):
        templates = docs.sparkSession.createDataFrame(sorted((TEMPLATES if templates is None else templates).items()), "license string, text string")
    known = written(prepared(templates, bands), "license-templates")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    small = F.broadcast(known) if total <= BROADCAST_SHINGLES else known
    owners = written(known.select("license", "n", "step", F.explode("hashes").alias("hash")), "license-hashes")
    w, key = F.col("w"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tx")

    # First reading: places of the templates' minimal shingles, then the windows that hold them.
    split = docs.select("doc_id", key, words(F.col("text")).alias("w")).where(F.size(w) >= SHINGLE)
    places = split.select("doc_id", "tx", "w", F.explode(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1)).alias("i")).select("doc_id", "tx", "i", F.xxhash64(F.slice(w, F.col("i"), SHINGLE)).alias("hash"))
    first, last = F.floor((F.col("i") - 2 * F.col("n") + F.col("step") - 1) / F.col("step")), F.floor((F.col("i") - 1) / F.col("step"))
    near = places.join(few(owners), "hash").select("doc_id", "tx", "license", "n", "step", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("int"), last.cast("int"))).alias("j")).distinct()
    near = written(near.groupBy("doc_id", "tx").agg(F.collect_list(F.struct("license", "n", "step", "j")).alias("c")), "license-windows")  # a text's own windows

    # Second reading: those windows' shingles.
    near = near.select(F.col("doc_id").alias("nd"), F.col("tx").alias("nt"), "c")
    held = docs.select("doc_id", key, "text").join(few(near, F.size("c")), F.col("doc_id").eqNullSafe(F.col("nd")) & (F.col("tx") == F.col("nt")))
    held = held.select("doc_id", "tx", words(F.col("text")).alias("w"), "c").select("doc_id", "tx", "w", F.explode("c").alias("c"))
    start = (F.col("c.j") * F.col("c.step")).alias("start")
    held = held.select("doc_id", "tx", "c.license", start, shingles(F.slice(w, F.col("c.j") * F.col("c.step") + 1, F.col("c.n") * 2 + SHINGLE - 1)).alias("ours"))
    held = held.join(small, "license")
    agrees = F.exists(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform("ours", lambda x: band(x, b))) == F.element_at("least", b + 1))
    shares = held.where(agrees).select("doc_id", "tx", "license", "start", (F.size(F.array_intersect("ours", "s")) / F.col("n")).alias("share")).where(F.col("share") >= least)
    best = shares.groupBy("doc_id", "tx", "license").agg(F.max(F.struct("share", (-F.col("start")).alias("back"))).alias("m"))
    return best.select("doc_id", "license", F.col("m.share").alias("containment"), (-F.col("m.back")).cast("long").alias("first_word"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def sql(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """The same by brute force: every shingle against every template's, windows by their number."""
    values = ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    five = " || ' ' || ".join(f"w[i{f' + {k}' if k else ''}]" for k in range(SHINGLE))

    def of(table: str, key: str) -> str:
        return f"SELECT {key}, i - 1 AS p, {five} AS s FROM (SELECT {key}, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM (SELECT {key}, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z]+') AS w FROM {table}))"

    return f"""
WITH t AS (SELECT * FROM (VALUES {values}) AS v(license, text)),
ts AS (SELECT DISTINCT license, s FROM ({of("t", "license")})),
tn AS (SELECT license, count(*) AS n, greatest(1, count(*) // {STEPS}) AS step FROM ts GROUP BY license),
d AS (SELECT doc_id, text, md5(coalesce(text, '')) AS tx FROM documents),
hits AS (SELECT doc_id, tx, license, n, step, p, d.s FROM ({of("d", "doc_id, tx")}) AS d JOIN ts ON d.s = ts.s JOIN tn USING (license)),
held AS (SELECT doc_id, tx, license, n, step, s, unnest(range(greatest(0, (p - 2 * n + step) // step), p // step + 1)) AS j FROM hits),
shares AS (SELECT doc_id, tx, license, step, j, count(DISTINCT s) / max(n) AS share FROM held GROUP BY doc_id, tx, license, step, j)
SELECT doc_id, license, max(share) AS containment, arg_max(j * step, {{'a': share, 'b': -j}})::BIGINT AS first_word
FROM shares WHERE share >= {least} GROUP BY doc_id, tx, license
"""


OP7_SQL = sql()
