"""License scans by MinHash bands over overlapping text windows, in DataFrame functions only.

Texts and templates are shingles of five words.  Templates are grouped by their number of shingles, up to a power of two M; windows
of M + stride - 1 shingles, a stride of M / 4 apart, cover every place where such a template can stand.  A window that holds at least
``CONTAINED`` of a template has a Jaccard share J with it that the class gives a bound for; with bands of one row each, and as many
bands as bring (1 - J) ** bands under ``MISS``, such a window meets the template in some band with a probability of 1 - MISS at least.
What meets is verified by exact containment of the template's shingles in the window.

A window can only meet a template in a band if it holds the shingle that is the template's least in that band.  So texts and windows
without any of those shingles, whose bands could not meet, are let go before their minima are taken; nothing is lost by it.

A template under five words is one shingle of its whole word sequence, with windows of one shingle: ``scan_short`` finds these exactly,
and ``scan`` refuses them.

Defined cases: null and short texts (under five words) match nothing in ``scan``; repeated rows of an id give one row for each template:
the best window, of equally good ones the first; ids that are null are one id; texts of any length are scanned whole, in time and
memory in proportion to it; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled

SHINGLE, CONTAINED, MISS, MAX_TEMPLATES = 5, 0.8, 1e-3, 5000
#: Public license notices and texts.
NOTICES = {
    "mit-line": "Released under the MIT License.",
    "mit-licensed": "This project is licensed under the MIT License",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-line": "This library is free software under the terms of the GNU Lesser General Public License",
    "agpl-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "no-warranty": "The software is provided \"as is\", without warranty of any kind, express or implied",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS "
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
        "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed "
        "or altered from any source distribution."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}
#: Notices of fewer words than a shingle, for ``scan_short``.
SHORT_NOTICES = {"all-rights-reserved": "All rights reserved.", "spdx-mit": "SPDX-License-Identifier: MIT"}


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES.items()), "template_id string, text string")


def short_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SHORT_NOTICES.items()), "template_id string, text string")


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    return settled(df, "_words", F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), ""))


def with_shingles(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``h``: the hashes of its shingles, in order."""
    df = with_words(df, text)
    at = lambda i: F.get(F.col("_words"), i)
    long_enough = F.size("_words") >= SHINGLE
    hashes = F.transform(F.sequence(F.lit(0), F.size("_words") - SHINGLE), lambda i: F.xxhash64(*[at(i + j) for j in range(SHINGLE)]))
    return settled(df, "h", F.when(long_enough, hashes).otherwise(F.array().cast("array<bigint>"))).drop("_words")


def class_of(shingles: int) -> tuple[int, int, int, int]:
    """(M, window, stride, bands) for templates of so many shingles."""
    m = 1 << max(0, shingles - 1).bit_length()
    stride = max(1, m // 4)
    window = m + stride - 1
    least = m // 2 + 1 if m > 1 else 1
    share = math.ceil(CONTAINED * least)
    j = share / (window + least - share)
    return m, window, stride, 1 if j >= 1 else math.ceil(math.log(MISS) / math.log(1 - j))


def scan(docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text", contained: float = CONTAINED) -> DataFrame:
    """key, template_id, containment, position (of the window's first word, from 0), windows: a row for each match."""
    spark = docs.sparkSession
    made = with_shingles(templates.select("template_id", F.col("text"))).select("template_id", "h").limit(MAX_TEMPLATES + 1).collect()
    if len(made) > MAX_TEMPLATES:
        raise ValueError(f"over {MAX_TEMPLATES} templates")
    if short := [t["template_id"] for t in made if not t["h"]]:
        raise ValueError(f"templates of under {SHINGLE} words: {short}")
    kinds_of = {t["template_id"]: class_of(len(set(t["h"]))) for t in made}
    classes = sorted(set(kinds_of.values()))
    whole = spark.createDataFrame([(t["template_id"], sorted(set(t["h"])), kinds_of[t["template_id"]][0], kinds_of[t["template_id"]][3]) for t in made], "template_id string, own array<bigint>, m int, n int")
    by_band = whole.select("template_id", "own", "m", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    first = F.array_min(F.transform("own", lambda x: F.struct(F.xxhash64(x, F.col("k")).alias("value"), x.alias("x"))))
    sketch = by_band.withColumn("first", first).select("template_id", "own", "m", "k", "first.value", "first.x")
    rows = sketch.collect()  # MAX_TEMPLATES times the bands at most
    least = sorted({r["x"] for r in rows})
    index = spark.createDataFrame([(r["m"], r["k"], r["value"], r["template_id"], r["own"]) for r in rows], "m int, k int, value long, template_id string, own array<bigint>")
    holds = lambda h: F.exists(h, lambda x: x.isin(least))  # noqa: E731  a set: one look-up for a shingle, however many templates
    hashed = with_shingles(docs.select(F.col(key), F.col(text).alias("text"))).select(key, "h").where(holds("h"))

    def cut(m: int, w: int, stride: int, n: int) -> Column:
        """The windows of one class, as rows of their own: what is exploded carries no text along."""
        at = F.sequence(F.lit(0), F.greatest(F.size("h") - 1, F.lit(0)), F.lit(stride))
        return F.transform(at, lambda i: F.struct(F.lit(m).alias("m"), F.lit(n).alias("n"), i.alias("at"), F.slice(F.col("h"), i + 1, F.lit(w)).alias("window")))

    windows = hashed.select(key, F.explode(F.concat(*[cut(*c) for c in classes])).alias("c")).select(key, "c.*")
    windows = windows.where(holds("window"))  # without a template's least shingle a window can't meet it in a band
    minima = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(k.alias("k"), F.array_min(F.transform(F.col("window"), lambda x: F.xxhash64(x, k))).alias("value")))
    met = windows.select(key, "at", "m", "window", F.explode(minima).alias("b")).select(key, "at", "m", "window", F.col("b.k").alias("k"), F.col("b.value").alias("value"))
    met = met.join(F.broadcast(index), ["m", "k", "value"])
    share = F.size(F.array_intersect("window", "own")) / F.size("own").cast("double")
    found = met.select(key, "template_id", "at", share.alias("containment")).where(F.col("containment") >= contained)
    best = F.max_by("at", F.struct("containment", -F.col("at")))
    return found.groupBy(key, "template_id").agg(F.max("containment").alias("containment"), best.alias("position"), F.count_distinct("at").alias("windows"))


def scan_short(docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``scan`` gives, for templates of under five words: the places where all words of one stand in a row."""
    spark = docs.sparkSession
    made = with_words(templates.select("template_id", F.col("text"))).select("template_id", "_words").limit(MAX_TEMPLATES + 1).collect()
    if len(made) > MAX_TEMPLATES:
        raise ValueError(f"over {MAX_TEMPLATES} templates")
    if other := [t["template_id"] for t in made if not 0 < len(t["_words"]) < SHINGLE]:
        raise ValueError(f"templates of no words, or of {SHINGLE} and more: {other}")
    index = spark.createDataFrame([(t["template_id"], t["_words"][-1], t["_words"]) for t in made], "template_id string, last string, own array<string>")
    lasts = sorted({t["_words"][-1] for t in made})
    # a word of a text stands in its lower-cased text: only texts that hold a last word need be split
    some = docs.select(F.col(key), F.col(text).alias("text")).where(F.lower("text").rlike("|".join(lasts)))
    hashed = with_words(some).where(F.exists("_words", lambda w: w.isin(lasts)))
    ends = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.get(F.col("_words"), i).isin(lasts))
    places = hashed.select(key, "_words", F.explode(ends).alias("end")).withColumn("last", F.get("_words", F.col("end")))
    met = places.join(F.broadcast(index), "last").withColumn("at", F.col("end") - F.size("own") + 1).where("at >= 0")
    met = met.where(F.slice("_words", F.col("at") + 1, F.size("own")) == F.col("own"))
    return met.groupBy(key, "template_id").agg(F.lit(1.0).alias("containment"), F.min("at").alias("position"), F.count_distinct("at").alias("windows"))
