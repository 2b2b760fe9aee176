"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment decides; in DataFrame operations only.

A text's words (runs of letters and digits, lower case) give pairs of neighbours; WINDOW pairs make a
window, and one starts at every STEP-th pair. A template is cut into chunks of at most CHUNK pairs, so a
chunk that stands in a text lies whole in some window, with at least half of the window's pairs (a
template's shortest chunk has WINDOW / 2). Each of BANDS bands is one MinHash with a hash function of its own, so a window meets such a
chunk in some band with probability 1 - (1 - 1/2)^BANDS: 0.9999 and more for 14; a template of several chunks is missed
only if all of its windows are. A band that meets a chunk names it and its template. If the chunk stands whole in the window, the words around it
are compared with that template, and no other: it is found if at least ``least`` of its shingles of five words stand there. (A text that
lacks a fifth of a template's shingles at most has one of its chunks whole, as a shingle that is missing touches one chunk at most.)

Rows: a null text, or one without words, has no result; a template that stands in a text several times
gives one row with the number of windows; of equal rows each gives its own; a null id stays null; columns other than id and text are
not looked at; very long texts are scanned whole; an empty table gives an empty result.

Plan: one scan, no shuffle of texts. Each pair is hashed once a band. Windows are tested against the bands' values inside the
projection, and only the words around a hit are carried further, to a broadcast table of the templates. A list of more than
VALUES values a band is refused: it is to be scanned in parts.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._shared import documents, text_or_empty

WINDOW, STEP, CHUNK, BANDS, SHINGLE, LEAST = 8, 4, 5, 14, 5, 0.8
#: Values that a band may have: 220 KB of a plan for 14 bands.
VALUES = 2000
#: Slots of a filter of all values.
SLOTS = 1 << 16

# Notices by which licenses are commonly stated, and whole texts of short licenses.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0",),
    "mit": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0",),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-4.0": ("Creative Commons Attribution 4.0 International License",),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3", "either version 3 of the License, or (at your option) any later version"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
        of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
        SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
        OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
        IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    "isc": ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
        OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",),
    "zlib": ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
        of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
        If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be
        plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",),
    "unlicense": ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
        this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where functions of array elements use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def pairs(w: Column) -> Column:
    """Hashes of neighbouring words."""
    return F.when(F.size(w) < 2, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i))))


def shingles(w: Column, n: int = SHINGLE) -> Column:
    """Hashes of n words in a row; no fewer."""
    some = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(*[F.get(w, i - 1 + k) for k in range(n)]))
    return F.when(F.size(w) < n, F.array().cast("array<bigint>")).otherwise(F.array_distinct(some))


def banded(hashes: Column, band: int) -> Column:
    """The hashes by the band's own hash function, independent of the other bands'."""
    return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band)))


def compiled(spark: SparkSession, templates: dict = TEMPLATES, bands: int = BANDS) -> tuple[list[tuple], list[dict[int, set[tuple]]], int]:
    """(name, shingles) of each template, for each band (template, chunk) by value, and the most words of a template."""
    rows = [(name, notice) for name, notices in templates.items() for notice in notices]
    df = spark.createDataFrame(rows, "name string, notice string").withColumn("w", words(F.col("notice")))
    found = df.select("name", "w", F.array(*[banded(pairs(F.col("w")), band) for band in range(bands)]).alias("p"), pairs(F.col("w")).alias("plain"), shingles(F.col("w")).alias("s")).collect()
    short = [r["name"] for r in found if len(r["w"]) <= WINDOW // 2]
    if short:
        raise ValueError(f"templates of fewer than {WINDOW // 2 + 1} words: {short}")
    values: list[dict[int, set[tuple]]] = [{} for _ in range(bands)]
    for k, r in enumerate(found):
        for of, p in zip(values, r["p"]):
            for start in sorted({*range(0, max(1, len(p) - CHUNK + 1), CHUNK), max(0, len(p) - CHUNK)}):
                of.setdefault(min(p[start : start + CHUNK]), set()).add((k, tuple(r["plain"][start : start + CHUNK])))
    if max(map(len, values)) > VALUES:
        raise ValueError(f"more than {VALUES} values a band; scan for fewer templates at once")
    return [(r["name"], r["s"]) for r in found], values, max(len(r["w"]) for r in found)


def scan(docs: DataFrame, text: str = "text", id: str = "doc_id", templates: dict = TEMPLATES, least: float = LEAST, bands: int = BANDS) -> DataFrame:
    """doc_id, license, containment, n_windows: a row for each license that a document states."""
    spark = docs.sparkSession
    known, values, longest = compiled(spark, templates, bands)

    def slots(numbers):
        """Whether a number may be one of these, by a table of its rest; a list would be searched one by one."""
        marks = bytearray(SLOTS)
        for n in numbers:
            marks[n % SLOTS] = 1
        held = F.lit(marks)
        return lambda v: F.substring(held, F.pmod(v, F.lit(SLOTS)).cast("int") + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))

    own = slots(n for of in values for chunks in of.values() for _, chunk in chunks for n in chunk)
    may = slots(n for of in values for n in of)

    def starts(p):
        """Windows that hold a template's pair. The least pair of another window is no template's in any band."""
        all_ = F.when(F.size(p) > 0, F.sequence(F.lit(1), F.size(p), F.lit(STEP)))
        return let(F.transform(p, own), lambda marks: F.filter(all_, lambda at: F.array_contains(F.slice(marks, at, WINDOW), True)))

    def met_in(window, at, band):
        return let(F.array_min(banded(window, band)), lambda v: F.when(may(v) & v.isin(list(values[band])), F.struct(at.alias("at"), F.lit(band).alias("band"), v.alias("value"), window.alias("window"))))

    def met(p):
        """(at, band, value, window) of what the windows meet."""
        bands_of = lambda window, at: F.filter(F.array(*[met_in(window, at, band) for band in range(bands)]), lambda x: x.isNotNull())
        return F.flatten(F.transform(starts(p), lambda at: let(F.slice(p, at, WINDOW), lambda window: bands_of(window, at))))

    around = lambda w, at: F.slice(w, F.greatest(F.lit(1), at - longest), 2 * longest + WINDOW + 1)
    hit = lambda w, x: F.struct(*[x[c].alias(c) for c in ("at", "band", "value", "window")], around(w, x["at"]).alias("words"))
    near = let(words(text_or_empty(text)), lambda w: F.transform(let(pairs(w), met), lambda x: hit(w, x)))
    # a row's number is set before its hits become rows of their own
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), near.alias("near"))
    hits = rows.select("doc_id", "row", F.explode_outer("near").alias("x")).filter(F.col("x").isNotNull()).select("doc_id", "row", "x.*")
    named = [(band, value, k, list(chunk)) for band, of in enumerate(values) for value, ks in sorted(of.items()) for k, chunk in sorted(ks)]
    table = spark.createDataFrame(named, "band int, value long, k int, chunk array<long>").join(spark.createDataFrame([(k, *r) for k, r in enumerate(known)], "k int, license string, s array<long>"), "k")
    found = hits.join(F.broadcast(table), ["band", "value"])
    share = let(F.col("words"), lambda w: F.size(F.array_intersect(F.col("s"), shingles(w)))) / F.size("s")
    whole = F.size(F.array_except("chunk", "window")) == 0
    found = found.select("doc_id", "row", "at", "license", F.when(whole, share).alias("containment")).filter(F.col("containment") >= least)
    return found.groupBy("row", "doc_id", "license").agg(F.max("containment").alias("containment"), F.countDistinct("at").alias("n_windows")).drop("row")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
