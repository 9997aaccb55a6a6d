"""License scans, in DataFrame operations only.

Texts become lower-case words; overlapping windows of words are compared with license templates. A window's MinHash values
form BANDS bands of one row; a template is retrieved when one band agrees, and verified by exact containment: the share of
the template's SHINGLE-word shingles that the window has, CONTAINED or more.

Templates are grouped by size, from 2^m to 2^(m+1) shingles. Such a group's windows hold 2^(m+1) + stride shingles and begin
every 2^(m-1) (at least 1), so some window holds all of any occurrence, and its Jaccard similarity with a template contained
to 0.8 is at least 0.8 / 2.7 = 0.29. One of 32 bands then agrees with probability 1 - 0.71^32 > 0.9999.
Only windows that hold a shingle with a template's band value are made, as no other can agree.

A template that mostly stands in another license's template as well (GPL notices differ in a version) must also have
CONTAINED of the shingles that tell it from that one; a text from which they can't be told apart has neither.

One sieve comes first and loses nothing: a text without any of the anchor words can't hold CONTAINED of a template. Long
texts are cut into segments that overlap by the largest window.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

SHINGLE, CONTAINED, BANDS, SEGMENT = 5, 0.8, 32, 1024
#: Anchor words have so many letters: shorter ones are in most texts.
RARE = 6
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"
#: Public license texts, and for long licenses the notices that refer to them.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program {_WARRANTY} General Public License for more details."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program {_WARRANTY} General Public License for more details."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", f"This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library {_WARRANTY} Lesser General Public License for more details."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library {_WARRANTY} Lesser General Public License for more details."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program {_WARRANTY} Affero General Public License for more details."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", f"{_BSD} {_AS_IS}"],
    "ISC": ['Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": ["Licensed under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def shingles_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))


def templates(texts: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """(license, shingles) of every template of SHINGLE words or more."""
    found = [(name, shingles_of(words_of(t))) for name, all_ in texts.items() for t in all_]
    return [(name, s) for name, s in found if s]


def apart(known: list[tuple[str, list[str]]]) -> list[list[list[str]]]:
    """For each template, and each template of another license that has CONTAINED of it: the shingles that only the first has."""
    return [[[x for x in own if x not in set(other)] for license_, other in known if license_ != name and len(set(own) & set(other)) >= CONTAINED * len(own)] for name, own in known]


def anchors(known: list[tuple[str, list[str]]]) -> list[str]:
    """Words of which every text that holds CONTAINED of a template has one: shingles without any are fewer than that."""
    chosen: list[str] = []
    while True:
        weak = [s for _, all_ in known if len(s := [x for x in all_ if not set(x.split()) & set(chosen)]) >= CONTAINED * len(all_)]
        if not weak:
            return chosen
        chosen.append(max(sorted((c := Counter(w for s in weak for x in s for w in set(x.split()) if len(w) >= RARE)).items()), key=lambda x: (x[1] * len(x[0]), x[0]))[0])


def window_size(n: int) -> tuple[int, int]:
    """(shingles, stride) of the windows for templates of n shingles."""
    group = n.bit_length() - 1
    stride = max(1, 2**group // 2)
    return 2 ** (group + 1) + stride, stride


def _least(shingles: Column) -> Column:
    """The least value of each band over an array of shingles' hashes."""
    return F.array(*(F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(band)))) for band in range(BANDS)))


def _template_rows(spark: SparkSession, known: list[tuple[str, list[str]]]) -> DataFrame:
    """A row per template: also its band values (least) and the hashes of the shingles that have them (holders)."""
    made = [(i, name, s, others, *window_size(len(s))) for i, ((name, s), others) in enumerate(zip(known, apart(known), strict=True))]
    rows = spark.createDataFrame(made, "template int, license string, own array<string>, others array<array<string>>, size int, stride int")
    rows = rows.withColumn("hashes", F.transform("own", lambda s: F.xxhash64(s)))
    values = [F.transform("hashes", lambda s: F.xxhash64(s, F.lit(band))) for band in range(BANDS)]  # noqa: B023
    holders = F.array_distinct(F.array(*(F.get("hashes", (F.array_position(v, F.array_min(v)) - 1).cast("int")) for v in values)))
    return rows.select("*", _least(F.col("hashes")).alias("least"), holders.alias("holders")).drop("hashes")


def candidates(segments: DataFrame, known_rows: DataFrame) -> DataFrame:
    """row, segment, size, begin of the windows that can agree with a template in a band, from segments (row, segment, shingles).

    A window's band value is a template's only if the window holds the shingle that has this value in the template. So windows
    around such shingles are made, and no others.
    """
    held = known_rows.select("size", "stride", F.explode("holders").alias("hash")).distinct()
    at = segments.select("row", "segment", F.posexplode(F.transform("shingles", lambda s: F.xxhash64(s))).alias("at", "hash")).join(F.broadcast(held), "hash")
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("size") + 1) / F.col("stride")).cast("int") * F.col("stride"))
    last = F.least(F.col("at"), F.lit(SEGMENT - 1))
    return at.select("row", "segment", "size", F.explode(F.when(first <= last, F.sequence(first, last, F.col("stride")))).alias("begin")).distinct()


def scan(docs: DataFrame, texts: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Per row of docs (doc_id, text): licenses (names, sorted, comma-joined), n_licenses, best (containment of each, joined likewise).

    Null and empty texts have none. Repeated rows are rows of their own. An empty table gives no rows.
    """
    spark, known = docs.sparkSession, templates(texts)
    folder = common.scratch(spark, "licenses")
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    maybe = F.lit(False)
    for w in anchors(known):
        maybe = maybe | low.contains(w)
    none = F.array().cast("array<string>")
    split = F.when(maybe, F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")).otherwise(none)
    reach = SEGMENT + max(window_size(len(s))[0] for _, s in known) + SHINGLE - 1
    last = F.floor((F.size("words") - SHINGLE) / SEGMENT).cast("int")
    parts = F.when(F.size("words") >= SHINGLE, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice("words", i * SEGMENT + 1, F.lit(reach)))).otherwise(F.array().cast("array<array<string>>"))
    kept = common.written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", split.alias("words")).select("row", "doc_id", parts.alias("parts")), f"{folder}/words")

    segments = kept.select("row", F.posexplode("parts").alias("segment", "words"))
    shingled = F.transform(F.sequence(F.lit(1), F.size("words") - SHINGLE + 1), lambda i: F.array_join(F.slice("words", i, SHINGLE), " "))
    segments = common.written(segments.where(F.size("words") >= SHINGLE).select("row", "segment", shingled.alias("shingles")), f"{folder}/segments")
    known_rows = _template_rows(spark, known)  # a fixed list
    windows = common.written(candidates(segments, known_rows), f"{folder}/windows")
    has = F.slice("shingles", F.col("begin") + 1, F.col("size"))
    valued = windows.join(segments, ["row", "segment"]).select("row", "size", has.alias("has"), _least(F.transform(has, lambda s: F.xxhash64(s))).alias("least"))
    facts = known_rows.select("template", "license", "own", "others", "size", F.col("least").alias("known"))
    agrees = F.exists(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda band: F.get("least", band) == F.get("known", band))
    checked = valued.join(F.broadcast(facts), "size").where(agrees)
    share = lambda part: F.size(F.array_intersect("has", part)) / F.size(part)
    told = F.forall("others", lambda part: share(part) >= CONTAINED)
    best = checked.withColumn("share", share(F.col("own"))).where((F.col("share") >= CONTAINED) & told).groupBy("row", "license").agg(F.max("share").alias("share"))
    found = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("license", "share"))).alias("found"))
    return kept.select("row", "doc_id").join(found, "row", "left").select(
        "doc_id",
        F.coalesce(F.array_join(F.transform("found", lambda x: x["license"]), ","), F.lit("")).alias("licenses"),
        F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join(F.transform("found", lambda x: F.format_number(x["share"], 3)), ","), F.lit("")).alias("best"),
    )
