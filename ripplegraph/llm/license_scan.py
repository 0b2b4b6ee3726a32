"""License scans (native: DataFrame functions only).

Texts and templates are cut into five-word shingles and these into overlapping windows; a text's window that shares the
minhash of a band with a template's window retrieves that template.  There are two kinds of windows:

* Templates of LONG shingles and more have windows of LONG * 2 shingles, one at every place.  A text's windows are of that
  size too and start every LONG shingles, so that any run of LONG shingles lies whole in one of them.  A window inside an
  unchanged copy equals one of the template's, which collides for certain.  Of a copy that has lost a quarter of its
  shingles some window has lost no more than that, and a similarity of 1/3 at least even to a template of LONG shingles:
  each of BANDS one-row bands collides with that probability, all fail with (2/3)**BANDS = 6e-5, and longer templates
  have a window more for every LONG shingles.
* Shorter templates, the notices, are of the size of a line.  Their windows hold two shingles, so that every shingle that
  text and notice share lies in two windows of similarity 1/2, or fills its window: it is missed with 4**-NOTICE_BANDS.

Retrieved templates are then verified: the exact share of the template's distinct shingles that occur anywhere in the
text is at least ``least`` (0.75).  A copy that is scattered through a text in single shingles is found if it is a notice;
of a longer template, a run of it must have come through.

Texts without any of ANCHORS skip the windows where that drops no match: if every template has fewer shingles without an
anchor than ``least`` asks for (``unanchored``).  Otherwise all texts have windows.

Defined results: words are runs of a-z and 0-9 after lower-casing A-Z; null and empty texts and texts of under five
words match nothing; repeated rows and null ids are texts of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

WORDS, LONG, BANDS, NOTICE_BANDS = 5, 24, 24, 12

# Wording of common licences, of the headers that they ask for, and of short notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-terms-notice": "Released under the terms of the MIT License.",
    "MIT-licensed-notice": "This project is licensed under the MIT License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Apache-2.0-terms-notice": "Released under the terms of the Apache License 2.0.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-notice": "Licensed under the GNU Lesser General Public License.",
    "AGPL-notice": "Licensed under the GNU Affero General Public License.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-long-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-3.0-or-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
ANCHORS = ("licens", "permission", "warrant", "copyright", "redistribut", "software", "conditions", "mozilla", "released")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " ")), " ")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: a column that a lambda refers to is otherwise computed in each step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shingles(words: Column) -> Column:
    """The five-word shingles in order; none if there are fewer words."""

    def cut(w: Column) -> Column:
        at = F.when(F.size(w) >= WORDS, F.sequence(F.lit(1), F.size(w) - WORDS + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, WORDS), " "))

    return _let(words, cut)


def _masks(bands: int, first: int) -> list[int]:
    """A mask for each band; the least of the hashes under it is the band's minhash."""
    return [int(m) for m in np.random.default_rng(7 + first).integers(-(2**63), 2**63 - 1, bands)]


def _keys(hashes: Column, size: int, step: int, masks: list[int], first: int) -> Column:
    """(band, minhash) of windows of ``size`` hashes that start every ``step``; fewer hashes make one window."""

    def band(number: int):
        def keys(own: Column) -> Column:
            # the last start is the first from which a window reaches the end
            last = F.greatest(F.lit(1), F.ceil((F.size(own) - size) / step).cast("int") * step + 1)
            at = F.when(F.size(own) > 0, F.sequence(F.lit(1), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda i: F.struct(F.lit(first + number).alias("band"), F.array_min(F.slice(own, i, size)).alias("minhash")))

        return keys

    def masked(hashes: Column, mask: int) -> Column:
        return F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(mask).cast("long")))

    return _let(hashes, lambda h: F.flatten(F.array(*[_let(masked(h, m), band(k)) for k, m in enumerate(masks)])))


def _notice_keys(hashes: Column) -> Column:
    return _keys(hashes, 2, 1, _masks(NOTICE_BANDS, BANDS), BANDS)


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, template_shingles (distinct), keys."""
    table = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    table = table.select("license", _shingles(_words(F.col("body"))).alias("shingles"))
    hashes = F.transform("shingles", lambda s: F.xxhash64(s))
    keys = F.when(F.size("shingles") >= LONG, _keys(hashes, 2 * LONG, 1, _masks(BANDS, 0), 0)).otherwise(_notice_keys(hashes))
    return table.select("license", F.array_distinct("shingles").alias("template_shingles"), keys.alias("keys"))


def unanchored(templates: dict[str, str], least: float = 0.75, anchors: tuple[str, ...] = ANCHORS) -> list[str]:
    """The templates of which a text without anchors may hold a share of ``least``, or that have no shingle."""
    bad = []
    for name, body in templates.items():
        words = re.findall("[a-z0-9]+", body.lower())
        own = {tuple(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)}
        free = sum(not any(a in w for w in s for a in anchors) for s in own)
        if free >= least * len(own):
            bad.append(name)
    return bad


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, n_found, n_template, containment: a row for each text and template that it holds."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    known = template_table(spark, templates)  # a row for each template
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if not unanchored(templates, least):
        texts = texts.filter(F.col("text").rlike("(?i)" + "|".join(ANCHORS)))
    texts = texts.select("doc_id", F.monotonically_increasing_id().alias("row"), _words(F.col("text")).alias("words")).filter(F.size("words") >= WORDS)
    # the texts that come through lie unevenly in the files that they come from
    texts = scratch.write(texts.repartition("row"), "texts")

    hashes = F.transform(_shingles(F.col("words")), lambda s: F.xxhash64(s))
    own = _let(hashes, lambda h: F.concat(_keys(h, 2 * LONG, LONG, _masks(BANDS, 0), 0), _notice_keys(h)))
    keyed = texts.select("row", F.explode(own).alias("key"))
    index = known.select("license", F.explode("keys").alias("key")).distinct()
    pairs = keyed.join(F.broadcast(index), "key").select("row", "license").distinct()
    pairs = scratch.write(pairs, "pairs")

    checked = pairs.join(texts, "row").join(F.broadcast(known.select("license", "template_shingles")), "license")
    n_found = F.size(F.array_intersect("template_shingles", _shingles(F.col("words")))).cast("long")
    checked = checked.select("doc_id", "license", n_found.alias("n_found"), F.size("template_shingles").cast("long").alias("n_template"))
    return checked.filter(F.col("n_found") >= least * F.col("n_template")).withColumn("containment", F.col("n_found") / F.col("n_template"))
