"""License scan: canonical digests of whole texts and of their lines, hash-joined to known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.joins import small

#: Beyond so many known texts the digest table is not broadcast but joined by a shuffle.
MAX_BROADCAST_TEXTS = 100_000

#: Licence texts and notices, by name.
_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_REST = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_NO_LIABILITY = (
    "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, "
    "OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_REST = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE " + _NO_LIABILITY
)
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_REST),
    ("0BSD", _ISC + ". " + _ISC_REST),
    ("BSD-2-Clause", _BSD + _BSD_REST),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
     "derived from this software without specific prior written permission. " + _BSD_REST),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
     "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
     "to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
     "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
     "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
     "software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization "
     'obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, '
     "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished "
     "to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this "
     "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the "
     "Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
     'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
     "FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE "
     "FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
     "OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
     "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In "
     "jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
     "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
     "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
     'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
     "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
     "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
     "For more information, please refer to <https://unlicense.org>"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
     "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
     '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
     "specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)

#: Spellings that count as equal.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"),
    ("analyse", "analyze"), ("modelling", "modeling"), ("fulfil", "fulfill"), ("acknowledgement", "acknowledgment"),
    ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("whilst", "while"), ("percent", "per cent"), ("sub license", "sublicense"),
)


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, only letters and digits with single blanks, one spelling each."""
    c = F.lower(F.coalesce(text, F.lit("")))
    marked = F.contains(c, F.lit("copyright")) | F.contains(c, F.lit("(c)")) | F.contains(c, F.lit("©"))
    c = F.when(marked, F.regexp_replace(c, r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$", " ")).otherwise(c)
    c = F.trim(F.regexp_replace(c, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for other, one in SPELLINGS:
        c = F.replace(c, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(c)


def known_digests(spark, known=KNOWN) -> DataFrame:
    """``license``, ``chars`` and ``digest`` of the canonical known texts; one licence per digest.

    ``known`` is pairs of name and whole text, or a table of them with the columns ``license`` and ``text``.
    """
    if not isinstance(known, DataFrame):
        known = spark.createDataFrame(list(known), "license string, text string")
    texts = known.where("license is not null and text is not null").select("license", canonical(F.col("text")).alias("c")).where("c <> ''")
    rows = texts.select("license", F.char_length("c").alias("chars"), F.sha2("c", 256).alias("digest"))
    return rows.groupBy("digest", "chars").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known=KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``digest`` of the whole canonical text, its ``license`` or null,
    ``n_lines`` whose whole canonical text is known, and ``line_licenses`` (distinct names, sorted).

    Lines are looked up besides the whole text, since notices stand in longer documents.  Only a text
    as long as some known text can have its digest, so the others are not hashed for the lookup.  A line
    that is nothing but a copyright notice becomes empty and is no licence.  Null and empty texts have
    the digest of the empty text and no licence; repeated rows each keep a row.
    """
    digests = small(known_digests(docs.sparkSession, known), MAX_BROADCAST_TEXTS)
    row = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw")).withColumn("row", F.monotonically_increasing_id())
    row = row.select("id", "row", canonical(F.col("raw")).alias("whole"), F.split("raw", r"\r?\n").alias("lines"))
    row = row.select("id", "row", F.sha2("whole", 256).alias("digest"), F.char_length("whole").alias("whole_chars"), "lines")
    unit = row.select("id", "row", F.col("digest").alias("whole_digest"), F.posexplode(F.concat(F.array(F.lit("")), "lines")).alias("at", "line"), "whole_chars")
    unit = unit.select("id", "row", "at", F.when(F.col("at") == 0, F.col("whole_digest")).alias("whole_digest"), "whole_chars", canonical(F.col("line")).alias("c"))
    unit = unit.select(
        "id", "row", "at", "whole_digest",
        F.when(F.col("at") == 0, F.col("whole_chars")).otherwise(F.char_length("c")).alias("chars"),
        F.when(F.col("at") == 0, F.col("whole_digest")).otherwise(F.sha2("c", 256)).alias("digest"),
    )
    hit = unit.join(digests, ["digest", "chars"], "left").where((F.col("at") == 0) | F.col("license").isNotNull())
    found = hit.groupBy("row").agg(
        F.first("id", ignorenulls=True).alias(id_col),
        F.max("whole_digest").alias("digest"),
        F.max(F.when(F.col("at") == 0, F.col("license"))).alias("license"),
        F.count_if((F.col("at") > 0) & F.col("license").isNotNull()).alias("n_lines"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("at") > 0, F.col("license")))), ",").alias("line_licenses"),
    )
    return found.drop("row")
