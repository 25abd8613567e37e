"""Licence scan by canonical digest lookup, with DataFrame functions only.

A text is brought into a canonical form: copyright statements dropped, lines
joined, lower case, punctuation and white space turned into single spaces,
equivalent spellings made equal, so that the form does not depend on wrapping
or comment signs.  The digests of whole documents, and of their lines taken as
whole texts, are hash-joined to the digests of known licence texts and notices.
The catalogue goes through the same form.  It is a fixed list, to which a table
of further texts may be added; that side of the join is broadcast only if it is
the fixed list.

Defined results: null, empty and punctuation-only texts have no digest and no
licence; rows that repeat get the same result each; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.llm.common import written

# Equivalent spellings, fixed values; whole words of the canonical form.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("sub licence", "sublicense"), ("organisation", "organization"), ("organisations", "organizations"),
    ("favour", "favor"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"), ("per cent", "percent"),
    ("wilful", "willful"), ("fulfil", "fulfill"), ("whilst", "while"), ("v 2 0", "version 2 0"), ("v2 0", "version 2 0"),
    ("v3", "version 3"), ("v2", "version 2"), ("creative commons attribution noncommercial", "cc by nc"),
    ("creative commons attribution sharealike", "cc by sa"), ("creative commons attribution", "cc by"),
]

# Short licence texts, fixed values (their copyright lines are dropped by the canonical form).
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
# Notices that files carry, fixed values.
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0/."""
_GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as
published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.
This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details.
You should have received a copy of the GNU {1}General Public License along with this {0}{3}."""
_END_3 = ". If not, see <{}://www.gnu.org/licenses/>"
_END_2 = """; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"""


def _gnu_notices() -> list[tuple[str, str]]:
    """The usual notices of the family, with the ends of either version."""
    out = []
    for key, family, thing, version in (("GPL-2.0", "", "program", "2"), ("GPL-3.0", "", "program", "3"),
                                        ("LGPL-2.1", "Lesser ", "library", "2.1"), ("LGPL-3.0", "Lesser ", "library", "3"),
                                        ("AGPL-3.0", "Affero ", "program", "3")):
        for end in (_END_3.format("https"), _END_3.format("http"), _END_2):
            out.append((key, _GNU.format(thing, family, version, end)))
    return out


TEXTS = [("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("ISC", _ISC),
         ("ISC", "ISC License\n" + _ISC), ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"),
         ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_THIRD}\n{_BSD_TAIL}"), ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB), ("Apache-2.0", _APACHE),
         ("MPL-2.0", _MPL.format("http")), ("MPL-2.0", _MPL.format("https")), *_gnu_notices()]

# Names that notices use, fixed values.
NAMES = [
    ("MIT", "the MIT License"), ("Apache-2.0", "the Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"),
    ("GPL-2.0", "the GNU General Public License, version 2"), ("GPL-3.0", "the GNU General Public License, version 3"),
    ("GPL-3.0", "GPL-3.0"), ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"), ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("BSD-2-Clause", "the BSD 2-Clause License"), ("BSD-3-Clause", "the BSD 3-Clause License"), ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("Unlicense", "the Unlicense"),
]
PHRASES = ["Licensed under {}.", "Released under {}.", "Distributed under {}.", "Published under {}.",
           "This work is licensed under {}.", "This software is licensed under {}."]


def catalogue() -> list[tuple[str, str]]:
    """(licence id, text): full texts, and every phrase with every name."""
    return TEXTS + [(key, phrase.format(name)) for key, name in NAMES for phrase in PHRASES]


#: Copyright statements, in lower case (fixed pattern): after an optional comment sign, the word with a sign, year or
#: "by" (or a year later in the line), the sign with a year, or the usual reservation alone on its line.
COPYRIGHT = (r"^[\x20\t]*([#*;%!>]+|//+|/[*]+|--+|<!--)?[\x20\t]*("
             r"copyright[\x20\t,:]*([(]c[)]|©|by[\x20\t]|(.*[^0-9a-z])?(19|20)[0-9][0-9])|"
             r"©|[(]c[)][\x20\t]*(copyright|(19|20)[0-9][0-9])|all rights reserved[.]?[\x20\t]*([*]+/|-->)?[\x20\t\r]*$)")


def canonical(text: Column) -> Column:
    """Canonical form of joined lines."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for old, new in SPELLINGS:
        words = F.replace(words, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(words)


def digest(form: Column) -> Column:
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


def units(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``whole`` (digest of the text) and ``lines`` (digests of its lines, null where empty)."""
    kept = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: ~F.lower(x).rlike(COPYRIGHT))
    return (docs.withColumn("kept", kept).withColumn("whole", digest(canonical(F.array_join("kept", " "))))
            .withColumn("lines", F.transform("kept", lambda x: digest(canonical(x)))).drop("kept"))


def known_digests(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """licence, digest of the catalogue and of ``more`` (licence, text)."""
    texts = spark.createDataFrame(catalogue(), "licence string, text string")
    if more is not None:
        texts = texts.unionByName(more.select("licence", "text"))
    return units(texts).select("licence", F.col("whole").alias("digest")).where("digest IS NOT NULL").distinct()


def scan(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """doc_id, digest of the whole text, its licence, licences of its lines, number of such lines.

    A text with the form of several licences gets the least of their names.
    """
    rows = written(units(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))).drop("text"), "licence-units")
    known = known_digests(docs.sparkSession, more)
    if more is None:
        known = F.broadcast(known)
    # a document of one line is that line: it is reported as a whole
    found = (rows.select("row", "whole", F.explode("lines").alias("digest")).where("digest <> whole").join(known, "digest")
             .groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("line_licences"),
                                 F.count(F.lit(1)).alias("n_lines")))
    whole = known.groupBy(F.col("digest").alias("whole")).agg(F.min("licence").alias("licence"))
    if more is None:
        whole = F.broadcast(whole)
    return (rows.drop("lines").join(whole, "whole", "left").join(found, "row", "left")
            .select("doc_id", F.col("whole").alias("digest"), "licence",
                    F.coalesce("line_licences", F.lit("")).alias("line_licences"),
                    F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines")))


def oracle_sql() -> str:
    """The same scan for an SQL engine with list functions."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"
    def form(x: str) -> str:
        out = f"' ' || trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
        for old, new in SPELLINGS:
            out = f"replace({out}, ' {old} ', ' {new} ')"
        return f"trim({out})"
    kept = f"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(lower(x), '{COPYRIGHT}'))"
    values = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in catalogue())
    whole = f"nullif({form("array_to_string(kept, ' ')")}, '')"
    lines = f"list_filter(list_transform(kept, lambda x: {form('x')}), lambda x: x <> '')"
    return f"""
WITH known AS (
  SELECT DISTINCT licence, sha256({whole}) AS digest FROM (SELECT licence, {kept} AS kept FROM (VALUES {values}) AS t(licence, text))),
rows AS (
  SELECT row_number() OVER () AS id, doc_id, {lines} AS c, sha256({whole}) AS digest FROM (SELECT doc_id, {kept} AS kept FROM documents)),
parts AS (SELECT id, digest AS whole, sha256(unnest(c)) AS part FROM rows),
found AS (
  SELECT id, string_agg(DISTINCT k.licence, ',' ORDER BY k.licence) AS line_licences, count(*)::BIGINT AS n_lines
  FROM parts p JOIN known k ON p.part = k.digest WHERE p.part <> p.whole GROUP BY id)
SELECT r.doc_id, r.digest, k.licence, coalesce(f.line_licences, '') AS line_licences, coalesce(f.n_lines, 0) AS n_lines
FROM rows r LEFT JOIN (SELECT digest, min(licence) AS licence FROM known GROUP BY digest) k ON r.digest = k.digest LEFT JOIN found f ON r.id = f.id
"""
