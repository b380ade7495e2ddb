"""Operator 8: licence scans by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form (lower case; copyright lines out (a line that opens with a copyright sign or
"copyright" and a sign, year or placeholder, of up to 200 characters more); punctuation and white
space to single spaces; equivalent spellings made one), its SHA-256 is taken, and the digest is joined
to the digests of known licence texts.  The whole document is looked up, and so are, as entire texts of their own, each of its
lines and each paragraph of several lines (blank lines part paragraphs), for the notices that authors put above or under a document.

The table of known texts is the constant ``KNOWN`` (full texts of short licences, and notices and file headers of the long ones) or the
caller's own table; only the constant one is broadcast, and documents are not shuffled but for their matches.  Canonical forms cost
one regular expression a text: the others run only where the text holds a word without which they cannot match.  Lines and
paragraphs of the constant table's texts all hold one of ``NEEDLES``, which no rule makes or takes away, so others are not even brought to
their form.

Defined results: null and blank texts have the digest of the empty text and no licence; repeated rows
give one result row each; a null doc_id is kept; an empty table gives an empty result; very long
texts are canonicalised whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

_BSD_ADVERTISING = (
    "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product "
    "includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be "
    "used to endorse or promote products derived from this software without specific prior written permission. "
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
    "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
    "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
    "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
    "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
    "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
    'software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"
)
_BOOST = (
    "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization "
    "obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
    "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
    "Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including "
    "the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in "
    "part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable "
    'object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_WTFPL = (
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004 Everyone is permitted to copy and distribute verbatim or modified "
    "copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE "
    "TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."
)
_POSTGRESQL = (
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written "
    "agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all "
    "copies."
)
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
    "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
    "implied. See the License for the specific language governing permissions and limitations under the License."
)
_MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
    "file, You can obtain one at {scheme}://mozilla.org/MPL/2.0/."
)
_GNU_HEADER = (
    "{subject} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
    "Software Foundation{either} version {version} of the License, or (at your option) any later version."
)
_GNU_DISCLAIMER = (
    "{subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
    "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)
_GNU = [
    ("GPL-2.0-or-later", "General Public License", "2", ";", "; either"),
    ("GPL-3.0-or-later", "General Public License", "3", ":", ", either"),
    ("LGPL-2.1-or-later", "Lesser General Public License", "2.1", ";", "; either"),
    ("LGPL-3.0-or-later", "Lesser General Public License", "3", ":", ", either"),
    ("AGPL-3.0-or-later", "Affero General Public License", "3", ":", ", either"),
]
#: Identifiers whose one-line SPDX notice is known.
_SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MIT-0", "MPL-2.0", "PostgreSQL", "Unlicense", "WTFPL", "Zlib",
]

#: (SPDX id, entire text).  Fixed values: public licence texts, their usual file headers and one-line notices.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT_GRANT),
    ("MIT", "MIT License " + _MIT_GRANT),
    ("MIT", "The MIT License " + _MIT_GRANT),
    ("MIT", "The MIT License (MIT) " + _MIT_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}"),
    ("ISC", f"ISC License {_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}"),
    ("0BSD", f"{_ISC_GRANT}. {_ISC_DISCLAIMER}"),
    ("0BSD", f"BSD Zero Clause License {_ISC_GRANT}. {_ISC_DISCLAIMER}"),
    ("BSD-2-Clause", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "BSD 3-Clause License " + _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER),
    ("BSD-4-Clause", _BSD_CONDITIONS + _BSD_ADVERTISING + _BSD_DISCLAIMER),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License " + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("WTFPL", _WTFPL),
    ("PostgreSQL", _POSTGRESQL),
    ("Apache-2.0", _APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MPL-2.0", _MPL_HEADER.format(scheme="http")),
    ("MPL-2.0", _MPL_HEADER.format(scheme="https")),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    *((spdx, _GNU_HEADER.format(subject=subject, stop=stop, name=name, either=either, version=version)) for spdx, name, version, stop, either in _GNU for subject in ("This program", "This library")),
    *(
        (spdx, _GNU_HEADER.format(subject=subject, stop=stop, name=name, either=either, version=version) + " " + _GNU_DISCLAIMER.format(subject=subject, name=name))
        for spdx, name, version, stop, either in _GNU for subject in ("This program", "This library")
    ),
    *((spdx, f"SPDX-License-Identifier: {spdx}") for spdx in _SPDX),
]
#: (SPDX id, SHA-256 of the canonical form) of long licences as they are published.  Fixed values.  The GNU texts alone do not say whether later versions are allowed.
KNOWN_WHOLE: list[tuple[str, str]] = [
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
]
#: Each text of ``KNOWN`` holds one of these in its canonical form, and its source in lower case holds the same one.
NEEDLES = ["licen", "permi", "redistribution", "unencumbered"]

#: How a copyright line begins.
_COPYRIGHT = "^[ \t]*(copyright[ \t]*(\\(c\\)|[©0-9<{\\[]|by )|\\(c\\)[ \t]*(copyright|[0-9])|©)"

#: The canonical form: ("pattern", regular expression, replacement, words one of which it needs), ("text", from, to) or ("lines", beginning, first
#: sentence, words one of which it needs), in this order, after lower-casing.  Lines of that beginning go, whatever their length; of those that hold
#: one of ``NEEDLES``, and so may have a licence on them, the first sentence goes.  Both regular-expression dialects (Java's and RE2) read these patterns alike.
RULES: list[tuple] = [
    ("pattern", "\r\n?", "\n", ["\r"]),
    ("lines", _COPYRIGHT, _COPYRIGHT + "[^.]*(\\.[^ \t.][^.]*)*\\.[ \t]+", ["copyright", "(c)", "©"]),
    ("pattern", "(^|\n)[ \t]*all rights reserved[. \t]*", "\n", ["all rights reserved"]),
    ("pattern", "[ \t\n\f\u000b\u00a0!-/:-@\\[-`{-~‘’“”–—•]+", " ", []),
    ("text", "licence", "license"),
    ("text", "sub license", "sublicense"),
    ("text", "organisation", "organization"),
    ("text", "authorisation", "authorization"),
    ("text", "favour", "favor"),
    ("text", "behaviour", "behavior"),
    ("text", "whilst", "while"),
    ("text", "copyright owner", "copyright holder"),
    ("text", "non infringement", "noninfringement"),
]


def holds(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def with_digest(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the SHA-256 of the canonical form of the column ``text``.

    Each step is a projection of its own, so that no earlier step is computed twice for a condition and its branch.
    """
    form = F.col("_form")
    rows = rows.withColumn("_form", F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    for kind, a, b, *words in RULES:
        if kind == "text":
            out = F.replace(form, F.lit(a), F.lit(b))
        elif kind == "lines":
            left = F.transform(F.split(form, "\n"), lambda x: F.when(~x.rlike(a), x).when(holds(x, NEEDLES), F.regexp_replace(x, b, "")).otherwise(F.lit("")))  # noqa: B023
            out = F.when(holds(form, words[0]), F.array_join(left, "\n")).otherwise(form)
        elif words[0]:
            out = F.when(holds(form, words[0]), F.regexp_replace(form, a, b)).otherwise(form)
        else:
            out = F.regexp_replace(form, a, b)
        rows = rows.withColumn("_form", out)
    return rows.withColumn(name, F.sha2(F.trim(form), 256)).drop("_form")


def known_digests(spark: SparkSession) -> DataFrame:
    """(known_digest, license) of the constant table, distinct."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in KNOWN])).alias("row")
    whole = F.explode(F.array(*[F.struct(F.lit(digest).alias("known_digest"), F.lit(name).alias("license")) for name, digest in KNOWN_WHOLE])).alias("row")
    short = with_digest(spark.range(1).select(rows).select("row.*"), "text", "known_digest").select("known_digest", "license").distinct()
    return short.union(spark.range(1).select(whole).select("row.*"))


def entire_parts(text: Column) -> Column:
    """The lines of a text and its paragraphs of several lines, as one array."""
    lines = F.split(text, "\n")
    paragraphs = F.transform(F.split(text, "\n([ \t]*\n)+"), lambda x: F.btrim(x, F.lit("\n")))
    return F.concat(lines, F.filter(paragraphs, lambda x: F.contains(x, F.lit("\n"))))


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per row: doc_id, digest of the canonical whole text, license (null: unknown), and of its lines and paragraphs that are
    known texts the number ``n_notices`` and the ids ``notices`` (sorted, comma-joined, empty: none).

    ``known`` may replace the constant table by any table (known_digest, license), one licence per digest.
    """
    table = F.broadcast(known_digests(docs.sparkSession)) if known is None else known
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit(8), "doc_id", "text").alias("row2"))
    low = rows.select("row", "row2", F.replace(F.lower("text"), F.lit("\r"), F.lit("")).alias("low"))
    likely = low if known is not None else low.where(holds(F.col("low"), NEEDLES))
    parts = likely.select("row", "row2", F.posexplode(entire_parts(F.col("low"))).alias("at", "part")).where(F.length(F.trim("part")) > 0)
    if known is None:
        parts = parts.where(holds(F.col("part"), NEEDLES))
    found = with_digest(parts, "part", "part_digest").join(table, F.col("part_digest") == F.col("known_digest"))
    notices = (
        found.select("row", "row2", "at", "license").distinct().groupBy("row", "row2")
        .agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
        .select(F.col("row").alias("of_row"), F.col("row2").alias("of_row2"), "n_notices", "notices")
    )
    whole = with_digest(rows, "text", "digest").select("doc_id", "row", "row2", "digest")
    joined = whole.join(table, F.col("digest") == F.col("known_digest"), "left")
    joined = joined.join(notices, (F.col("row") == F.col("of_row")) & (F.col("row2") == F.col("of_row2")), "left")
    return joined.select("doc_id", "digest", "license", F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for kind, a, b, *_ in RULES:
        if kind == "lines":
            needed = " OR ".join(f"contains(x, {_quoted(word)})" for word in NEEDLES)
            kept = f"CASE WHEN NOT regexp_matches(x, {_quoted(a)}) THEN x WHEN {needed} THEN regexp_replace(x, {_quoted(b)}, '') ELSE '' END"
            out = f"array_to_string(list_transform(string_split({out}, chr(10)), lambda x: {kept}), chr(10))"
            continue
        out = f"regexp_replace({out}, {_quoted(a)}, {_quoted(b)}, 'g')" if kind == "pattern" else f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    return f"trim({out}, ' ')"


def license_scan_sql() -> str:
    """DuckDB SQL for ``license_scan(documents)``."""
    values = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in KNOWN)
    whole = ", ".join(f"({_quoted(name)}, {_quoted(digest)})" for name, digest in KNOWN_WHOLE)
    return f"""
WITH known AS (SELECT DISTINCT sha256({canonical_sql("text")}) AS known_digest, license FROM (VALUES {values}) AS k(license, text)
  UNION ALL SELECT known_digest, license FROM (VALUES {whole}) AS w(license, known_digest)),
docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, replace(coalesce(text, ''), chr(13), '') AS plain FROM documents),
parts AS (
  SELECT row, unnest(string_split(plain, chr(10))) AS part FROM docs UNION ALL
  SELECT row, part FROM (SELECT row, trim(unnest(string_split_regex(plain, '\n([ \t]*\n)+')), chr(10)) AS part FROM docs) WHERE contains(part, chr(10))),
notices AS (
  SELECT row, count(*) AS n_notices, array_to_string(list_sort(list_distinct(list(license))), ',') AS notices
  FROM parts JOIN known ON sha256({canonical_sql("part")}) = known_digest WHERE trim(part) <> '' GROUP BY row)
SELECT doc_id, sha256({canonical_sql("text")}) AS digest, license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM docs LEFT JOIN known ON sha256({canonical_sql("text")}) = known_digest LEFT JOIN notices USING (row)"""
