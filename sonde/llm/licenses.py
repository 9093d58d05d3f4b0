"""Licence scans: whole texts and their lines against digests of known licences.

A text is brought to a canonical form: lines that claim a copyright go, A-Z are
lower-cased, everything but letters and digits becomes one space, and equivalent
spellings become one. The digest of the form of a whole text is hash-joined to the
digests of known licence texts; the digests of its lines to those of known notices.
Known texts and notices are a list the caller gives, so that side is as small as
the list; texts are never compared with each other.

Null, empty and blank texts have the digest of the empty form and no licence; equal
texts get equal results; a text that several names share goes to the first name; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Equivalent spellings, whole words in canonical form -> common spelling.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("sub licence", "sublicense"), ("sublicence", "sublicense"), ("non commercial", "noncommercial"), ("organisation", "organization"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("whilst", "while"),
    ("wilful", "willful"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
)

# Licence texts as published, without their copyright lines.
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
}

_ADVERT = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE"""
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE", _ADVERT, 1)
# the long ones, a file each
TEXTS |= {file.name.removesuffix(".txt"): file.read_text(encoding="utf-8") for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

# One-line notices.
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
}

COPYRIGHT = r"(?m)^[\t */#;-]*(copyright|\(c\)|©)[\t :]*(\(c\)|©)?[\t :]*([0-9]{4}|<|\[)[^\n]*$|^[\t */#;-]*all rights reserved[\t .]*$"
OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form: words separated by one space, a space at either end."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    form = F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(lowered, COPYRIGHT, ""), F.lit(" ")), OTHER, " ")
    for spelling, common in SPELLINGS:
        form = F.replace(form, F.lit(f" {spelling} "), F.lit(f" {common} "))
    return form


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark, entries) -> DataFrame:
    """digest, license of (name, text) pairs; the first name of a digest counts."""
    rows = spark.createDataFrame(list(entries), "license string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scanned(docs: DataFrame, texts: dict = TEXTS, notices: dict = NOTICES) -> DataFrame:
    """doc_id, digest, license (of the whole text), notices (licences named by its lines, sorted) per row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    whole = known(spark, texts.items())
    lines = known(spark, [(name, line) for name, found in notices.items() for line in found])
    # both lists are the caller's: their size does not depend on the documents
    rows = docs.select("doc_id", "text", digest(F.col("text")).alias("digest")).join(F.broadcast(whole), "digest", "left")
    held = lines.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("held")).first()["held"]
    names = F.create_map(*[F.lit(x) for pair in sorted(held.items()) for x in pair]) if held else F.lit(None).cast("map<string,string>")
    first = F.split(F.coalesce("text", F.lit("")), "\n")
    found = F.array_compact(F.transform(first, lambda line: F.try_element_at(names, digest(line))))
    return rows.select("doc_id", "digest", "license", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notices"))


def op10_license_scan(spark, sf_dir):
    return scanned(table(spark, sf_dir, "documents"))


def _sql_form(text: str) -> str:
    form = f"regexp_replace(' ' || regexp_replace(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{COPYRIGHT}', '', 'g') || ' ', '{OTHER}', ' ', 'g')"
    for spelling, common in SPELLINGS:
        form = f"replace({form}, ' {spelling} ', ' {common} ')"
    return f"sha256({form})"


def _sql_rows(entries) -> str:
    return ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in entries)


SQL = f"""
WITH texts(license, text) AS (VALUES {_sql_rows(TEXTS.items())}),
notices(license, text) AS (VALUES {_sql_rows((n, line) for n, found in NOTICES.items() for line in found)}),
whole AS (SELECT {_sql_form("text")} AS digest, min(license) AS license FROM texts GROUP BY 1),
single AS (SELECT {_sql_form("text")} AS digest, min(license) AS license FROM notices GROUP BY 1),
docs AS (SELECT doc_id, {_sql_form("text")} AS digest, text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM docs),
named AS (
  SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices
  FROM (SELECT DISTINCT doc_id, license FROM lines JOIN single ON single.digest = {_sql_form("line")}) GROUP BY doc_id)
SELECT d.doc_id, d.digest, w.license, coalesce(n.notices, '') AS notices
FROM docs d LEFT JOIN whole w ON w.digest = d.digest LEFT JOIN named n ON n.doc_id = d.doc_id
"""
QUERIES, CHECKS = {"op10_license_scan": op10_license_scan}, {"op10_license_scan": SQL}
