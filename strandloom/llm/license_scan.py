"""License scans by canonical digests, in DataFrame operations only.

A text's canonical form has A-Z lower-cased, copyright lines dropped, equivalent spellings made one, and every run of
ASCII punctuation and white space made one space. Whole texts, and each of their lines, are joined by the form's SHA-256
with a table of known license texts and notices. A whole license inside a longer text is found by its first words, from
which on as many characters as it has are looked up by their digest. The form is made once: its lines are kept apart by
their ends until they have been cut out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strandloom.session import materialize

# Spellings that license-matching guidelines treat as equal.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"), ("merchantable", "merchantability"), ("per cent", "percent"), ("whilst", "while"), ("https:", "http:"),
)
FANCY, PLAIN = "‘’“”–— ", "''\"\"-- "
# a wrapped license may have a line that begins with "copyright holder": a copyright line has a sign, a year or an owner behind the word
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t,:]*(\(c\)|\x{a9}|by[ \t]|[0-9]{4}|\[yyyy\]|<year>)|\(c\)[ \t]*(copyright|by[ \t]|[0-9]{4})|\x{a9})[^\n]*"
BETWEEN_WORDS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
WITHIN_LINES = r"[\x00-\x09\x0b-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"

# Parts of the BSD licenses.
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Known texts, by license. Notices are one line; long licenses are in LONG by their digests, more may be added by the caller.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Proprietary", "All rights reserved."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_TWO + _BSD_END),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_TWO + _BSD_NAMES + _BSD_END),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and "
        "all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)


# Long licenses as published: name, the first words of the canonical form, its characters, its digest.
LONG = (
    ("Apache-2.0", "apache license version 2 0 january 2004 http www apache org ", 9882, "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("GPL-1.0", "gnu general public license version 1 february 1989 51 frankl", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "gnu general public license version 2 june 1991 51 franklin s", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007 everyone i", 33406, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "gnu library general public license version 2 june 1991 51 fr", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "gnu lesser general public license version 2 1 february 1999 ", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007 eve", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "mozilla public license version 1 1 1 definitions 1 0 1 comme", 22470, "2360480671121a8c63e9bb07294269d3dbd0ca318a7882fc28c54c106dbee3d5"),
    ("MPL-2.0", "mozilla public license version 2 0 1 definitions 1 1 contrib", 14344, "3599de37bcef5820a1933fc9b0c5b5389b95fa5dc39cb6e05f4764ef1c2f2439"),
    ("CC0-1.0", "creative commons legal code cc0 1 0 universal creative commo", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "gnu free documentation license version 1 2 november 2002 51 ", 19578, "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "gnu free documentation license version 1 3 3 november 2008 h", 22013, "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
)
HEAD = 60


def _form(text: Column, between: str) -> Column:
    lowered = F.translate(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), FANCY, PLAIN)
    form = F.regexp_replace(lowered, COPYRIGHT_LINE, "$1")
    for spelling, usual in SPELLINGS:
        form = F.replace(form, F.lit(spelling), F.lit(usual))
    return F.btrim(F.regexp_replace(form, between, " "))


def canonical(text: Column) -> Column:
    return _form(text, BETWEEN_WORDS)


def _sha(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def digest(text: Column) -> Column:
    return _sha(canonical(text))


def known_licenses(spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN, long: tuple = LONG) -> DataFrame:
    """(digest, license, head, chars), one license to a digest; head and chars are null for notices of one line."""
    rows = spark.createDataFrame(list(texts), "license string, text string").withColumn("form", canonical(F.col("text")))
    whole = F.col("text").contains("\n")
    rows = rows.select(_sha(F.col("form")).alias("digest"), "license", F.when(whole, F.left("form", F.lit(HEAD))).alias("head"), F.when(whole, F.length("form")).alias("chars"))
    rows = rows.unionByName(spark.createDataFrame([(d, n, h, c) for n, h, c, d in long], "digest string, license string, head string, chars int"))
    return rows.groupBy("digest").agg(F.min_by(F.struct("license", "head", "chars"), "license").alias("k")).select("digest", "k.*")


def _inside(form: Column, licenses: list[Row]) -> Column:
    """Names of the licenses whose whole canonical form is within ``form``."""

    def held(row: Row) -> Column:
        parts = F.split(form, row["head"], -1)
        # each part brings the head's characters too, so that a license has a bounded number of them
        behind = lambda k: F.array_join(F.slice(parts, k + 1, row["chars"] // len(row["head"]) + 2), row["head"])
        here = lambda k: _sha(F.concat(F.lit(row["head"]), F.left(behind(k), F.lit(row["chars"] - len(row["head"]))))) == row["digest"]
        found = F.instr(form, row["head"]) > 0
        return F.when(found & F.exists(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), here), F.lit(row["license"]))

    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*map(held, licenses))))), ",") if licenses else F.lit("")


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_digest, license (of the whole text), contained (licenses wholly within it, sorted),
    line_licenses (sorted), n_license_lines.

    ``known`` is as ``known_licenses`` makes it, a row per digest; it goes to every task. Defined results: null and empty
    texts have the digest of the empty form and no license; rows that repeat an id are reported each, with their own lines;
    an empty table gives no rows; other columns are not read.
    """
    known = known.where(F.col("digest") != F.sha2(F.lit(""), 256))
    licenses = known.where("head IS NOT NULL").orderBy("license", "digest").collect()  # a row per license of the table
    names = known.select("digest", "license")
    # texts are read and put into form once, line by line; only digests travel
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), _form(F.coalesce(F.col(text_col), F.lit("")), WITHIN_LINES).alias("__form"))
    lines = F.filter(F.transform(F.split("__form", "\n", -1), lambda x: F.btrim(x)), lambda x: x != "")
    rows = rows.withColumn("__lines", lines).withColumn("__whole", F.array_join("__lines", " "))
    rows = materialize(rows.select("rid", "doc_id", _sha(F.col("__whole")).alias("text_digest"), _inside(F.col("__whole"), licenses).alias("contained"), F.transform("__lines", lambda x: _sha(x)).alias("line_digests")), "license-digests")
    found = rows.select("rid", F.explode("line_digests").alias("digest")).join(names, "digest").groupBy("rid").agg(F.array_sort(F.collect_set("license")).alias("line_licenses"), F.count(F.lit(1)).alias("n_license_lines"))
    whole = rows.select("rid", "doc_id", "text_digest", "contained")
    whole = whole.join(names.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    return whole.join(found, "rid", "left").select(
        "doc_id", "text_digest", "license", "contained", F.coalesce(F.array_join("line_licenses", ","), F.lit("")).alias("line_licenses"), F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines")
    )


def oracle(texts: tuple[tuple[str, str], ...] = KNOWN, long: tuple = LONG) -> str:
    """DuckDB SQL of ``scan_licenses`` over documents."""

    def form(text: str) -> str:
        fancy = " || ".join(f"chr({ord(c)})" for c in FANCY)
        out = f"translate(translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), {fancy}, '{PLAIN.replace(chr(39), chr(39) * 2)}')"
        out = f"regexp_replace({out}, '{COPYRIGHT_LINE}', '\\1', 'g')"
        for spelling, usual in SPELLINGS:
            out = f"replace({out}, '{spelling}', '{usual}')"
        return f"trim(regexp_replace({out}, '{BETWEEN_WORDS}', ' ', 'g'), ' ')"

    values = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for row in texts)
    more = ", ".join(f"('{d}', '{n}', '{h}', {c})" for n, h, c, d in long)
    return f"""
        WITH forms AS (SELECT l, t, {form("t")} AS f FROM (VALUES {values}) AS k(l, t)),
        known AS (SELECT sha256(f) AS digest, min(l) AS license, CASE WHEN contains(min(t), chr(10)) THEN left(min(f), {HEAD}) END AS head, CASE WHEN contains(min(t), chr(10)) THEN length(min(f)) END AS chars FROM forms GROUP BY 1
                  UNION ALL SELECT * FROM (VALUES {more}) AS m(digest, license, head, chars)),
        docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body, {form("coalesce(text, '')")} AS f FROM documents),
        held AS (SELECT rid, array_to_string(list_sort(list(DISTINCT license)), ',') AS contained FROM docs JOIN known ON head IS NOT NULL AND contains(f, head)
                 WHERE len(list_filter(range(1, len(string_split(f, head))), lambda k: sha256(head || substr(f, CAST(list_sum(list_transform(string_split(f, head)[1:k], lambda p: length(p))) AS BIGINT) + k * {HEAD} + 1, CAST(chars - {HEAD} AS BIGINT))) = digest)) > 0 GROUP BY rid),
        lines AS (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM docs),
        found AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n
                  FROM lines JOIN known ON sha256({form("line")}) = digest GROUP BY rid)
        SELECT doc_id, sha256(f) AS text_digest, license, coalesce(contained, '') AS contained, coalesce(line_licenses, '') AS line_licenses, coalesce(n, 0) AS n_license_lines
        FROM docs LEFT JOIN known ON sha256(f) = digest LEFT JOIN held USING (rid) LEFT JOIN found USING (rid)"""
