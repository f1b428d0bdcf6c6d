"""License scans (operator 6): canonical digests of whole texts and of their lines, looked up among known ones.

Built-in expressions only: case, punctuation, copyright lines and equivalent spellings are normalised, the
result is digested, and digests are joined with those of known licences and notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import Scratch

#: Spellings that count as equal, applied in this order.
SPELLINGS = (("licence", "license"), ("licencing", "licensing"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("organisation", "organization"), ("favour", "favor"), ("non commercial", "noncommercial"), ("whilst", "while"))
#: Known texts and digests at most; their table is broadcast.
MOST = 10_000

_PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>"
#: Known texts by identifier: whole licences and short notices. Copyright lines don't matter.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License " + _MIT),
    ("MIT", "The MIT License (MIT) " + _MIT),
    ("ISC", f"{_PERMISSION}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"),
    ("ISC", f"ISC License {_PERMISSION}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"),
    ("0BSD", f"{_PERMISSION}. {_ISC_END}"),
    ("0BSD", f"BSD Zero Clause License {_PERMISSION}. {_ISC_END}"),
    *(("BSD-2-Clause", f"{head}{_BSD_2} {_BSD_END}") for head in ("", "All rights reserved. ", "BSD 2-Clause License ", "BSD 2-Clause License All rights reserved. ")),
    *(("BSD-3-Clause", f"{head}{_BSD_3} {_BSD_END}") for head in ("", "All rights reserved. ", "BSD 3-Clause License ", "BSD 3-Clause License All rights reserved. ")),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE.replace("http://", "https://")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
)
#: Digests of long licences' canonical forms, as their stewards publish these texts.
DIGESTS = (
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that begins as a copyright notice and has its sign or a year; a line of running text that begins with that word has neither.
_COPYRIGHT = r"(^|\n)[ \t*#/;-]*(copyright[ \t]*(\(c\)|©)|©|(copyright|\(c\))[^\n]*\b(19|20)[0-9][0-9]\b)[^\n]*"
_MARKS = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The text in canonical form, line ends kept; words of a line are parted by one space."""
    out = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    out = F.regexp_replace(out, _COPYRIGHT, "\n")
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), _MARKS, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def joined(lines: Column) -> Column:
    """Canonical lines as one; a spelling of two words may stand across a line end."""
    out = F.trim(F.regexp_replace(lines, r"[ \n]+", " "))
    for a, b in SPELLINGS:
        if " " in a:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical(text: Column) -> Column:
    """The whole text in canonical form, on one line."""
    return joined(canonical_lines(text))


def find_licenses(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = DIGESTS, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text_digest, license_id, line_licenses, n_license_lines`` of each row.

    ``text_digest``: sha256 of the canonical whole text. ``license_id``: that of the known text with this digest,
    null without one. ``line_licenses``: identifiers of lines that are known texts by themselves, distinct, in order, joined
    by commas ('' without); ``n_license_lines``: how many such lines there are. Empty forms match nothing. A null text
    counts as empty; null keys and repeated rows are kept; other columns are left out, so clashing names do no harm.
    ``known``: (identifier, text), ``digests``: (identifier, sha256 of a canonical form), MOST at most in all; equal canonical forms take the
    first identifier by name. Native expressions, one pass over the texts, which aren't shuffled: digests of whole texts and
    of lines as long as a known text are written to the shared folder, and joined with the small table of known ones.
    """
    if len(known) + len(digests) > MOST:
        raise ValueError(f"more than {MOST} known texts")
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    given = spark.createDataFrame([(i, t, None) for i, t in known] + [(i, None, d) for i, d in digests], "license_id string, text string, text_digest string")
    given = given.withColumn("form", canonical(F.col("text"))).where("text_digest is not null or form <> ''")
    table = given.groupBy(F.coalesce("text_digest", F.sha2("form", 256)).alias("text_digest")).agg(F.min("license_id").alias("license_id"), F.max(F.length("form")).alias("size"))
    table = scratch.save(table, "known", len(known) + len(digests))
    sizes = sorted({r["size"] for r in table.select(F.when(F.col("size") > 0, F.col("size")).alias("size")).distinct().collect()} - {None}) or [-1]  # MOST rows at most
    rows = docs.select(F.col(key), canonical_lines(F.col(text).cast("string")).alias("lines"))
    forms = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).isin(sizes))
    rows = rows.select(key, F.sha2(joined(F.col("lines")), 256).alias("text_digest"), F.transform(forms, lambda x: F.sha2(x, 256)).alias("line_digests"))
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    small = F.broadcast(table.select("text_digest", "license_id"))
    hits = rows.select("row", F.explode("line_digests").alias("text_digest")).join(small, "text_digest")
    hits = hits.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses"), F.count("*").alias("n_license_lines"))
    out = rows.drop("line_digests").join(small, "text_digest", "left").join(hits, "row", "left")
    return out.select(key, "text_digest", "license_id", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_lines(column: str) -> str:
    out = f"regexp_replace(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), {_sql_text(_COPYRIGHT)}, chr(10), 'g')"
    out = f"regexp_replace(replace({out}, '&', ' and '), {_sql_text(_MARKS)}, ' ', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, {_sql_text(a)}, {_sql_text(b)})"
    return out


def _sql_joined(lines: str) -> str:
    out = f"trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'))"
    for a, b in SPELLINGS:
        if " " in a:
            out = f"replace({out}, {_sql_text(a)}, {_sql_text(b)})"
    return out


ORACLE = f"""
WITH given(license_id, text) AS (VALUES {", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in KNOWN)}),
known AS (
  SELECT digest, min(license_id) AS license_id FROM (
  SELECT sha256(form) AS digest, license_id
  FROM (SELECT license_id, {_sql_joined(_sql_lines("text"))} AS form FROM given) WHERE form <> ''
  UNION ALL SELECT * FROM (VALUES {", ".join(f"('{d}', '{i}')" for i, d in DIGESTS)}) AS t(digest, license_id)) GROUP BY 1
),
docs AS (SELECT doc_id, {_sql_lines("text")} AS lines FROM documents),
parts AS (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM docs),
hits AS (
  SELECT doc_id, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS line_licenses, count(*) AS n
  FROM parts JOIN known k ON sha256(trim(line)) = k.digest GROUP BY doc_id
),
whole AS (SELECT doc_id, sha256({_sql_joined("lines")}) AS text_digest FROM docs)
SELECT w.doc_id, w.text_digest, k.license_id, coalesce(h.line_licenses, '') AS line_licenses, coalesce(h.n, 0)::BIGINT AS n_license_lines
FROM whole w LEFT JOIN known k ON w.text_digest = k.digest LEFT JOIN hits h ON w.doc_id = h.doc_id
"""
