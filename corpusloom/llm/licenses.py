"""Licence scans by canonical digest lookup, with DataFrame functions only.

Texts are brought to a canonical form - lower case, copyright lines dropped, equivalent spellings
unified, everything but letters and digits to single spaces - and the digest of the entire form is
joined to the digests of known licences. The same lookup runs over the text's single lines, which
finds one-line notices inside documents. Both sides use the same expression, so the catalogue is
given as plain texts.

Scale: documents are read once and not shuffled; the catalogue of known texts is broadcast, behind
a check of its size (join_checked), for the whole-text join. Lines look up the digests of
one-line notices in a map literal while there are at most ``MOST_NOTICES``; beyond, the digests of
each different text's lines are joined to them. Both give the same rows (tested).

Defined results: null, empty and otherwise word-less texts have the digest of the empty form and
match nothing. Several catalogue entries of one form: the smallest name. Repeated rows each return
a row. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import join_checked, stored

MOST_NOTICES = 500

#: Spellings that count as one (pattern over lower-case text, replacement).
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("sub-license", "sublicense"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"),
    ("https?://", ""),
    ("&", " and "),
    ("%", " percent "),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("copyright holder", "copyright owner"),
    ("neither\\s+the\\s+names?\\s+of\\s+[^;]{1,200}?\\s+nor\\s+the\\s+names?\\s+of", "neither the name of the copyright owner nor the names of"),
)

#: Known texts, name and wording.
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)

#: Title lines that whole texts carry.
TITLES = (("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("0BSD", "BSD Zero Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("Zlib", "zlib License"), ("BSL-1.0", "Boost Software License 1.0"))
KNOWN += tuple((name, f"{title}\n\n{text}") for name, title in TITLES for n, text in KNOWN if n == name and "\n" in text)

#: Identifiers in one-line notices; parts and versions of the names of Creative Commons licences.
IDENTIFIERS = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib")
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
VERSIONS = {"3.0": "Unported", "4.0": "International"}
KNOWN += tuple((x, f"SPDX-License-Identifier: {x}") for x in IDENTIFIERS)
KNOWN += tuple(
    (f"CC-{short}-{v}", notice)
    for short, long in COMMONS.items()
    for v, kind in VERSIONS.items()
    for notice in (f"Licensed under CC {short} {v}.", f"SPDX-License-Identifier: CC-{short}-{v}", f"This work is licensed under a Creative Commons {long} {v} {kind} License.")
)

#: SHA-256 of the canonical form of whole texts as they are shipped, by licence.
KNOWN_DIGESTS = {
    "Apache-2.0": "18e3c30bb7e1ef0f48cba795da1e422e74adad7e3e09ee4dd50c0bad05476800",
    "Artistic-1.0-Perl": "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "274e3fa4591a80eebc8e3ef47ebbd37d9bdf263d33495c417079920cb6caac2f",
    "GFDL-1.3": "5e8b488ff84a1a3e9954cf9b716c8c56e4292049bc7606827bd08842f6de23ea",
    "GPL-1.0": "88c0d32b6685976f91edcbb228c50498a7324b47880b82b90b4b86377ca82e38",
    "GPL-2.0": "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6",
    "GPL-3.0": "90cf7d8e7a5d9428f784dc461c0252857b76a1af2479da6581a0e7c044dfd9f0",
    "LGPL-2.0": "59a061c498ef1c6b3fd9ad6466d69d12b400f64b87cb827d62c381d3bc6aca88",
    "LGPL-2.1": "1f0770d1499d1ef2c69208a3369d7d9f7722ab5c39fbad959327bed318feb554",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "c77e9962c08d23b48c63149bb388bce4f1191767261b9a9fc6df8e7c341c9d4c",
    "MPL-2.0": "ec835f8db606b7a75eb31727e0019a90f5f938b11079c2ce6afcedd4fee1f04e",
}

#: Digests of the Apache text without its appendix, and without the line that ends its terms.
SHORTENED = (
    ("Apache-2.0", "e6f590508f69b879ea7141bfb3c091bb978b217fb359ebacf70af6005cf9dcf1"),
    ("Apache-2.0", "bdfb8909b9f442a024b0e2c8ffed1e345c414b9b121af5ff4c5c2565a367f46f"),
)


def _other_than(words: tuple[str, ...]) -> str:
    """Pattern of a word's beginning that is no beginning of ``words``; without lookahead, which DuckDB has not."""
    heads = sorted({w[0] for w in words})
    tails = {h: tuple(w[1:] for w in words if w[0] == h) for h in heads}
    return "(?:" + "|".join([f"[^{''.join(heads)}\\s]", *(h + _other_than(t) for h, t in tails.items() if all(t))]) + ")"


#: Words that follow "copyright" in the bodies of licences; any other is a holder, a year or a sign.
BODY = ("notice", "holder", "owner", "law", "license", "licence", "statement", "and ")
#: Lines under a copyright line that begin with a year.
YEARS = "(?:\\n[^a-z0-9\\n]*(?:19|20)[0-9][0-9][^\\n]*)*"
#: A line that only states a copyright, with such lines under it, or that all rights are reserved.
COPYRIGHT = f"(?m)^[^a-z0-9\\n]*(?:(?:copyright[^a-z0-9\\n]+{_other_than(BODY)}|\\(c\\)|©)[^\\n]*{YEARS}|all rights reserved[^a-z0-9\\n]*)$"


def canonical_lines(text: Column) -> Column:
    """The canonical form, line by line: words parted by single spaces, lines by line feeds."""
    x = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), COPYRIGHT, "")
    for pattern, to in SPELLINGS:
        x = F.regexp_replace(x, pattern, to) if any(c in pattern for c in "?*+[(") else F.replace(x, F.lit(pattern), F.lit(to))
    return F.regexp_replace(x, r"[^\p{L}\p{N}\n]+", " ")


def canonical(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def catalogue(spark: SparkSession, known=KNOWN, digests=None) -> DataFrame:
    """(known_digest, license): one row for each canonical form; ``digests``: further digests by licence (null: those of this module)."""
    df = spark.createDataFrame(list(known), "license string, text string")
    form = canonical(canonical_lines(F.col("text")))
    told = spark.createDataFrame([(d, n) for n, d in (KNOWN_DIGESTS if digests is None else digests).items()] + [(d, n) for n, d in (SHORTENED if digests is None else ())], "known_digest string, license string")
    return df.where(form != "").select(F.sha2(form, 256).alias("known_digest"), "license").union(told).groupBy("known_digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, notices: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", most_notices: int = MOST_NOTICES) -> DataFrame:
    """(doc_id, digest, license, notices): licence of the entire text (or null), sorted names of its one-line notices.

    known: whole texts' digests (see ``catalogue``); notices: those looked up line by line, in a map up to ``most_notices``, else by a join.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines")).select("doc_id", "lines", F.sha2(canonical(F.col("lines")), 256).alias("digest"))
    out = join_checked(d, known.toDF("known_digest", "license"), F.col("digest") == F.col("known_digest"), "left")
    none = F.array().cast("array<string>")
    rows = [] if notices is None else notices.limit(most_notices + 1).collect()
    if not rows:
        return out.select("doc_id", "digest", "license", none.alias("notices"))
    of_lines = F.transform(F.split("lines", "\n"), lambda x: F.sha2(F.trim(x), 256))
    if len(rows) <= most_notices:
        names = F.create_map(*[F.lit(x) for r in rows for x in (r[0], r[1])])
        found = F.array_sort(F.array_distinct(F.filter(F.transform(of_lines, lambda x: names[x]), lambda x: x.isNotNull())))
        return out.select("doc_id", "digest", "license", found.alias("notices"))
    out = out.withColumn("same", F.sha2("lines", 256))
    lines = d.select(F.sha2("lines", 256).alias("of"), F.explode(F.array_distinct(of_lines)).alias("line"))
    held = join_checked(lines, stored(notices.toDF("line_digest", "name"), "notices"), F.col("line") == F.col("line_digest"), "inner")
    named = stored(held.groupBy("of").agg(F.array_sort(F.collect_set("name")).alias("names")), "noticed")
    return join_checked(out, named, F.col("same") == F.col("of"), "left").select("doc_id", "digest", "license", F.coalesce("names", none).alias("notices"))


def _sql(text: str, known=KNOWN) -> str:
    """DuckDB SQL of the canonical lines of the expression ``text``."""
    x = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT.replace('(?m)', '(?m)')}', '', 'g')"
    for pattern, to in SPELLINGS:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    digests = ", ".join(f"('{d}', '{n}')" for n, d in (*KNOWN_DIGESTS.items(), *SHORTENED))
    form = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"
    return f"""
WITH k AS (SELECT kd, min(n) AS license FROM (SELECT sha256({form(_sql('t'))}) AS kd, n FROM (VALUES {values}) v(n, t) UNION ALL SELECT * FROM (VALUES {digests}) w(kd, n)) x GROUP BY 1),
d AS (SELECT doc_id, {_sql('text')} AS lines FROM documents),
w AS (SELECT doc_id, lines, sha256({form('lines')}) AS digest FROM d),
u AS (SELECT w.doc_id, w.digest, list_sort(list_distinct(list(k.license))) AS ns FROM w, LATERAL (SELECT unnest(string_split(w.lines, chr(10))) AS l) x JOIN k ON sha256(trim(l)) = k.kd GROUP BY 1, 2)
SELECT w.doc_id, w.digest, k.license, coalesce(array_to_string(u.ns, ','), '') AS notices FROM w LEFT JOIN k ON w.digest = k.kd LEFT JOIN u ON u.doc_id = w.doc_id"""
