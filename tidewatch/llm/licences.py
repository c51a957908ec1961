"""License scans: canonical digests of whole texts, joined to those of known licences."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Workspace, lookup

# Spellings that stand for the same word, as (found, kept).
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("organisation", "organization"), ("authorised", "authorized"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("whilst", "while"), ("noninfringement", "non infringement"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("c", "copyright"), ("©", "copyright")]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details.

You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

# Public licence texts, and one-line notices that stand for a licence.
KNOWN_TEXTS = [
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD2 + _BSD_END),
    ("BSD-3-Clause", _BSD2 + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST),
    ("Apache-2.0", _APACHE_NOTICE),
    ("GPL-3.0-or-later", _GPL_NOTICE.format("")),
    ("LGPL-3.0-or-later", _GPL_NOTICE.format("Lesser ")),
    ("AGPL-3.0-or-later", _GPL_NOTICE.format("Affero ")),
    ("MPL-2.0", _MPL_NOTICE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]

# One pattern each, in a dialect that Java, RE2 and Python read alike.
_LEAD = r"(^|\n)[ \t/*#;!>-]*"
COPYRIGHT_LINE = _LEAD + r"(copyright[ \t]*(\(c\)|©)|(copyright|\(c\)|©)[^\n]*(19|20)[0-9][0-9])[^\n]*"
RIGHTS_LINE = _LEAD + r"all rights reserved\.?[ \t]*"
#: ASCII punctuation and white space; no-break and wide spaces, dashes, quotes, dots and guillemets.
PUNCTUATION = "[\\x00-\\x20!-/:-@\\[-`{-~\u00a0\u00ab\u00bb\u2000-\u200b\u2010-\u2015\u2018-\u201f\u2026\u2039\u203a\u3000]+"


def canonical(text: Column) -> Column:
    """A-Z lower-cased; copyright lines dropped; punctuation and white space to one space; spellings unified.

    Between words stand two blanks, one of each word, until all spellings are replaced:
    so words in a row are replaced alike.
    """
    t = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    t = F.regexp_replace(F.regexp_replace(t, COPYRIGHT_LINE, "\n"), RIGHTS_LINE, "\n")
    t = F.concat(F.lit(" "), F.regexp_replace(t, PUNCTUATION, "  "), F.lit(" "))
    for found, kept in SPELLINGS:
        t = F.replace(t, F.lit(_apart(found)), F.lit(_apart(kept)))
    return F.trim(F.regexp_replace(t, " +", " "))


def _apart(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def gate_words(texts: Sequence[tuple[str, str]], most: int = 60) -> list[str]:
    """Words such that every one of the (id, text) has one in any spelling: a line without any is none of them.

    Words that a spelling rule touches, or that stand in a copyright line, don't count.
    A text without such a word, or more than ``most`` words: an empty list, for no gate.
    """
    touched = {w for pair in SPELLINGS for part in pair for w in part.split()}
    left, out = [], []
    for _, t in texts:
        bare = re.sub(RIGHTS_LINE, "\n", re.sub(COPYRIGHT_LINE, "\n", t.lower()))
        left.append({w for w in re.split(PUNCTUATION, bare) if re.fullmatch("[a-z]{4,}", w)} - touched)
    while left and len(out) <= most:
        if not all(left):
            return []
        count: dict[str, int] = {}
        for words in left:
            for w in words:
                count[w] = count.get(w, 0) + 1
        # Of words that tell equally many texts, the longest: it stands in the fewest lines.
        best = max(count, key=lambda w: (count[w], len(w), w))
        out.append(best)
        left = [words for words in left if best not in words]
    return out if len(out) <= most else []


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_table(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id) of known licence texts, one row for each digest (the least id of equal ones)."""
    given = spark.createDataFrame(texts or KNOWN_TEXTS, "license_id string, text string")
    return given.select(digest(F.col("text")).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", gate: Sequence[str] = ()) -> DataFrame:
    """(doc_id, digest, license_id, notices) for each row of ``docs``.

    license_id: that of the known licence whose digest the entire text has, else null.
    notices: ids, sorted and joined by commas, of those that a single line of the text
    is, however long, found by the same digests; null if none.  ``gate``: words one of
    which stands in every known licence (``gate_words``), so that other lines needn't be
    digested; none: all lines are.  Null texts count as empty.  Ids may be null or repeat:
    rows have keys of their own.  ``known`` is broadcast up to 20,000 digests and joined
    salted beyond that.  An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"(?i){'|'.join(gate)}") if gate else F.length(x) > 0)
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest"), F.array_distinct(F.transform(lines, digest)).alias("line_digests"))
    work = Workspace(docs.sparkSession, "licences")
    rows = work.save(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    named = work.save(known, "known")
    notes = lookup(rows.select("row", F.explode("line_digests").alias("digest")), named, ["digest"], ["row"])
    notes = notes.where("license_id is not null").groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    whole = lookup(rows.drop("line_digests"), named, ["digest"], ["row"])
    return whole.join(notes, "row", "left").select("doc_id", "digest", "license_id", "notices")


def scan_sql(known: list[tuple[str, str]] | None = None) -> str:
    """The same over table documents in SQL: every line is digested."""

    def norm(x: str) -> str:
        q = lambda v: "'" + v.replace("'", "''") + "'"
        t = f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        t = f"regexp_replace(regexp_replace({t}, {q(COPYRIGHT_LINE)}, chr(10), 'g'), {q(RIGHTS_LINE)}, chr(10), 'g')"
        t = f"(' ' || regexp_replace({t}, {q(PUNCTUATION)}, '  ', 'g') || ' ')"
        for found, kept in SPELLINGS:
            t = f"replace({t}, '{_apart(found)}', '{_apart(kept)}')"
        return f"sha256(trim(regexp_replace({t}, ' +', ' ', 'g')))"

    texts = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in known or KNOWN_TEXTS)
    return f"""
    with known as (select {norm('t')} as digest, min(i) as license_id from (values {texts}) as v(i, t) group by 1),
    docs as (select doc_id, coalesce(text, '') as text from documents),
    line as (select distinct doc_id, {norm('x')} as digest from (select doc_id, unnest(string_split(text, chr(10))) as x from docs) where length(x) > 0),
    notes as (select doc_id, string_agg(distinct license_id, ',' order by license_id) as notices from line join known using (digest) group by 1)
    select doc_id, d.digest, license_id, notices from (select doc_id, {norm('text')} as digest from docs) d
    left join known using (digest) left join notes using (doc_id)"""
