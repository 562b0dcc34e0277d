"""License scans: canonical digests of entire texts, looked up in a table of known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that mean the same in licence texts, replaced in lower case wherever they stand, in this order.
SPELLINGS = (
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("favour", "favor"), ("organis", "organiz"), ("recognis", "recogniz"), ("authoris", "authoriz"),
    ("analogue", "analog"), ("whilst", "while"), ("copyright holder", "copyright owner"), ("noncommercial", "non commercial"), ("per cent", "percent"), (" v2", " version 2"), (" v3", " version 3"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
#: Licence, kind and text of what is known by default; any table of these columns can take its place.
KNOWN = (
    ("MIT", "text", _MIT), ("MIT", "text", "MIT License\n" + _MIT), ("MIT", "text", "The MIT License (MIT)\n" + _MIT),
    ("ISC", "text", _ISC + "\n" + _AS_IS), ("ISC", "text", "ISC License\n" + _ISC + "\n" + _AS_IS), ("0BSD", "text", _ZERO_BSD + "\n" + _AS_IS), ("Apache-2.0", "text", _APACHE_NOTICE),
    ("BSD-2-Clause", "text", _BSD + _BSD_AS_IS), ("BSD-3-Clause", "text", _BSD + _BSD_NAMES + _BSD_AS_IS), ("BSD-2-Clause", "text", "BSD 2-Clause License\n" + _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", "text", "BSD 3-Clause License\n" + _BSD + _BSD_NAMES + _BSD_AS_IS), ("Zlib", "text", _ZLIB), ("Zlib", "text", "zlib License\n" + _ZLIB), ("BSL-1.0", "text", _BOOST), ("Unlicense", "text", _UNLICENSE),
    ("MIT", "notice", "Released under the MIT License."), ("MIT", "notice", "Licensed under the MIT License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
)

#: A line that names a copyright's owner and says nothing of the terms.
COPYRIGHT_LINE = r"(?i)^[^\p{L}\p{N}]*(copyright|\(c\)|©).*(\(c\)|©|[0-9]{4}).*$|^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
#: Known texts beyond this number are joined by a shuffle; under it, the table of digests (under 200 bytes a row) is broadcast.
MAX_BROADCAST = 100_000


def plain_lines(text: Column) -> Column:
    """The lines of text but those on copyright: lower case, letters and digits only, single blanks."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.rlike(x, F.lit(COPYRIGHT_LINE)))
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")))


def spelled(plain: Column) -> Column:
    for way, one in SPELLINGS:
        plain = F.replace(plain, F.lit(way), F.lit(one))
    return plain


def canonical(lines: Column) -> Column:
    """One text of plain_lines(), with one spelling."""
    return spelled(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license string, kind string, text string")


def known_files(spark: SparkSession, path: str) -> DataFrame:
    """Licence texts in files that are named after them, such as GPL-3.0.txt or GPL-3.0, as a table for scan()."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"(?i)\.(txt|text|md|html?)$", "")
    return spark.read.text(path, wholetext=True).select(name.alias("license"), F.lit("text").alias("kind"), F.col("value").alias("text"))


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """A row for each document: the key, digest (of its canonical whole text), license (known for the whole text, else
    null) and notices (sorted known licences that a whole line of it is the text of).

    known: columns license and text. A digest of several licences gives the first in order. A null or empty text has
    the digest of the empty text and matches nothing, as does one of copyright lines only. Repeated rows stay rows, an
    empty table gives none, very long texts are digested whole, and other columns are not looked at.
    Texts are read once; the digests meet the known ones before anything is shuffled, and what moves then is a row
    for each document and known line, without its text: no licence, however common, gathers documents in one task.
    """
    table = known.select("license", canonical(plain_lines(F.col("text"))).alias("_text")).filter("_text != ''")
    table = table.groupBy(F.sha2("_text", 256).alias("_digest")).agg(F.min("license").alias("_license"))
    few = table.limit(max_broadcast + 1).count() <= max_broadcast
    given = docs.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), plain_lines(F.coalesce(F.col(text), F.lit(""))).alias("_lines"))
    digests = F.concat(F.array(F.sha2(canonical(F.col("_lines")), 256)), F.array_distinct(F.transform("_lines", lambda x: F.sha2(spelled(x), 256))))
    units = given.select("_key", "_row", F.posexplode(digests).alias("_at", "_digest"))
    hits = units.join(F.broadcast(table) if few else table, "_digest", "left").filter("_at = 0 OR _license IS NOT NULL")
    whole = lambda c: F.max(F.when(F.col("_at") == 0, F.col(c)))
    out = hits.groupBy("_key", "_row").agg(whole("_digest").alias("digest"), whole("_license").alias("license"), F.array_sort(F.collect_set(F.when(F.col("_at") > 0, F.col("_license")))).alias("notices"))
    return out.select(F.col("_key").alias(key), "digest", "license", F.array_join("notices", ",").alias("notices"))


COLUMNS = ["doc_id", "digest", "license", "notices"]


def oracle_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, _, t in KNOWN)

    def spelled_sql(x: str) -> str:
        for way, one in SPELLINGS:
            x = f"replace({x}, {quoted(way)}, {quoted(one)})"
        return x

    lines = f"list_transform(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, {quoted(COPYRIGHT_LINE)})), lambda x: trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"
    whole = spelled_sql("array_to_string(list_filter(ls, lambda x: x <> ''), ' ')")
    return f"""
WITH k0(license, t) AS (VALUES {known}), k1 AS (SELECT license, {lines} AS ls FROM k0),
k AS (SELECT sha256({whole}) AS dg, min(license) AS license FROM k1 WHERE {whole} <> '' GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT rid, doc_id, {lines} AS ls FROM d),
w AS (SELECT rid, doc_id, sha256({whole}) AS digest FROM l),
n AS (SELECT rid, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices FROM (SELECT rid, unnest(ls) AS x FROM l) JOIN k ON k.dg = sha256({spelled_sql('x')}) GROUP BY rid)
SELECT doc_id, digest, k.license, coalesce(notices, '') AS notices FROM w LEFT JOIN k ON k.dg = digest LEFT JOIN n USING (rid)"""
