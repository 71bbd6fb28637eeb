"""License scans by canonical digest lookup (native SQL functions only).

A text is reduced to a canonical word string: A-Z lower-cased, copyright lines
dropped, everything but a-z and 0-9 turned into one space, equivalent spellings
replaced. The SHA-256 of the whole canonical text is hash-joined to the digests
of known licences: of texts held here, with and without their titles, and of
longer ones whose digest is held. The known side has one row per catalogue entry,
so its size is bounded by the catalogue and it is broadcast.

Defined results: a null text counts as empty; an empty canonical text has the
digest of the empty string and no licence; repeated rows stay repeated; two
catalogue entries with one digest give the smaller id; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A line that states a holder or a year, or that all rights are reserved; "the above copyright notice" is none.
COPYRIGHT_LINE = (
    r"^[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:c\)|©|[0-9]|year|yyyy)|copyright [^\n]*\b[12][0-9][0-9][0-9]\b"
    r"|\(c\)[^a-z0-9\n]*[0-9]|©|all rights reserved[^a-z0-9\n]*$)[^\n]*"
)
#: Spellings that licence-matching practice treats as equal.
EQUIVALENT_WORDS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("judgement", "judgment"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("merchantibility", "merchantability"),
    ("modelling", "modeling"),
    ("noninfringement", "non infringement"),
    ("organisation", "organization"),
    ("programme", "program"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("wilful", "willful"),
)
#: Licence texts and one-line notices, as published.
KNOWN_LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}


#: Titles that texts are often headed with.
TITLES = {
    "MIT": "MIT License",
    "ISC": "ISC License",
    "0BSD": "BSD Zero Clause License",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "Zlib": "zlib License",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003",
}
#: SHA-256 of the canonical forms of long texts as published, titles and appendices included.
KNOWN_DIGESTS = {
    "Apache-2.0": "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71",
    "GFDL-1.3": "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}


def catalogue(known: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(id, text) of known licences, with and without their titles."""
    known = KNOWN_LICENSES if known is None else known
    titled = [(k, f"{TITLES[k]}\n\n{v}") for k, v in known.items() if k in TITLES]
    return sorted([*known.items(), *titled])


def canonical(text: Column) -> Column:
    """Canonical form of a whole licence text."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    t = F.regexp_replace(t, F.lit("(?md)" + COPYRIGHT_LINE), F.lit(""))
    # Words are set apart by two spaces so that neighbours can both be replaced.
    t = F.concat(F.lit(" "), F.regexp_replace(t, F.lit("[^a-z0-9]+"), F.lit("  ")), F.lit(" "))
    for said, standard in EQUIVALENT_WORDS:
        t = F.replace(t, F.lit(f" {said.replace(' ', '  ')} "), F.lit(f" {standard.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(t, F.lit(" +"), F.lit(" ")))


def known_digests(spark, known: dict[str, str] | None = None) -> DataFrame:
    """license_digest, license_id: one row for each distinct digest of the catalogue."""
    entries = [
        F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("t"))
        for k, v in catalogue(known)
    ]
    return (
        spark.range(1)
        .select(F.explode(F.array(*entries)).alias("e"))
        .select("e.license_id", F.sha2(canonical(F.col("e.t")).cast("binary"), 256).alias("license_digest"))
        .unionByName(_given(spark, KNOWN_DIGESTS if known is None else {}))
        .groupBy("license_digest")
        .agg(F.min("license_id").alias("license_id"))
    )


def _given(spark, digests: dict[str, str]) -> DataFrame:
    if not digests:
        return spark.createDataFrame([], "license_id string, license_digest string")
    rows = F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("license_digest")) for k, v in digests.items()))
    return spark.range(1).select(F.inline(rows))


def scan(docs: DataFrame, known: dict[str, str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, canonical length, digest and licence (null if unknown)."""
    c = canonical(F.col("text"))
    digests = docs.select(F.col(id_col), c.alias("c")).select(
        id_col,
        F.length("c").cast("long").alias("canonical_chars"),
        F.sha2(F.col("c").cast("binary"), 256).alias("license_digest"),
    )
    table = F.broadcast(known_digests(docs.sparkSession, known))  # as many rows as the catalogue
    return digests.join(table, "license_digest", "left").select(
        id_col, "canonical_chars", "license_digest", "license_id"
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_canonical(column: str) -> str:
    """The same canonical form for DuckDB."""
    t = f"translate(coalesce({column}, ''), '{UPPER}', '{UPPER.lower()}')"
    t = f"regexp_replace({t}, {_sql_text('(?m)' + COPYRIGHT_LINE)}, '', 'g')"
    t = f"concat(' ', regexp_replace({t}, '[^a-z0-9]+', '  ', 'g'), ' ')"
    for said, standard in EQUIVALENT_WORDS:
        t = f"replace({t}, ' {said.replace(' ', '  ')} ', ' {standard.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


def oracle() -> str:
    """DuckDB SQL for scan() over documents."""
    values = ", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in catalogue())
    digests = ", ".join(f"({_sql_text(v)}, {_sql_text(k)})" for k, v in KNOWN_DIGESTS.items())
    return f"""
WITH known AS (
  SELECT license_digest, min(license_id) AS license_id
  FROM (SELECT sha256({sql_canonical('t')}) AS license_digest, license_id FROM (VALUES {values}) AS v(license_id, t)
        UNION ALL SELECT * FROM (VALUES {digests}) AS d(license_digest, license_id)) GROUP BY 1),
canon AS (SELECT doc_id, {sql_canonical('text')} AS c FROM documents)
SELECT doc_id, length(c)::BIGINT AS canonical_chars, sha256(c) AS license_digest, license_id
FROM canon LEFT JOIN known ON known.license_digest = sha256(c)"""
