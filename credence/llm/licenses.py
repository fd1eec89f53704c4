"""Licence scans by canonical digest, native Spark SQL only.

A text is brought into a canonical form: lower case, copyright notices removed,
punctuation and white space to single spaces, equivalent spellings to one of
them. Notices are lines, so what a licence says of copyright stays whatever its
wrap; so do notices of a licence's own steward, which are part of its text. The SHA-256 of the form of the entire text is joined to the digests of
known licences, which are made by the same expression. Lines that speak of a
licence are looked up in the same way, each as a text of its own.

Defined results: a null or empty text has the digest of the empty form and no
licence; repeated rows each get their row; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm.common import bounded_rows

#: Rows of a table of known texts, at most.
MOST_KNOWN = 10_000

# Pairs that the public SPDX matching guidelines count as the same word.
SAME_WORDS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
]

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted"""

ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""

BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
"""

BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""

#: Known texts: full licences, notices, and one-line statements.
KNOWN = [
    ("MIT", MIT),
    ("MIT", f"MIT License\n{MIT}"),
    ("MIT", f"The MIT License (MIT)\n{MIT}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{ISC_END}"),
    ("0BSD", f"{ISC_GRANT}.\n{ISC_END}"),
    ("BSD-2-Clause", BSD_HEAD + BSD_END),
    ("BSD-3-Clause", BSD_HEAD + BSD_NAMES + BSD_END),
    ("Zlib", ZLIB),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]

#: Digests of entire licences as their stewards publish them, made by ``digest`` (fixed values).
#: "terms" are those up to and with the line END OF TERMS AND CONDITIONS.
DIGESTS = [
    ("Apache-2.0", "6074c3536c43b739207170b87d1681477d0f07374ed3d862ba461334cce848e3"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause-UC", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", "41315558109f3b1787fffbcce76590d488cae4a6a59ddebf627062aba77a57c3"),
    ("GFDL-1.3-only", "d046f83b7924767ab3b79a76e4a83f953b39c0f581035094771c153607c77cac"),
    ("GPL-1.0-only", "0e559e9b33b1cc6f32a8b98bbb3a8b660c0cfd588e6cc81be1f668a98d6db5bb"),
    ("GPL-1.0-only", "d8fae6c4c3a2bd31bcbf7e530d32c5bb500903c04003f7094bd1c29da46ddfe2"),
    ("GPL-2.0-only", "07dfa894297041bda1b5d5dde9d4da5ff97c86fc88947464095357e0acd5e68b"),
    ("GPL-2.0-only", "f039a8c8c4090501285c3312ad19e6ddabcb44709f72052adf864e7734f2d62c"),
    ("GPL-3.0-only", "8224a51b9e2af35771454a3ae87876c921f63dd8d905faba6e9475786bd6a86e"),
    ("GPL-3.0-only", "767d60c2840abc80b987711847ae9f3122153ef07ccdb779820abe5aa2f048fd"),
    ("LGPL-2.0-only", "80ed9421e8368ca577a36ff20948fabc39d16433fb374b6c35b3a04497904133"),
    ("LGPL-2.0-only", "f3b6833303fbcbeb1c526ee3c83704b24f7ac34490cc5bd8bd1df2597e08d511"),
    ("LGPL-2.1-only", "c86fab2354c3f1de27216777942b7550253528250fe9fcceb9f8aa0854bb850d"),
    ("LGPL-2.1-only", "1b09655c9ec8d62903658db5726824da51cf7e912a488efd7257e17a48f3243d"),
    ("LGPL-3.0-only", "6735e0409c8bbe035b30a5fc4cbcb5e216d472a2b26ec01a9fbe117dce90d5dc"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]

#: Notices that are licence text: the steward's own, and those with a blank for the year. They stay.
OWN_NOTICE = (
    "(?i)copyright[ \\t\\r\\n]*(\\(c\\))[ \\t\\r\\n]*"
    "(([0-9]{4}[-, \\t\\r\\n]*)+free[ \\t\\r\\n]+software|<year>|year[ \\t\\r\\n]|\\[?yyyy|19yy)"
)
#: A phrase without effect, wherever it stands.
RESERVED = "(?i)all[ \\t\\r\\n]+rights[ \\t\\r\\n]+reserved"
LEAD = "[ \\t*/#;>-]*"
#: Lines that are copyright notices: by their year, by a sign and what it is of, or by the words alone.
NOTICE_LINE = (
    f"(?i)(^|\\n){LEAD}(copyright[ \\t]*(\\(c\\)|©|:)?[ \\t,]*[0-9]{{4}}|copyright[ \\t]*(\\(c\\)|©)[ \\t]*[0-9a-z]"
    f"|(\\(c\\)|©)[ \\t]*(copyright|[0-9]{{4}})|©)[^\\n]*"
)
#: A paragraph that begins with the word and a name. Texts that are wrapped before "copyright" go on in small letters or inside a paragraph.
NAME_LINE = f"(^[ \\t\\r\\n*/#;>-]*|\\n[ \\t\\r*/#;>-]*\\n){LEAD}[Cc]opyright[ \\t]+[A-Z][a-z][^\\n]*"
SPEAKS = "(?i)licen[cs]|spdx"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), RESERVED, "")
    out = F.regexp_replace(out, OWN_NOTICE, "copyrighted $2")
    # a line feed stays before each removed line, so the next may match too
    out = F.regexp_replace(out, NOTICE_LINE, "$1")
    out = F.lower(F.regexp_replace(out, NAME_LINE, "$1"))
    # two spaces between words: each has one on either side of its own, so neighbours don't share them
    out = F.regexp_replace(out, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "  ")
    out = F.concat(F.lit("  "), F.trim(out), F.lit("  "))
    for word, same in SAME_WORDS:
        out = F.replace(out, F.lit(f" {word.replace(' ', '  ')} "), F.lit(f" {same.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """digest and license_id of the known texts: the built-in ones, or a table of license_id and text."""
    if texts is None:
        named = spark.createDataFrame(KNOWN, "license_id string, text string").select(digest(F.col("text")).alias("digest"), "license_id")
        texts = named.union(spark.createDataFrame([(d, name) for name, d in DIGESTS], named.schema))
    else:
        texts = texts.select(digest(F.col("text")).alias("digest"), "license_id")
    return texts.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scanned(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id (of the entire text, or null) and notices (of its lines, comma-joined).

    ``texts`` (license_id, text) takes the place of the built-in licences; it
    has at most MOST_KNOWN rows, each row's digest and name being broadcast.
    """
    spark = docs.sparkSession
    pairs = bounded_rows(known(spark, texts), MOST_KNOWN, "known licences")
    table = spark.createDataFrame(pairs, "digest string, license_id string")
    by_digest = F.create_map(*[F.lit(x) for row in pairs for x in (row["digest"], row["license_id"])])
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike(SPEAKS))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(by_digest, digest(x))), lambda x: x.isNotNull())
    return (
        docs.select("doc_id", digest(F.col("text")).alias("digest"), found.alias("found"))
        .join(F.broadcast(table), "digest", "left")
        .select("doc_id", "digest", "license_id", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(coalesce({text}, ''), '{RESERVED}', '', 'g')"
    out = f"regexp_replace({out}, '{OWN_NOTICE}', 'copyrighted \\2', 'g')"
    out = f"lower(regexp_replace(regexp_replace({out}, '{NOTICE_LINE}', '\\1', 'g'), '{NAME_LINE}', '\\1', 'g'))"
    out = f"'  ' || trim(regexp_replace({out}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g')) || '  '"
    for word, same in SAME_WORDS:
        out = f"replace({out}, ' {word.replace(' ', '  ')} ', ' {same.replace(' ', '  ')} ')"
    return f"trim(replace({out}, '  ', ' '))"


def scan_sql() -> str:
    """The same result as ``scanned`` over the view ``documents``."""
    values = ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in KNOWN)
    digests = "".join(f" UNION ALL SELECT '{d}', {_sql_text(name)}" for name, d in DIGESTS)
    return f"""
WITH every AS (SELECT sha256({_canonical_sql("t")}) AS digest, id FROM (VALUES {values}) AS v(id, t){digests}),
known AS (SELECT digest, min(id) AS license_id FROM every GROUP BY 1),
numbered AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
lines AS (SELECT n, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM numbered),
noticed AS (
  SELECT l.n, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notices
  FROM (SELECT n, sha256({_canonical_sql("line")}) AS digest FROM lines WHERE regexp_matches(line, '{SPEAKS}')) l
  JOIN known k USING (digest) GROUP BY l.n
),
whole AS (SELECT n, doc_id, sha256({_canonical_sql("text")}) AS digest FROM numbered)
SELECT w.doc_id, w.digest, k.license_id, coalesce(x.notices, '') AS notices
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN noticed x USING (n)
"""
