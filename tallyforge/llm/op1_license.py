"""Licence scan by canonical digest: normalise a whole text, then hash-join it to the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.llm.common import pick

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TOP = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: Public licence texts and notices, by identifier. Titles count as part of a text, so both forms are listed.
KNOWN = {
    "MIT": [_MIT, "MIT License\n" + _MIT, "The MIT License (MIT)\n" + _MIT],
    "ISC": [f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"],
    "0BSD": [f"{_ISC_GRANT}.\n\n{_ISC_END}", f"BSD Zero Clause License\n{_ISC_GRANT}.\n\n{_ISC_END}"],
    "BSD-2-Clause": [_BSD_TOP + _BSD_END, "BSD 2-Clause License\n" + _BSD_TOP + _BSD_END],
    "BSD-3-Clause": [_BSD_TOP + _BSD_NAME + _BSD_END, "BSD 3-Clause License\n" + _BSD_TOP + _BSD_NAME + _BSD_END],
    "Unlicense": [_UNLICENSE, "The Unlicense\n" + _UNLICENSE],
    "BSL-1.0": [_BOOST, "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST],
    "Zlib": [_ZLIB, "zlib License\n" + _ZLIB],
    "Apache-2.0-notice": [_APACHE_NOTICE, "Licensed under the Apache License, Version 2.0."],
    "GPL-3.0-or-later-notice": [_GPL3_NOTICE],
    "GPL-3.0-notice": ["This work is licensed under the GNU General Public License, version 3."],
    "MIT-notice": ["Released under the MIT License."],
    "CC-BY-NC-4.0-notice": ["Licensed under CC BY-NC 4.0."],
}

#: Words after "copyright" that go on with a sentence and are no holder.
_NO_HOLDER = r"(?:notices?|holders?|owners?|owned|laws?|licen[cs](?:e|es|ed|ing|or|ors)|statements?|interests?|permissions?|protections?|treat(?:y|ies)|claims?|claimed|disclaimers?|infringements?|rights?|terms?|acts?|status|headers?|information|ownership|patents?|trademarks?|trade|and|or|nor|of|in|on|to|for|from|with|under|as|at|is|are|was|were|be|it|its|this|that|these|those|which|if|may|must|shall|can|will|not|no|any|such|other|only|applies|above|below)\b"
#: Words after "(c)" that make it an item of a list.
_ITEM = r"(?:the|a|an|all|each|every|either|neither|you|your|we|they|he|she|there|their|where|when|who|by|do|does|make|use|give|include|includes|cause|retain|provide|provided|accompany|convey|distribute|reproduce|modify|copy|redistributions?|modifications?|altered|loss|any)\b"
#: A whole line that states a copyright: a sign, year or holder after "copyright", "(c)" or "©", or all rights reserved.
STATEMENT_LINE = rf"(?m)^[^\p{{L}}\p{{N}}\n]*(?:copyright[ \t]*(?:\(c\)|©|[:,]?[ \t]*\p{{N}}|:?[ \t]+(?!{_NO_HOLDER})\p{{L}})|\(c\)[ \t]*(?:copyright\b(?![ \t]+{_NO_HOLDER})|\p{{N}}|(?!{_NO_HOLDER}|{_ITEM})\p{{L}})|©|all rights reserved)[^\n]*$"
#: What a line that states a copyright has in any case.
MENTION = r"copyright|\(c\)|©|all rights reserved"
#: Fixed values: (pattern of whole words, replacement) of equivalent spellings, applied to lower-cased text of single-spaced words.
SPELLINGS = [
    (r"licenc(e|es|ed|ing)", r"licens$1"),
    (r"sub (licens(?:e|es|ed|ing))", r"sub$1"),
    (r"non (infringement|commercial|exclusive)", r"non$1"),
    (r"(organi|authori|recogni|summari|utili)s(e|es|ed|ing|ation|ations)", r"$1z$2"),
    (r"merchantibility", "merchantability"),
    (r"acknowledgement", "acknowledgment"),
    (r"fulfil", "fulfill"),
    (r"favour", "favor"),
    (r"behaviour", "behavior"),
    (r"honour", "honor"),
    (r"judgement", "judgment"),
    (r"https", "http"),
    (r"copyright holders", "copyright holder"),
]


def _words(pattern: str) -> str:
    return f"(?<![^ ])(?:{pattern})(?![^ ])"


def canonical(text: Column) -> Column:
    """Lower case without lines that state a copyright and punctuation, words single-spaced, spellings made one; null stays null.

    Most texts mention no copyright and have none of the spellings: one look for any tells, and the rest is left out.
    """
    t = F.lower(text)
    t = F.when(t.rlike(MENTION), F.regexp_replace(t, STATEMENT_LINE, "")).otherwise(t)
    t = F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))
    one = t
    for pattern, to in SPELLINGS:
        one = F.regexp_replace(one, _words(pattern), to)
    return F.when(t.rlike(_words("|".join(p.replace("licens", "licen[cs]") for p, _ in SPELLINGS))), one).otherwise(t)


def catalogue(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """(license_id, digest) of known licences, one row a digest; a digest under two names goes to the first by name.

    It has a row for each known text: a list that people keep, some hundreds of rows. Spark broadcasts it if its size
    permits, and else joins by shuffle.
    """
    rows = [(k, t) for k, ts in sorted((KNOWN if texts is None else texts).items()) for t in ts]
    listed = F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("license_text")) for k, t in rows])
    return _digests(spark.range(1).select(F.inline(listed)))


def _digests(texts: DataFrame) -> DataFrame:
    return texts.select("license_id", F.sha2(canonical(F.col("license_text")), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def catalogue_of(spark: SparkSession, path: str, with_known: bool = True) -> DataFrame:
    """As ``catalogue``, of a folder (or glob) of licence texts, one a file: ``<id>.txt`` or ``<id>.md``; further forms of one as ``<id>__<any>.txt``.

    For long licences, whose texts people keep as files. With ``with_known`` the built-in ones too; a digest of both is the folder's.
    """
    name = F.regexp_replace(F.col("_metadata.file_name"), r"(__.*)?\.(txt|md)$", "")
    own = _digests(spark.read.text(path, wholetext=True).select(name.alias("license_id"), F.col("value").alias("license_text")))
    return own.union(catalogue(spark).join(own.select("digest"), "digest", "left_anti").select(*own.columns)) if with_known else own


def license_scan(docs: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, digest, license_id, is_license.

    digest: SHA-256 (hex) of the canonical whole text. A null text has null digest and no licence; a text without a letter
    or digit has the digest of the empty string and no licence. Repeated rows give repeated results. Nothing is
    gathered by key: the canonical text is made in the scan and the join moves digests only.
    """
    known = catalogue(docs.sparkSession) if known is None else known
    known = known.where(F.col("digest") != F.sha2(F.lit(""), 256)).select(F.col("digest").alias("_digest"), F.col("license_id").alias("_license"))
    rows = pick(docs, key, text).select(F.col(key), F.sha2(canonical(F.col(text)), 256).alias("digest"))
    out = rows.join(known, rows["digest"] == known["_digest"], "left")
    return out.select(F.col(key), "digest", F.col("_license").alias("license_id"), F.col("_license").isNotNull().alias("is_license"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _duck_canonical(x: str) -> str:
    """The same by lines and by words: a line goes if it begins as a statement does and not as a sentence, a word by a table of words."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    begins = lambda what: f"regexp_matches(l, {quote('^[^\\p{L}\\p{N}]*' + what)})"
    signed = begins(r"(copyright[ \t]*(\(c\)|©|:?[ \t]*\pN|,[ \t]*\pN)|\(c\)[ \t]*\pN|©|all rights reserved)")
    named = f"({begins(r'copyright:?[ \t]+\pL')} and not {begins(r'copyright:?[ \t]+' + _NO_HOLDER)})"
    listed = f"({begins(r'\(c\)[ \t]*\pL')} and not {begins(r'\(c\)[ \t]*(' + _NO_HOLDER + '|' + _ITEM + ')')})"
    lines = f"array_to_string(list_filter(string_split(lower({x}), chr(10)), lambda l: not ({signed} or {named} or {listed})), chr(10))"
    endings = [("licenc", "licens", e) for e in ("e", "es", "ed", "ing")]
    endings += [(stem + "s", stem + "z", e) for stem in ("organi", "authori", "recogni", "summari", "utili") for e in ("e", "es", "ed", "ing", "ation", "ations")]
    table = {a + e: b + e for a, b, e in endings} | {"merchantibility": "merchantability", "acknowledgement": "acknowledgment", "fulfil": "fulfill", "favour": "favor", "behaviour": "behavior", "honour": "honor", "judgement": "judgment", "https": "http"}
    words = f"list_filter(regexp_split_to_array({lines}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    told = f"map([{', '.join(map(quote, table))}], [{', '.join(map(quote, table.values()))}])"
    out = f"' ' || array_to_string(list_transform({words}, lambda w: coalesce({told}[w], w)), '  ') || ' '"
    # each word has a space of its own on both sides
    pairs = [(f" sub  licens{e} ", f" sublicens{e} ") for e in ("e", "es", "ed", "ing")] + [(f" non  {w} ", f" non{w} ") for w in ("infringement", "commercial", "exclusive")] + [(" copyright  holders ", " copyright  holder ")]
    for old, new in pairs:
        out = f"replace({out}, {quote(old)}, {quote(new)})"
    return f"trim(replace({out}, '  ', ' '))"


def sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(t)})" for k, ts in sorted(KNOWN.items()) for t in ts)
    return f"""
with known as (select sha256({_duck_canonical('license_text')}) as k, min(license_id) as license_id
               from (values {values}) v(license_id, license_text) group by 1),
d as (select doc_id, sha256({_duck_canonical('text')}) as digest from documents)
select doc_id, digest, license_id, license_id is not null as is_license from d left join known on digest = k
"""
