"""Licence texts found by their canonical digests, in DataFrame functions throughout.

A text is brought into a canonical form: lower case, copyright lines taken out, equivalent spellings made one, and all but
letters and digits turned into single spaces. The digest of the whole form is hash-joined to the digests of known licence
texts; so is the digest of each paragraph and of each line, which finds licences that stand inside other text.
Whole licences of several paragraphs are also found as runs of words, in a form that loses only copyright statements.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Equivalent spellings, as in the SPDX matching guidelines. Each left one becomes the right one.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sublicence", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https", "http"),
)
#: A line that only states whose copyright it is.
COPYRIGHT_LINE = r"(?m)^[ \t/*#;-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: A line that states a copyright: with a sign, a year or a holder, and not a wrapped line of a licence.
COPYRIGHT_STATEMENT = (
    r"(?m)^[ \t/*#;-]*(?:(?:(?i:copyright)[ \t:]*)?(?:(?i:\(c\))|©)[^\n]*|(?i:copyright)[ \t:]*(?:[12][0-9]{3}\b|[<\[{]\w)[^\n]*"
    r"|(?i:copyright)[ \t]+(?i:by)\b[^\n]*|(?:Copyright|COPYRIGHT)[ \t:]+\p{Lu}\p{Ll}[^\n]*|(?i:all rights reserved)[.!]?[ \t\r]*)$"
)
#: Paragraphs and lines of fewer words than this are no licence.
LEAST_WORDS = 4

#: Known licence texts and notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = (
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT), ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."), ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC), ("0BSD", ZERO_BSD), ("Zlib", ZLIB),
    ("WTFPL", WTFPL), ("Apache-2.0", APACHE_NOTICE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

{0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: Whole licences that are also looked for inside texts; those of several pages are files.
WHOLE = (
    ("MIT", MIT), ("ISC", ISC), ("0BSD", ZERO_BSD), ("Zlib", ZLIB), ("Apache-2.0", APACHE_NOTICE), ("Unlicense", UNLICENSE), ("BSL-1.0", BSL),
    *(("BSD-2-Clause", BSD_HEAD.format(*m) + BSD_WARRANTY) for m in (("1. ", "2. "), ("* ", "* "))),
    *(("BSD-3-Clause", BSD_HEAD.format(*m) + m[2] + BSD_NAMES + BSD_WARRANTY) for m in (("1. ", "2. ", "3. "), ("* ", "* ", "* "))),
    *((p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))),
)


#: What a text in lower case must hold for one of the copyright patterns to match, and for a spelling to be replaced.
COPYRIGHT_SIGNS = ("copyright", "(c)", "©", "all rights reserved")
ANY_SPELLING = " (?:" + "|".join(sorted({a for a, _ in SPELLINGS})) + ") "


def canonical(text: Column) -> Column:
    """The canonical form. Spellings are replaced in whole words; of two that overlap the first in SPELLINGS wins."""
    low = F.lower(text)
    return _spelled(F.when(_signed(low), F.regexp_replace(low, COPYRIGHT_LINE, " ")).otherwise(low))


def strict(text: Column) -> Column:
    """The canonical form, but that only copyright statements are taken out."""
    return _spelled(F.lower(F.when(_signed(F.lower(text)), F.regexp_replace(text, COPYRIGHT_STATEMENT, " ")).otherwise(text)))


def _signed(low: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in COPYRIGHT_SIGNS])


def _spelled(plain: Column) -> Column:
    """One look for any spelling; a search for each goes only through the few texts that have one."""

    def replaced(words: Column) -> Column:
        out = words
        for old, new in SPELLINGS:
            out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
        return F.trim(F.when(words.rlike(ANY_SPELLING), out).otherwise(words))

    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return F.transform(F.array(words), replaced)[0]


def telling_words(forms: list[str], least: int = 7) -> list[str]:
    """Words of which each form has one: a text can only have a form if it has, in lower case, one of these or of the spellings that become it.

    Of long words those that most forms share; a form without any gives its longest word. Words that a spelling of several words makes are left out.
    """
    made = {w for old, new in SPELLINGS if " " in old + new for w in new.split()}
    words = [{w for w in f.split(" ") if w and w not in made} for f in forms]
    left = [w for w in [{x for x in ws if len(x) >= least} or set(sorted(ws, key=lambda x: (-len(x), x))[:1]) for ws in words] if w]
    found = []
    while left:
        counts = Counter(x for w in left for x in w)
        best = min(counts, key=lambda x: (-counts[x], -len(x), x))
        found.append(best)
        left = [w for w in left if best not in w]
    return sorted({v for w in found for v in (w, *(old for old, new in SPELLINGS if new == w))})


def may_have(text: Column, forms: list[str]) -> Column:
    """Whether a text can have any of the forms. Forms of which one has no telling word keep all texts."""
    words = telling_words(forms)
    if not words or any(not f for f in forms):
        return F.lit(bool(forms))
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in words])


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_forms(spark: SparkSession, known: tuple, form: Callable[[Column], Column]) -> list[tuple[str, str]]:
    """(license, form) of each known text."""
    if not known:
        return []
    rows = F.array(*[F.struct(F.lit(i).alias("license"), F.lit(t).alias("text")) for i, t in known])
    listed = spark.range(1).select(F.explode(rows).alias("k")).select("k.license", form(F.col("k.text")).alias("form"))
    return [(r["license"], r["form"]) for r in listed.collect()]


def known_digests(spark: SparkSession, forms: list[tuple[str, str]]) -> DataFrame:
    """(digest, license): a row for each distinct canonical form."""
    least: dict[str, str] = {}
    for name, form in forms:
        key = hashlib.sha256(form.encode()).hexdigest()
        least[key] = min(name, least.get(key, name))
    return spark.createDataFrame(sorted(least.items()), "digest string, license string")


def lookup(docs: DataFrame, known: tuple = KNOWN, whole: tuple = WHOLE) -> DataFrame:
    """docs(doc_id, text, ...): returns (doc_id, digest, license, part_licenses, n_parts) for each row of docs.

    digest is the whole text's; license is that of a known text with the same digest, else null. part_licenses lists the
    licences, sorted and comma-joined, of the paragraphs and lines of at least LEAST_WORDS words that are known texts, and
    n_parts counts these. Null and empty texts have the digest of the empty form and no licence. Repeated rows each count;
    other columns are ignored. Known texts are a fixed table of a few kB; it is broadcast.

    A text without a licence so far has that of `whole` whose strict form is its own; else those of `whole` that its
    strict form has as a run of words count as parts.
    """
    spark = docs.sparkSession
    forms, runs = known_forms(spark, known, canonical), known_forms(spark, whole, strict)
    table = known_digests(spark, forms)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # only parts that can be known are digested
    parts = F.array_distinct(F.concat(F.split(text, r"\n[ \t\r]*\n"), F.split(text, "\n")))
    only = [f for _, f in forms]
    likely = F.when(may_have(text, only), F.filter(parts, lambda p: may_have(p, only))).otherwise(F.expr("cast(array() as array<string>)"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), likely.alias("parts"), _runs(text, runs).alias("runs"))
    canon = F.filter(F.transform("parts", canonical), lambda c: F.size(F.split(c, " ")) >= LEAST_WORDS)
    hashed = base.select("doc_id", "digest", "runs", F.transform(F.array_distinct(canon), lambda c: F.sha2(c.cast("binary"), 256)).alias("parts"))
    entries = [F.lit(v) for r in table.collect() for v in (r["digest"], r["license"])]  # a row for each known text
    index = F.create_map(*entries) if entries else F.create_map(F.lit(""), F.lit(None).cast("string"))
    joined = hashed.join(F.broadcast(table), "digest", "left")
    found = joined.withColumn("hits", F.filter(F.transform("parts", lambda d: F.try_element_at(index, d)), lambda x: x.isNotNull()))
    found = found.withColumn("inside", F.when(F.col("license").isNull() & F.col("runs.equal").isNull(), F.array_except("runs.inside", "hits")).otherwise(F.expr("cast(array() as array<string>)")))
    hits = F.concat("hits", "inside")
    return found.select(
        "doc_id", "digest", F.coalesce("license", "runs.equal").alias("license"), F.array_join(F.array_sort(F.array_distinct(hits)), ",").alias("part_licenses"), F.size(hits).cast("long").alias("n_parts")
    )


def _runs(text: Column, forms: list[tuple[str, str]]) -> Column:
    """A struct: equal, the licence whose form is the text's; inside, those whose forms are runs of its words."""
    none = F.expr("cast(named_struct('equal', null, 'inside', array()) as struct<equal:string,inside:array<string>>)")
    if not forms:
        return none
    form = F.array(strict(text))
    given = F.transform(
        form,
        lambda f: F.struct(
            F.coalesce(*[F.when(f == F.lit(t), F.lit(k)) for k, t in forms]).alias("equal"),
            F.array_distinct(F.array_compact(F.array(*[F.when(F.concat(F.lit(" "), f, F.lit(" ")).contains(F.lit(f" {t} ")), F.lit(k)) for k, t in forms]))).alias("inside"),
        ),
    )
    return F.when(may_have(text, [f for _, f in forms]), given[0]).otherwise(none)
