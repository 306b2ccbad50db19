"""Licence scans: whole texts, made canonical and hashed, are looked up among known licences' digests.

Canonical form: lower case, copyright lines dropped, equivalent spellings made one, everything but
letters and digits one blank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence comparison treats as equal (the second replaces the first).
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("copyright holder", "copyright owner"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("noncommercial", "non commercial"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"),
)

_ASIS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_ASIS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_ASIS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
#: Identifiers and texts of known licences and notices (public texts).
KNOWN = (
    ("MIT", f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_ASIS}"),
    ("MIT", f"MIT License\n{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_ASIS}"),
    ("MIT-0", f"{_MIT}. {_ASIS}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_ASIS}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_ASIS}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_ASIS}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_ASIS}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)

#: Digests of the canonical forms of longer licences' full texts, as Debian's common-licenses have them;
#: a second digest is of the text up to "END OF TERMS AND CONDITIONS".
FULL = (
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-1.0-only", "2b62a0899e7031347a9577241eb9b504d0eafb4d91b28e1f99580099701d0a1a"),
    ("GPL-1.0-only", "fb6d85b04cce9e961a8ac49322a422ceed03720cc44b403f8769a1966d803f0b"),
    ("GPL-2.0-only", "d3d1ea54d09952fcd9626a8c4c7c325e00c7f6febdc41bf004285919d6bfaa0a"),
    ("GPL-2.0-only", "c2043b33557c653c50c7526295a77726952cb3ecaffc4bfd33a9d0bd36a4fb38"),
    ("GPL-3.0-only", "68ca42869e9a3e25843be66c6f296ce2b1f3629ac71d77465db0636dc8781c06"),
    ("GPL-3.0-only", "df20d6920a2688bef2bb6fb95fc7472aa40799a7027c0ce468190c67658a9656"),
    ("LGPL-2.0-only", "1862ecc2c3c5e3b9e88481e95603c88e089c43e9d5702b2ec01391491b606a9e"),
    ("LGPL-2.0-only", "e29dcc167f8a363847b3c4b0a7ced67d7a2bb7b9112a3311b6877a9c0570d635"),
    ("LGPL-2.1-only", "ac0856eb11aebb30c08445444c942c1ddcde9d0a0447c9ed2b8a19ab7d51eba5"),
    ("LGPL-2.1-only", "2858f5a00f6672bd47f63b69b9bf4e1bc31f3541b08a5a263e59d9b384f72fdc"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("GFDL-1.2-only", "8446e2329e3fe2b35501056164a645d74fef33dc1b8a2a132629bf1935fa72e7"),
    ("GFDL-1.3-only", "961b6d8afa12e353079f8676ad28084c800a46123e76f7f4f7e7f81df82289dc"),
)

#: A whole line that states a copyright, with its year or holder; the licence's own sentences go on after the word.
COPYRIGHT_LINE = r"(?m)^[^\pL\pN\n]*(?:portions |all contributions )?(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©|[0-9]{4}|by |the regents|all rights)[^\n]*$|^[^\pL\pN\n]*all rights reserved[^\pL\pN\n]*$"


#: Equivalent spellings that are one word, and those of which a side is two.
_WORDS = {a: b for a, b in EQUIVALENT if " " not in a + b}
_PHRASES = tuple((a, b) for a, b in EQUIVALENT if " " in a + b)


def _where(c: Column, marks: tuple[str, ...], pattern: str, by: str) -> Column:
    """c with the pattern replaced, which is only tried where one of the marks is there: without it nothing fits."""
    found = c.contains(marks[0])
    for m in marks[1:]:
        found = found | c.contains(m)
    return F.when(found, F.regexp_replace(c, pattern, by)).otherwise(c)


def _once(c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c), with c worked out once however often it is used."""
    return F.element_at(F.transform(F.array(c), then), 1)


def canonical(text: Column) -> Column:
    """The canonical form; null gives an empty string.

    Spellings are made one token by token, so that neighbours never share a blank. Single words first: what they become
    may be part of a phrase. Each step is worked out only for texts that hold what it looks for.
    """
    same = F.create_map(*(F.lit(x) for kv in _WORDS.items() for x in kv))
    words = F.array(*map(F.lit, _WORDS))

    def spelt(c: Column) -> Column:
        tokens = F.split(c, " ")
        return F.when(F.arrays_overlap(tokens, words), F.array_join(F.transform(tokens, lambda w: F.coalesce(F.try_element_at(same, w), w)), " ")).otherwise(c)

    def phrase(a: str, b: str) -> Callable[[Column], Column]:
        return lambda c: _where(c, (a,), rf"(?<![^ ]){a}(?![^ ])", b)

    steps = [
        lambda c: _where(c, ("\r",), "\r\n?", "\n"),
        lambda c: _where(c, ("copyright", "(c)", "©", "all rights reserved"), COPYRIGHT_LINE, ""),
        lambda c: F.trim(F.regexp_replace(c, r"[^\pL\pN]+", " ")),
        spelt,
        *(phrase(a, b) for a, b in _PHRASES),
    ]
    out = F.lower(F.coalesce(text, F.lit("")))
    for step in steps:
        out = _once(out, step)
    return out


def known_licences(spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN, full: tuple[tuple[str, str], ...] = FULL) -> DataFrame:
    """(digest, licence) of the known texts and of the digests in full, each digest once."""
    df = spark.createDataFrame(list(texts), "licence string, text string").select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "licence")
    df = df.unionByName(spark.createDataFrame(list(full), "licence string, digest string"))
    return df.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """docs' doc_id, digest and licence (null if the whole text is none that is known), row for row.

    Null and empty texts have the digest of the empty form, which no licence has. Repeated rows stay.
    The built-in list has a fixed size and is sent to every task; a list of one's own is joined as
    Spark sees fit.
    """
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(canonical(F.col("text")), 256).alias("digest"))
    known = F.broadcast(known_licences(docs.sparkSession)) if known is None else known.groupBy("digest").agg(F.min("licence").alias("licence"))
    return hashed.join(known, "digest", "left").select("doc_id", "digest", "licence")
