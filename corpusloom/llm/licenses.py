"""License scans by canonical digests: entire texts are normalised, hashed and joined to known licence digests.

Canonical form: lower case; lines that state a copyright, or just reserve all rights, go; words are runs of letters and
digits, joined by one space, so punctuation and layout vanish; equivalent spellings become one (``SPELLINGS`` for words,
``PAIRS`` for two words in a row). Its MD5 is the digest. Licences are known by their digests, so a scan costs one pass
over the texts and one hash join, whatever the number of licences.

Two scopes are looked up the same way, by one hash join each: the whole text of a document, and every line of it as a text of
its own (licence notices are often a line inside a longer text). The catalogue is broadcast where a count shows that it is
small, and shuffled beyond; nothing else depends on its size.

The catalogue has the full texts of the usual licences: short ones as text, long ones (``FULL``) as the digests of the texts
that their publishers distribute, whole and without the appendix on how to apply them.

Defined results: a null or empty text, or one that is empty in canonical form, has no licence and no digest. Ties between
catalogue entries with one digest go to the smallest name. Repeated rows get the same result. Notices are distinct, sorted
and joined by commas, empty where there are none. Texts are normalised whole. A null id is kept. Input columns that clash
with an output's name are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_texts, stored, without

#: A lower-cased line that goes: copyright with a sign or a year, a sign alone at its start, or the reservation of rights.
COPYRIGHT_LINE = r"[^a-z0-9]*(copyright.*(\(c\)|©|[12][0-9][0-9][0-9]).*|(\(c\)|©).*|all rights reserved[^a-z0-9]*)"
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "favour": "favor",
    "acknowledgement": "acknowledgment", "merchantibility": "merchantability", "ver": "version",
}
PAIRS = {("per", "cent"): "percent", ("sub", "license"): "sublicense", ("non", "commercial"): "noncommercial", ("copyright", "owner"): "copyright holder", ("copyright", "owners"): "copyright holders", ("creative", "commons"): "cc"}
OUTPUTS = ("license", "text_digest", "notices")
_WORD = re.compile(r"[^\W_]+")
_OUT = re.compile(COPYRIGHT_LINE)
_MARKS = ("copyright", "(c)", "©", "all rights reserved")

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_1 = "{}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_2 = "{}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "{}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <{}://unlicense.org{}>"""
#: Digests of long licences in canonical form.
FULL = {
    "Apache-2.0": "36ce57c2952d07c5a9ed523064d0f804 39f206909a66024181d3e6c8dfd32744 5cb409c2ede2989b7d6a122cab7404d3 6cef15927367ff93feb7cb934c6ff88e",
    "Artistic-1.0-Perl": "a8b0fb0c6e43a3b36bdc159e59dbfd1e",
    "CC0-1.0": "7bd2df471a15fa9e2128fe23cd1dc938",
    "GFDL-1.2": "c969fdb4b731dadf7173c1ffbe49a117",
    "GFDL-1.3": "31d35ae83fb445b95e49dcedb1f6f195",
    "GPL-1.0": "21fa8693acc5194a648fe02e11f65a72 738cc3b112640d95d4cd79a58967ecea dbf3c47f5a8f127e58d08cabc1ebb916",
    "GPL-2.0": "5e39ace6e62f5a7fe9c17b4da986ad8c 68380dbeadb093b94ecf563db7312db7 f2c06efe640b4a281cbe5337cdde80ab",
    "GPL-3.0": "17e434cc6db7003444b088cb4cc81e91 444f95dc767ede978b60cfb20fbd0bca 5eaa767cc0a56c87c3852144458a3bf1",
    "LGPL-2.0": "74cf7fcef3b29a39165a795b2cad3a3a 97832943be1e344d51af5aee1b658e4f c396ba2f94537628797123bc12cd2d6e",
    "LGPL-2.1": "3054b3781b1af43f906dc753acad15ee eaf6afb73fc860a002bfbccbe6f07ce7 f998bc436710cfece156aaa84fd26dd4",
    "LGPL-3.0": "b31b7335bc37919e8cdd79154e04d88d",
    "MPL-1.1": "0cfa0216ba5b85fd867e3535679d8c15 4c0c1f31c8f352bb1b1620fdd04f0339",
    "MPL-2.0": "35fb4d2625087f7fd780039aa7b4ebb2 7c36c1b44eeb25d52e81c020792b94d9",
}
_NAMES = {
    "MIT": ("MIT License", "MIT licence"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL-2.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
}
_FRAMES = ("{}", "Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This software is released under the {}", "Distributed under the {}", "SPDX-License-Identifier: {}")


def known_texts() -> list[tuple[str, str]]:
    """(name, text) of full licences and of the notices that name one."""
    full = [("MIT", head + MIT) for head in ("", "MIT License\n\n", "The MIT License\n\n", "The MIT License (MIT)\n\n")]
    full += [("ISC", head + ISC) for head in ("", "ISC License\n\n", "The ISC License\n\n")]
    for marks in (("", "", ""), ("1. ", "2. ", "3. ")):
        one, two, three = (c.format(m) for c, m in zip((_BSD_1, _BSD_2, _BSD_3), marks))
        full += [("BSD-2-Clause", head + _BSD_HEAD + one + two + _BSD_END) for head in ("", "BSD 2-Clause License\n\n", "The 2-Clause BSD License\n\n")]
        full += [("BSD-3-Clause", head + _BSD_HEAD + one + two + three + _BSD_END) for head in ("", "BSD 3-Clause License\n\n", "The 3-Clause BSD License\n\n")]
    full += [("Zlib", head + ZLIB) for head in ("", "zlib License\n\n", "The zlib/libpng License\n\n")]
    full += [("Unlicense", UNLICENSE.format(http, slash)) for http in ("http", "https") for slash in ("", "/")]
    return full + [(k, f.format(n)) for k, names in _NAMES.items() for n in names for f in _FRAMES]


def canonical_words(text: str) -> list[str]:
    """The words of lower-cased text, in their common spelling."""
    words = _WORD.findall(text)
    if not SPELLINGS.keys().isdisjoint(words):
        words = [SPELLINGS.get(w, w) for w in words]
    if not _FIRST.isdisjoint(words):
        out, i = [], 0
        while i < len(words):
            joined = PAIRS.get(tuple(words[i : i + 2]))
            out.append(joined or words[i])
            i += 2 if joined else 1
        words = out
    return words


_FIRST = {a for a, _ in PAIRS}


def body_lines(text: str) -> list[str]:
    """The lower-cased lines of a text without its copyright lines."""
    low = text.lower()
    lines = low.split("\n")
    if any(m in low for m in _MARKS):
        lines = [x for x in lines if not _OUT.fullmatch(x.strip())]
    return lines


def _digest(words: list[str]) -> str | None:
    return hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest() if words else None


def text_digest(text: str | None) -> str | None:
    return _digest(canonical_words("\n".join(body_lines(text)))) if text else None


class Normaliser:
    """Digests of whole texts (hex), and the distinct ones of their lines (bytes)."""

    def __call__(self, texts: list[str | None]) -> list:
        whole, lines = [], []
        for t in texts:
            body = body_lines(t) if t else []
            words = [_WORD.findall(x) for x in body]
            flat = [w for x in words for w in x]
            plain = SPELLINGS.keys().isdisjoint(flat) and _FIRST.isdisjoint(flat)
            whole.append(_digest(flat if plain else canonical_words("\n".join(body))))
            lines.append(sorted({bytes.fromhex(_digest(w if plain else canonical_words(x))) for x, w in zip(body, words) if w}))
        return [whole, lines]


def catalogue(spark: SparkSession, known: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license): one row for each digest of known texts."""
    rows = [(text_digest(text), name) for name, text in (known_texts() if known is None else known)]
    if known is None:
        rows += [(digest, name) for name, digests in FULL.items() for digest in digests.split()]
    return spark.createDataFrame([r for r in rows if r[0]], "digest string, license string").groupBy("digest").agg(F.min("license").alias("license"))


#: Digests up to which a catalogue is broadcast (about 100 bytes each).
BROADCAST_DIGESTS = 50_000


def scan(docs: DataFrame, known: DataFrame | None = None, text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Add license (of the whole text, or null), text_digest, and notices (licences of single lines)."""
    spark = docs.sparkSession
    known = catalogue(spark) if known is None else known.select("digest", "license").where("digest is not null and license is not null").groupBy("digest").agg(F.min("license").alias("license"))
    small = known.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS

    def beside(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df.hint("merge")

    names = docs.columns if carry is None else list(carry)
    kept = without(docs.select(*[docs[f"`{c}`"] for c in names]), OUTPUTS).columns
    found = free_name(docs.columns, "_found")
    row = free_name([*docs.columns, found], "_row")
    outs = [T.StructField("text_digest", T.StringType()), T.StructField(found, T.ArrayType(T.BinaryType()))]
    got = map_texts(docs, text_col, kept, outs, Normaliser)
    got = stored(got.withColumn(row, F.monotonically_increasing_id()), "digests")
    whole = known.select(F.col("digest").alias("text_digest"), "license")
    lines = got.select(row, F.explode(found).alias("digest")).join(beside(known.withColumn("digest", F.unhex("digest"))), "digest")
    lines = lines.groupBy(row).agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    out = got.join(lines, row, "left").join(beside(whole), "text_digest", "left").withColumn("notices", F.coalesce("notices", F.lit("")))
    return out.select(*[F.col(f"`{c}`") for c in kept], *OUTPUTS)
