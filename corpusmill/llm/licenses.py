"""Licence scan: canonical digests of whole texts, joined to the digests of known licences."""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices as their publishers give them (placeholders for names are in copyright lines).
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""
KNOWN = {
    "MIT": (_MIT, "MIT License\n\n" + _MIT, "The MIT License (MIT)\n\n" + _MIT, "Released under the MIT License."),
    "BSD-2-Clause": (_BSD_HEAD + _BSD_TAIL, "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    "BSD-3-Clause": (_BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    "ISC": (_ISC.format(", provided that the above copyright notice and this permission notice appear in all copies"), "ISC License\n\n" + _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    "0BSD": (_ISC.format(""), "BSD Zero Clause License\n\n" + _ISC.format("")),
    "Zlib": (_ZLIB, "zlib License\n\n" + _ZLIB),
    "WTFPL": (_WTFPL,),
    "Apache-2.0": (_APACHE_NOTICE, "Licensed under the Apache License, Version 2.0."),
    "GPL-3.0-or-later": (_GPL_NOTICE,),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
}

# The rules of canonical form, in order, in syntax that Java, RE2 and Python read alike.
#: Signs that stand for an ASCII one.
SIGNS = ("“”„‟«»‘’‚‛`´–—‒―− ©", "\"\"\"\"\"\"''''''----- ~")
#: Lines that only name a copyright or its notice.
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;.>-]*(copyright[ \t:]|copr\.|\(c\)|~|all rights reserved)[^\n]*"
#: What separates words: everything in ASCII but letters and digits, and white space.
BETWEEN = r"[^a-z0-9\x{80}-\x{10ffff}]+"
#: Spellings that licences treat as equal, as (pattern, replacement) over words apart by single spaces.
SPELLINGS = (
    (r"\b(sub ?)?licenc(e|es|ed|ing)\b", r"$1licens$2"),
    (r"\b(author|organ|recogn|custom|util|initial|standard)is(e|es|ed|ing|ation|ations)\b", r"$1iz$2"),
    (r"\b(col|fav|behavi|hon|lab|endeav)our", r"$1or"),
    (r"\bcopyright owner", r"copyright holder"),
    (r"\b(sub|non|per) (license|licensed|commercial|infringement|cent)\b", r"$1$2"),
    (r"\bhttps\b", r"http"),
)


def canonical(text) -> F.Column:
    """text in the form whose digest is compared; null counts as empty."""
    a, z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    c = F.translate(F.coalesce(text, F.lit("")), a + SIGNS[0], z + SIGNS[1])
    c = F.regexp_replace(c, COPYRIGHT_LINE, "\n")
    c = F.trim(F.regexp_replace(c, BETWEEN, " "))
    for pattern, to in SPELLINGS:
        c = F.regexp_replace(c, pattern, to)
    return c


def canonical_text(text: str) -> str:
    """The same form on the driver, for the few known texts."""
    c = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + SIGNS[0], "abcdefghijklmnopqrstuvwxyz" + SIGNS[1]))
    c = re.sub(COPYRIGHT_LINE, "\n", c)
    c = re.sub(BETWEEN.replace(r"\x{80}-\x{10ffff}", "\x80-\U0010ffff"), " ", c).strip(" ")
    for pattern, to in SPELLINGS:
        c = re.sub(pattern, lambda m, to=to: re.sub(r"\$(\d)", lambda k: m[int(k[1])] or "", to), c, flags=re.A)
    return c


def known_digests(known: dict[str, tuple[str, ...]] = KNOWN) -> list[tuple[str, str]]:
    """(digest, licence) for each known text; equal digests must name one licence."""
    pairs = {sha256(canonical_text(t).encode()).hexdigest(): k for k, texts in known.items() for t in texts}
    return sorted(pairs.items())


def digest_table(spark: SparkSession, known: dict[str, tuple[str, ...]] = KNOWN) -> DataFrame:
    return spark.sql("select * from values " + ", ".join(f"('{d}', '{k}')" for d, k in known_digests(known)) + " as t(digest, license)")


def license_scan(documents: DataFrame, digests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, canonical_chars, digest and license (null: none known) for every row of documents.

    Built of DataFrame functions only. The canonical form folds case, typographic signs, punctuation and
    white space, drops copyright lines and rewrites equivalent spellings; its SHA-256 is hash-joined to
    digests(digest, license), which is made distinct first, so that no row multiplies. A digest listed
    under several licences takes the first by name. Null and empty texts, and texts of punctuation alone,
    have an empty form and no licence. Repeated rows give repeated results; other columns are not read.
    Only ids, lengths and digests reach the join, never texts.
    """
    empty = sha256(b"").hexdigest()
    one = digests.where(F.col("digest") != empty).groupBy("digest").agg(F.min("license").alias("license"))
    rows = documents.select(F.col(id_col), canonical(F.col(text_col)).alias("__c")).select(id_col, F.length("__c").cast("long").alias("canonical_chars"), F.sha2(F.encode("__c", "UTF-8"), 256).alias("digest"))
    return rows.join(one, "digest", "left").select(id_col, "canonical_chars", "digest", "license")
