"""Licence scans by canonical digest.

A text is brought to a canonical form: ASCII lower case, copyright lines dropped,
equivalent spellings made one, punctuation and white space single blanks. Its SHA-256 is
joined to the digests of known licences; lines are looked up likewise as short notices. Everything is
DataFrame expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs of an equivalent spelling (pattern over lower-case text) and the one kept.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("copyright holder", "copyright owner"),
    ("http:", "https:"),
    ("[(]c[)]|©", "copyright"),
    ("(copyright )+", "copyright "),
]
#: White space, which is one blank before spellings are made one.
BLANKS = r"[\t-\r ]+"
#: Lines that name an owner and a year or a place to fill in, and bare reservations.
COPYRIGHT_LINE = r"^[^a-z0-9©]*(copyright|[(]c[)]|©)[^a-z]*([0-9]{4}|[(]c[)]|©|\[|<|\{)|^[^a-z]*all rights reserved[^a-z]*$"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Licence texts and one-line notices by identifier. The number of known texts bounds what is broadcast.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("ISC", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_END}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_HEAD}\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_THIRD}\n{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_HEAD}\n{_BSD_THIRD}\n{_BSD_END}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]

#: Canonical digests of further entire licence texts, as GNU/Linux distributions ship them.
KNOWN_DIGESTS = [
    ("Apache-2.0", "3c93005c1361582a748bd291a4ae484ba70108e2075fec9a011ec57572f4fcbf"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "bd8e32052e49e6b79fccbdd5dc03f7d40e45a8e895e3ecb79394b97961ffb127"),
    ("GFDL-1.3", "e7579a53c7b8214f091590d94bfe39deb978a080895ca5506448b8baf4f77985"),
    ("GPL-1.0", "9fc51630274b560110a2b3d58ab2aadc088f649116f9b2f6df26148eba715369"),
    ("GPL-2.0", "c43ff39ca549b577203468ca51a15c9554b22935ab38398641f8f94fc2ec7ee2"),
    ("GPL-3.0", "8387237b1a6d933dd54f687ff9e67d3b255e1cbd530ca27acff62bcae8a34d50"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbf8a79979c94b47092c8b5f097c9499b7c33e91ab50216a663f180fbe2ecd1e"),
    ("MPL-2.0", "c6a506eb968bd2cfbb1ea819736390e6ef797bab6d08beb74875c8a0dbc1d917"),
]

_CAPITALS = "".join(map(chr, range(65, 91)))


def _plain(lower_text: Column) -> Column:
    lower_text = F.regexp_replace(lower_text, BLANKS, " ")  # spellings of two words may span a line's end
    for pattern, kept in SPELLINGS:
        lower_text = F.regexp_replace(lower_text, pattern, kept) if any(c in pattern for c in "[(|") else F.replace(lower_text, F.lit(pattern), F.lit(kept))
    return F.trim(F.regexp_replace(lower_text, r"[^\p{L}\p{N}]+", " "))


def canonical(text: Column) -> Column:
    """The canonical form of a text; null and blank texts are empty."""
    lower_text = F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _CAPITALS.lower())
    lines = F.filter(F.split(lower_text, "\n", -1), lambda x: ~x.rlike(COPYRIGHT_LINE))
    return _plain(F.array_join(lines, " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(digest, license)`` of the known texts (and, unless some are given, of KNOWN_DIGESTS); a digest that two licences share goes to the first by name."""
    rows = spark.createDataFrame(known or KNOWN, "license string, text string").select(F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"), "license")
    if known is None:
        rows = rows.unionByName(spark.createDataFrame(KNOWN_DIGESTS, "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def gate_words(notices: list[str]) -> list[str] | None:
    """Words of which every notice has one, whatever its spelling: few words for many notices first; None if a notice has none.

    A line without any of them cannot be one of the notices, so it need not be hashed.
    """
    spelled = " ".join(x for pair in SPELLINGS for x in pair)
    left = [{w for w in re.findall("[a-z0-9]+", n.translate(str.maketrans(_CAPITALS, _CAPITALS.lower()))) if len(w) > 1 and w not in spelled and not any(p in w for p, _ in SPELLINGS)} for n in notices]
    out: list[str] = []
    while left:
        words = sorted(set().union(*left), key=lambda w: (-sum(w in n for n in left), -len(w), w))
        if not words or not all(left):
            return None
        out.append(words[0])
        left = [n for n in left if words[0] not in n]
    return out


def scan(df: DataFrame, text: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``df`` with ``license_digest``, ``license`` (of the entire text, else null) and ``notices``.

    ``notices`` holds the licences of lines that are known texts by themselves, distinct and sorted.
    Each row is judged by itself: nulls (an empty text, no licence), repeated rows and ties need nothing special; columns
    named like the results are replaced; an empty table gives no rows, and texts of any length are read whole. The join is to a broadcast table of the known texts, and a line is hashed only if
    a word that every one-line text shares with another is in it, so no text is moved.
    """
    digests = known_digests(df.sparkSession, known)
    table = {r["digest"]: r["license"] for r in digests.collect()}  # as many as known texts
    out = df.drop("license_digest", "license", "notices").withColumn("license_digest", F.sha2(canonical(F.col(text)).cast("binary"), 256))
    out = out.join(F.broadcast(digests.withColumnRenamed("digest", "license_digest")), "license_digest", "left")
    by_digest = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    lower_text = F.translate(F.coalesce(F.col(text), F.lit("")), _CAPITALS, _CAPITALS.lower())
    words = gate_words([t for _, t in known or KNOWN if "\n" not in t])
    lines = F.split(lower_text, "\n", -1)
    if words is not None:
        lines = F.filter(lines, lambda x: x.rlike(f"\\b({'|'.join(words)})\\b") if words else F.lit(False))
    named = F.transform(lines, lambda x: F.try_element_at(by_digest, F.sha2(_plain(x).cast("binary"), 256)))
    return out.withColumn("notices", F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull()))))
