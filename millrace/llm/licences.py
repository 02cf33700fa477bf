"""Licence scans by canonical digest lookup."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .licence_texts import PUBLISHED

#: A copyright notice: a line that begins with the word or a mark, which a year, a placeholder of one or a mark follows.
#: Other lines that begin with the word, such as wrapped sentences of a licence, stay.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*(copyright[ \t:,]*(\(c\)|©|[<\[{(]|[0-9]{4})|(\(c\)|©)[ \t:,]*(copyright|[<\[{(]|[0-9]{4}))[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
LINE_ENDS = r" *\n[ \n]*"
#: Spellings that the matching guidelines of public licence lists treat as equal, on words that are parted by one space or line end.
EQUIVALENT = [
    (r"licenc", "licens"), (r"sub([ \n])licens", r"sublicens\1"), (r"non([ \n])commercial", r"noncommercial\1"),
    (r"copyright([ \n])holder", r"copyright\1owner"), (r"organisation", "organization"), (r"favour", "favor"), (r"fulfilment", "fulfillment"), (r"whilst", "while"), (r"http([ \n])", r"https\1"),
]

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
"""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""


_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_FSF = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."


def _gnu(name: str, version: str, later: bool, end: str = ". If not, see <https://www.gnu.org/licenses/>.") -> str:
    tail = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by
the Free Software Foundation, {tail}.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
You should have received a copy of the {name} along with this program{end}"""


def _catalogue() -> list[tuple[str, str]]:
    mit = f"{_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_WARRANTY}"
    out = [
        ("MIT", mit), ("MIT", "MIT License\n" + mit), ("MIT", "The MIT License (MIT)\n" + mit), ("MIT-0", f"{_GRANT}.\n{_WARRANTY}"),
        ("BSD-2-Clause", _BSD + _BSD_END), ("BSD-3-Clause", _BSD + _BSD3 + _BSD_END), *[(s, t.replace("1. ", "").replace("2. ", "").replace("3. ", "")) for s, t in (("BSD-2-Clause", _BSD + _BSD_END), ("BSD-3-Clause", _BSD + _BSD3 + _BSD_END))], ("Unlicense", _UNLICENSE), ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
        ("0BSD", f"{_ISC}.\n{_ISC_END}"), ("Apache-2.0", _APACHE), ("Zlib", _ZLIB), ("LicenseRef-all-rights-reserved", "All rights reserved."),
        ("GPL-2.0-or-later", _gnu("GNU General Public License", "2", True, _FSF)), ("GPL-2.0-or-later", _gnu("GNU General Public License", "2", True)), ("GPL-2.0-only", _gnu("GNU General Public License", "2", False, _FSF)), ("GPL-3.0-or-later", _gnu("GNU General Public License", "3", True)),
        ("LGPL-3.0-or-later", _gnu("GNU Lesser General Public License", "3", True)), ("AGPL-3.0-or-later", _gnu("GNU Affero General Public License", "3", True)),
    ]
    names = [
        ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"]),
        ("MIT", ["MIT License", "terms of the MIT License", "MIT/X11 License"]),
        ("BSD-3-Clause", ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"]), ("BSD-2-Clause", ["BSD 2-Clause License", "Simplified BSD License"]),
        ("GPL-2.0-only", ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL-2.0"]),
        ("GPL-3.0-only", ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0"]),
        ("LGPL-3.0-only", ["GNU Lesser General Public License, version 3", "LGPLv3"]), ("AGPL-3.0-only", ["GNU Affero General Public License, version 3", "AGPLv3"]),
        ("MPL-2.0", ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"]), ("ISC", ["ISC License"]), ("Unlicense", ["Unlicense"]), ("Zlib", ["zlib License"]),
    ]
    for parts in ("", "-NC", "-SA", "-ND", "-NC-SA", "-NC-ND"):
        words = "".join({"NC": "-NonCommercial", "SA": "-ShareAlike", "ND": "-NoDerivatives"}.get(p, "") for p in parts.split("-"))
        for v in ("2.0", "3.0", "4.0"):
            names.append((f"CC-BY{parts}-{v}", [f"CC BY{parts} {v}", f"Creative Commons Attribution{words} {v} International License", f"Creative Commons Attribution{words} {v} License"]))
    names.append(("CC0-1.0", ["CC0 1.0", "CC0 1.0 Universal"]))
    frames = ["Licensed under {}", "Licensed under the {}", "Released under the {}", "Released under {}", "Distributed under the {}", "This work is licensed under the {}", "This work is licensed under {}", "This work is licensed under a {}", "This software is licensed under the {}", "This project is licensed under the {}", "SPDX-License-Identifier: {}"]
    frames += ["All code is released under the {}", "Permission is granted under the terms of the {}", "Code is distributed under the {}", "Available under the {}", "See LICENSE for the {}"]
    return out + [(spdx, frame.format(name)) for spdx, all_ in names for name in [*all_, spdx] for frame in frames]


def canonical(text: str) -> str:
    """The canonical form of a text: words in lower case, parted by one space, or by one line end where a line ends."""
    text = regex.sub(COPYRIGHT_LINE, "", text.lower()).replace("&", " and ")
    text = regex.sub(LINE_ENDS, "\n", regex.sub(PUNCTUATION, " ", text)).strip(" \n")
    for a, b in EQUIVALENT:
        text = regex.sub(a, b, text)
    return text


#: Words at its beginning by which a known text is looked up.
ANCHOR = 3


@lru_cache(maxsize=1)
def known_licences() -> dict[str, tuple[str, int, str]]:
    """Digest → (licence, words, first words) of the canonical known texts; of equal texts the first counts."""
    out = {}
    for spdx, text in _catalogue():
        words = canonical(text).split()
        out.setdefault(hashlib.sha256(" ".join(words).encode()).hexdigest(), (spdx, len(words), " ".join(words[:ANCHOR])))
    for spdx, size, anchor, digest in PUBLISHED:
        out.setdefault(digest, (spdx, size, anchor))
    return out


#: Every known text holds one of these; other documents need not be looked at.
MARKERS = r"(?i)licen[sc]|permission|redistribution|rights\s+reserved|public\s+domain|software|[de]\s+under|available\s+under"


def licences_in(text: str) -> list[tuple[str, str, str]]:
    """(licence, scope, digest) of the known texts that are runs of whole lines of a text, each once, by digest."""
    known = known_licences()
    lengths: dict[str, list[int]] = _lengths()
    form = canonical(text)
    if not form:
        return []
    words, begins, ends = [], [], set()
    for line in form.split("\n"):
        begins.append(len(words))
        words += line.split(" ")
        ends.add(len(words))
    found = {}
    for at in begins:
        for n in lengths.get(" ".join(words[at : at + ANCHOR]), ()):
            if at + n in ends:
                digest = hashlib.sha256(" ".join(words[at : at + n]).encode()).hexdigest()
                if digest in known:
                    whole = n == len(words)
                    found[digest] = (known[digest][0], "document" if whole else "part", digest)
    return [found[d] for d in sorted(found)]


@lru_cache(maxsize=1)
def _lengths() -> dict[str, list[int]]:
    """The numbers of words of the known texts by their first words."""
    out: dict[str, set[int]] = {}
    for _, n, anchor in known_licences().values():
        out.setdefault(anchor, set()).add(n)
    return {a: sorted(n) for a, n in out.items()}


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, license, scope, digest) for every known licence text that a document is or holds.

    Entire texts are looked up by their digest. Case, punctuation, white space, copyright notices and equivalent spellings don't
    count, nor does how lines are wrapped: every run of whole lines that begins like a known text and has its number of words is digested, so that a
    licence of many paragraphs is found alone, below a heading or within a longer file. ``scope`` is document where nothing else is there, else
    part. The digests are a constant of the program, so the join with them takes place within the tasks; nothing is shuffled but the reports.

    A known text is reported once for a doc_id, also where rows or lines repeat it, with the wider scope; a known text within
    another one is reported too. Null ids count as one id. Null and empty texts hold none. An empty table gives an empty one; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *hit) for key, text in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in licences_in(text.as_py())]
            if rows:
                kinds = (batch.schema.field(0).type, pa.string(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "license", "scope", "digest"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    hits = narrow.where(F.col("text").rlike(MARKERS)).mapInArrow(run, "doc_id long, license string, scope string, digest string")
    return hits.groupBy("doc_id", "license", "digest").agg(F.min("scope").alias("scope")).select("doc_id", "license", "scope", "digest")


def licences_sql() -> str:
    """DuckDB SQL for ``scan_licences(documents)``: all runs of lines, by brute force."""
    form = f"replace(regexp_replace(lower(coalesce(text, '')), '{COPYRIGHT_LINE}', '', 'g'), '&', ' and ')"
    form = f"trim(regexp_replace(regexp_replace({form}, '{PUNCTUATION}', ' ', 'g'), '{LINE_ENDS}', '\n', 'g'), ' \n')"
    for a, b in EQUIVALENT:
        form = f"regexp_replace({form}, '{a}', '{b}', 'g')"
    values = ", ".join(f"('{d}', '{s}', {n})" for d, (s, n, _) in sorted(known_licences().items()))
    return f"""
    WITH known(digest, license, words) AS (VALUES {values}),
    f AS (SELECT doc_id, rid, {form} AS t FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
    l AS (SELECT doc_id, rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM f WHERE t <> ''),
    c AS (SELECT *, len(string_split(line, ' ')) AS n, sum(len(string_split(line, ' '))) OVER (PARTITION BY rid ORDER BY i) AS upto FROM l),
    p AS (SELECT a.doc_id, a.rid, a.i, b.i AS j, b.upto - a.upto + a.n AS words FROM c a JOIN c b ON a.rid = b.rid AND b.i >= a.i
          JOIN (SELECT DISTINCT words FROM known) k ON b.upto - a.upto + a.n = k.words),
    u AS (SELECT p.doc_id, p.rid, p.i, p.j, sha256(string_agg(c.line, ' ' ORDER BY c.i)) AS digest FROM p JOIN c ON c.rid = p.rid AND c.i BETWEEN p.i AND p.j GROUP BY p.doc_id, p.rid, p.i, p.j),
    w AS (SELECT rid, max(upto) AS total FROM c GROUP BY rid)
    SELECT doc_id, license, min(CASE WHEN known.words = total THEN 'document' ELSE 'part' END) AS scope, digest
    FROM u JOIN known USING (digest) JOIN w USING (rid) GROUP BY doc_id, license, digest
    """
