"""Licence scan: canonical digests of entire texts, joined with the digests of known licence texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigo.llm.common import by_batches, narrowed

#: Fixed values: (licence, whether it lets others use the text commercially, text), public licence texts and notices.
KNOWN: tuple[tuple[str, bool, str], ...] = (
    ("MIT", True, "Released under the MIT License."),
    ("MIT", True, "Licensed under the MIT License."),
    ("MIT", True, "This project is licensed under the MIT License."),
    ("MIT", True, """MIT License

Copyright (c) <year> <holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", True, "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", True, "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", True, """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-2.0", True, "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", True, "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", True, "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", True, "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", True, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", True, "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", True, "Licensed under the BSD 2-Clause License."),
    ("ISC", True, """Copyright <year> <holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("CC0-1.0", True, "Licensed under CC0 1.0."),
    ("CC-BY-4.0", True, "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", True, "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", False, "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", False, "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", False, "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-ND-4.0", True, "Licensed under CC BY-ND 4.0."),
)

#: Full texts and file headers, a file each, named LICENCE~FORM.txt; all of them let others use the text commercially.
KNOWN += tuple((f.name.split("~")[0], True, f.read_text("utf-8")) for f in sorted(
    resources.files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt"))

#: Spellings that count as the same, after punctuation has become blanks.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"),
             ("merchantibility", "merchantability"), ("noninfringment", "noninfringement"), ("non infringement", "noninfringement"),
             ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("https", "http"),
             ("percent", "per cent"), ("v", "version"))
#: A line that names a copyright holder: it begins with the word or the sign, and a sign, year or "by" follows.
COPYRIGHT = r"(^|\n)[ \t]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9<]|by )[^\n]*"
MARKS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


#: Units whose digests go back to Spark at a time.
BATCH_UNITS = 200_000

_COPYRIGHT = re.compile(COPYRIGHT.encode())
_BLANKED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def _doubled(words: str) -> str:
    """A spelling as it stands in a form whose words are set apart by two blanks."""
    return f" {words} ".replace(" ", "  ")[1:-1]


_SPELLINGS = [(_doubled(spelling).encode(), _doubled(plain).encode()) for spelling, plain in SPELLINGS]


def canonical(lowered: bytes) -> bytes:
    """Canonical form of a text given in lower case and UTF-8.

    Copyright lines and ASCII punctuation become blanks; words are set apart by two blanks while spellings are made
    equal, so that each word has blanks of its own.
    """
    if b"copyright" in lowered or b"(c)" in lowered or b"\xc2\xa9" in lowered:
        lowered = _COPYRIGHT.sub(b" ", lowered)
    form = b" " + b"  ".join(lowered.translate(_BLANKED).split()) + b" "
    for spelling, plain in _SPELLINGS:
        form = form.replace(spelling, plain)
    return form.replace(b"  ", b" ").strip(b" ")


def canonical_sql(text: str) -> str:
    """The canonical form as an SQL expression for DuckDB."""
    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    form = f"regexp_replace(lower({text}), {quoted(COPYRIGHT)}, ' ', 'g')"
    form = f"concat(' ', regexp_replace({form}, {quoted(MARKS)}, '  ', 'g'), ' ')"
    for spelling, plain in SPELLINGS:
        form = f"replace({form}, {quoted(_doubled(spelling))}, {quoted(_doubled(plain))})"
    return f"trim(replace({form}, '  ', ' '))"


def known_digests(spark: SparkSession, known: Sequence[tuple[str, bool, str]] = KNOWN) -> DataFrame:
    """(digest binary, licence, commercial) of known texts; of texts with one canonical form the first name counts."""
    named: dict[bytes, tuple[str, bool]] = {}
    for licence, commercial, text in known:
        digest = hashlib.md5(canonical(text.lower().encode())).digest()
        named[digest] = min(named.get(digest, (licence, commercial)), (licence, commercial))
    rows = [(bytearray(d), *v) for d, v in named.items()]
    return F.broadcast(spark.createDataFrame(rows, "digest binary, licence string, commercial boolean"))  # rows of the driver


def unit_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, digest): of the entire text as unit 0 and of its lines as 1, 2, ...; none where nothing is left."""
    def work(batch):
        ids, places, numbers, digests = batch.column(0), [], [], []

        def rows():
            return ids.take(pa.array(places, pa.int64())), pa.array(numbers, pa.int64()), pa.array(digests, pa.binary())

        for i, text in enumerate(batch.column(1)):
            lowered = text.as_py().lower().encode()
            for unit, body in enumerate((lowered, *lowered.split(b"\n"))):
                form = canonical(body)
                if form:
                    places.append(i)
                    numbers.append(unit)
                    digests.append(hashlib.md5(form).digest())
            if len(places) > BATCH_UNITS:
                yield rows()
                places, numbers, digests = [], [], []
        yield rows()

    return by_batches(narrowed(docs), work, "doc_id long, unit long, digest binary")


def licence_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, unit, licence, commercial): every entire text and every line that is a known licence text.

    Texts are equal when their canonical forms are. Null and empty texts, and texts of punctuation alone, match nothing.
    Ids are passed on as they are, null and repeated ones too; an empty table gives no rows.
    """
    return unit_digests(docs).join(known, "digest").select("doc_id", "unit", "licence", "commercial")
