"""Operator 3: licence scan by a positional rare-token index.

Template texts are indexed by word and position, and a first pass counts in how many documents each template word occurs.
In the second, each file looks up its `RAREST` licence words of highest IDF (then fewest places) among those that a
template's mandatory key phrase has; a file without one of the phrase's words has none of its template. Each of these
words' places, less where it stands in the template, are its postings of that template in the file; their intersection
are the places where all agree, and there the key phrase is verified word for word. A base phrase is a template that is
its own key phrase, so every place where its words stand consecutively is found.

A label beyond the base's needs `COVER` of its template's IDF in place. score: the largest such share of any verified
place. Words are runs of digits, letters and characters from U+0080, after lower-casing A-Z. Null or empty text: no words,
empty labels, score 0. Repeated rows: each has its row. Other columns are ignored. Empty table: no rows; all words
then count as equally rare. Very long texts: searched whole.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import UPPER, documents, texts_of

RAREST = 3  # words a file looks up of a template
COVER = 0.8  # IDF share of a template that must stand in place besides its key phrase


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str  # verified word for word
    base: bool = False


_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() and chr(b) not in UPPER else ord(chr(b).lower()) if chr(b) in UPPER else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def spaced(text: str) -> str:
    return b" ".join(words_of(text)).decode()


# fixed values: public licence texts, after their title and copyright lines
_GRANTED = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_CLAUSES_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_CLAUSE_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_DISCLAIMED = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""

TEMPLATES = (
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("gpl-text", "it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license"),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    Template("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "the software is provided as is without warranty of any kind"),
    Template("apache-text", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "software distributed under the license is distributed on an as is basis"),
    Template("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "distributed in the hope that it will be useful"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    Template("bsd-clause-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("bsl-1.0", "boost software license version 1 0 august 17th 2003", "boost software license version 1 0"),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    Template("artistic-2.0", "this library is free software distributed under the terms of the artistic license 2 0", "artistic license 2 0"),
    Template("spdx", "spdx license identifier", "spdx license identifier"),
    Template("mit-whole", spaced(_GRANTED), "permission is hereby granted free of charge"),
    Template("isc-whole", spaced(_ISC), "permission to use copy modify and or distribute this software"),
    Template("bsd-2-clause-whole", spaced(_CLAUSES_2 + _DISCLAIMED), "redistribution and use in source and binary forms"),
    Template("bsd-3-clause-whole", spaced(_CLAUSES_2 + _CLAUSE_3 + _DISCLAIMED), "may be used to endorse or promote products derived from this software"),
    Template("zlib-whole", spaced(_ZLIB), "in no event will the authors be held liable for any damages"),
    Template("unlicense-whole", spaced(_UNLICENSE), "free and unencumbered software"),
    Template("apache-2.0-notice", spaced(_APACHE), "apache license version 2 0"),
    Template("gpl-3.0-notice", spaced(_GPL), "terms of the gnu general public license"),
)

class Index:
    """Postings word -> (template, position) of the templates' key phrases, with the IDF of every template word."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[str, float]):
        self.templates = templates
        self.words = [t.text.encode().split() for t in templates]
        self.keys = [t.key.encode().split() for t in templates]
        self.key_at = [next(i for i in range(len(w)) if w[i : i + len(k)] == k) for w, k in zip(self.words, self.keys, strict=True)]
        self.needed = [frozenset(k) for k in self.keys]
        self.idf = {w: idf.get(w.decode(), 1.0) for words in self.words for w in words}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for n, key in enumerate(self.keys):
            for at, w in enumerate(key, self.key_at[n]):
                self.postings[w].append((n, at))
        self.vocabulary = frozenset(self.postings)

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, start) where the file's rarest words of the template agree."""
        have = self.vocabulary.intersection(words)
        due = [n for n, need in enumerate(self.needed) if need <= have]
        if not due:
            return []
        wanted: dict[bytes, list[int]] = {w: [] for n in due for w in self.needed[n]}
        for p, w in enumerate(words):
            if w in wanted:
                wanted[w].append(p)
        out = []
        for n in due:
            rarest = sorted(self.needed[n], key=lambda w: (-self.idf[w], len(wanted[w]), w))[:RAREST]
            starts = None
            for w in rarest:  # the file's postings of the template by this word
                here = {p - at for m, at in self.postings[w] if m == n for p in wanted[w]}
                starts = here if starts is None else starts & here
                if not starts:
                    break
            out += [(n, start) for start in sorted(starts)]
        return out

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases, their labels, all labels, score."""
        starts, base, labels, score = [], set(), set(), 0.0
        for n, start in self.places(words):
            t, at, key = self.templates[n], start + self.key_at[n], self.keys[n]
            if at < 0 or words[at : at + len(key)] != key:
                continue
            idf = [self.idf[w] for w in self.words[n]]
            share = sum(x for k, x in enumerate(idf) if 0 <= start + k < len(words) and words[start + k] == self.words[n][k]) / (sum(idf) or 1.0)
            score = max(score, min(share, 1.0))
            if t.base:
                starts.append(start)
                base.add(t.label)
            elif share < COVER:
                continue
            labels.add(t.label)
        return starts, base, labels, score


def document_frequency(df: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """In how many documents each template word occurs; as many rows as the templates have words."""
    wanted = {w.encode() for w in vocabulary}

    def count(batches):
        seen: Counter = Counter()
        for _, texts in texts_of(batches):
            for text in texts:
                seen.update(wanted.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    found = df.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in found.collect()}


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = {w for t in templates for w in t.text.split()}
    seen = document_frequency(rows.select("text"), vocabulary)
    most = max(seen.values(), default=0)
    index = Index(templates, {w: 1.0 + math.log((1 + most) / (1 + seen.get(w, 0))) for w in vocabulary})

    def scan(batches):
        for batch, texts in texts_of(batches):
            out = []
            for text in texts:
                words = words_of(text)
                starts, base, labels, score = index.scan(words)
                out.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return rows.mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op3_license_scan(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir))


QUERIES = {"op3_license_scan": op3_license_scan}
SQL: dict[str, str] = {}
