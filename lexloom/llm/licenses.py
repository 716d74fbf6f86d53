"""Licence scans with a positional rare-token index.

The words of every template and phrase have an inverse document frequency over all
documents. The index holds the rarest words of each template with their positions: two
places more than a match may miss, so a match holds two of them at least. A file looks up
its own occurrences of such words; each posting proposes where the template would start,
and places on which two fall are verified: at a phrase, every word must stand at its
relative position; at a template, the share of matching words is its score and its
mandatory key phrases must stand within reach. A phrase is indexed by its rarest word
alone, so each of its places is found.

Licences are given by their sentences, each a template, so that a body with sentences
left out, put in or reworded is still met by the others.

Defined cases: a null or empty text has no words and no matches, score 0; words of
documents that don't occur in the index play no part; an empty table gives an empty
table; repeated rows get the same result; other columns pass through, and one named like
an output column gives way to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm._common import add_columns, as_bytes, column_of, documents, small_batches

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Exact phrases: label and words.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Templates: label, words, mandatory key phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ["permission is hereby granted", "without restriction"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["in compliance with the license", "apache org licenses"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license", "version 2"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["general public license", "free software foundation"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy", "is hereby granted"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["public domain", "cc0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice", "substantial portions of the software"]),
    ("mit", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["publish distribute sublicense", "copies of the software"]),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise", ["authors or copyright holders", "action of contract"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["distributed under the license", "warranties or conditions of any kind"]),
    ("apache-2.0", "see the license for the specific language governing permissions and limitations under the license", ["specific language governing permissions"]),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ["in the hope that it will be useful", "without any warranty"]),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", ["received a copy of the gnu general public license"]),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", ["gnu lesser general public license"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code", "following disclaimer"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form", "following disclaimer"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products", "specific prior written permission"]),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", ["this permission notice appear in all copies"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["express or implied warranty", "authors be held liable"]),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ["altered source versions", "plainly marked"]),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["copy of the mpl", "mozilla org mpl"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", ["anyone is free to copy", "compiled binary"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial"]),
]
#: Licences by identifier and name: each gives a template of how headers state the one and of
#: how sentences state the other.
NAMED = {
    "0BSD": "bsd zero clause license", "AFL-3.0": "academic free license v3 0", "AGPL-3.0": "gnu affero general public license version 3", "Apache-2.0": "apache license 2 0", "Artistic-2.0": "artistic license 2 0",
    "BSD-2-Clause": "bsd 2 clause license", "BSD-3-Clause": "bsd 3 clause license", "BSL-1.0": "boost software license", "CC0-1.0": "creative commons zero", "CC-BY-4.0": "creative commons attribution 4 0",
    "CC-BY-SA-4.0": "creative commons attribution share alike 4 0", "CC-BY-NC-4.0": "creative commons attribution non commercial 4 0", "CC-BY-ND-4.0": "creative commons attribution no derivatives 4 0",
    "CDDL-1.0": "common development and distribution license", "CECILL-2.1": "cecill free software license", "ECL-2.0": "educational community license", "EPL-1.0": "eclipse public license 1 0", "EPL-2.0": "eclipse public license 2 0",
    "EUPL-1.2": "european union public licence", "GFDL-1.3": "gnu free documentation license", "GPL-2.0": "gnu general public license version 2", "GPL-3.0": "gnu general public license version 3", "ISC": "isc license",
    "LGPL-2.1": "gnu lesser general public license version 2 1", "LGPL-3.0": "gnu lesser general public license version 3", "LPPL-1.3c": "latex project public license", "MIT": "mit license", "MPL-2.0": "mozilla public license 2 0",
    "MS-PL": "microsoft public license", "NCSA": "university of illinois ncsa open source license", "ODbL-1.0": "open data commons open database license", "OFL-1.1": "sil open font license", "OSL-3.0": "open software license 3 0",
    "PostgreSQL": "postgresql license", "Python-2.0": "python software foundation license", "Unlicense": "the unlicense", "UPL-1.0": "universal permissive license", "WTFPL": "do what the fuck you want to public license", "Zlib": "zlib license",
}


def named_templates(named: dict[str, str] = NAMED) -> list[tuple[str, str, list[str]]]:
    """Templates by rule. The mandatory phrase holds the whole identifier or name, so that one
    licence's statement isn't taken for another's."""
    out = []
    for i, name in named.items():
        words = b" ".join(words_of(i)).decode()
        out.append((i.lower(), f"spdx license identifier {words}", [f"identifier {words}"]))
        out.append((i.lower(), f"licensed under the {name}", [name]))
    return out


#: Least share of a template's words at a place; how far a key phrase may stand from it.
LEAST, REACH = 0.7, 12


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(as_bytes(text).lower())


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[list[bytes]]
    exact: bool


def all_templates(phrases: dict[str, str] = PHRASES, templates: list | None = None) -> list[Template]:
    templates = [*TEMPLATES, *named_templates()] if templates is None else templates
    out = [Template(k, v.encode().split(), [], True) for k, v in phrases.items()]
    return out + [Template(a, w.encode().split(), [k.encode().split() for k in ks], False) for a, w, ks in templates]


def stands(words: list[bytes], phrase: list[bytes], lo: int, hi: int) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(max(0, lo), max(0, hi)))


class RareIndex:
    """Word -> postings (template, position) for the rarest words of each template."""

    def __init__(self, templates: list[Template], df: dict[bytes, int], n_docs: int):
        self.templates = templates
        self.idf = {w: math.log1p(n_docs / (1 + df.get(w, 0))) for t in templates for w in t.words}
        postings = defaultdict(list)
        for k, t in enumerate(templates):
            # A phrase needs one position of its rarest word; a template all positions of
            # so many words that a match, which may miss some, holds two.
            need = 1 if t.exact else min(len(t.words), math.floor((1 - LEAST) * len(t.words) + 1e-9) + 2)
            for w in sorted(set(t.words), key=lambda w: (-self.idf[w], w)):
                if need <= 0:
                    break
                at = [i for i, x in enumerate(t.words) if x == w]
                postings[w] += [(k, i) for i in (at[:1] if t.exact else at)]
                need -= len(at)
        self.postings = dict(postings)

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int, float, bool]]:
        """(label, first word, last word, score, exact) of verified places, in order."""
        known = self.postings
        at = [i for i, w in enumerate(words) if w in known]
        if not at:
            return []
        starts: Counter = Counter()
        for i in at:
            for k, p in known[words[i]]:
                starts[k, i - p] += 1
        found = []
        for (k, s), votes in starts.items():
            t = self.templates[k]
            n = len(t.words)
            if t.exact:
                if s >= 0 and words[s : s + n] == t.words:
                    found.append((t.label, s, s + n - 1, 1.0, True))
                continue
            if votes < min(2, len(t.words)):
                continue
            lo = max(0, s)
            same = sum(a == b for a, b in zip(words[lo : s + n], t.words[lo - s :], strict=False))
            if same >= LEAST * n and all(stands(words, key, s - REACH, s + n + REACH) for key in t.keys):
                found.append((t.label, lo, min(len(words), s + n) - 1, same / n, False))
        return sorted(found, key=lambda m: (m[1], m[0], m[2], m[4], m[3]))


def document_frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str) -> tuple[dict[bytes, int], int]:
    """How many documents hold each word of the templates, over all documents. The
    result is as large as the templates' vocabulary."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        n = 0
        for b in batches:
            for t in b["t"]:
                seen.update(vocabulary.intersection(words_of(t)))
                n += 1
        yield pd.DataFrame({"w": [*(w.decode() for w in seen), ""], "n": [*seen.values(), n]})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("t")).mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    got = {r["w"].encode(): r["n"] for r in rows}
    return got, got.pop(b"", 0)


MATCH = "array<struct<label string, first_word long, last_word long, score double, exact boolean>>"


def scan_licenses(docs: DataFrame, *, text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list | None = None) -> DataFrame:
    """docs with n_words and matches (label, first_word, last_word, score, exact)."""
    text_col = column_of(docs, text_col)
    known = all_templates(phrases, templates)
    df, n = document_frequencies(docs, {w for t in known for w in t.words}, text_col)
    index = docs.sparkSession.sparkContext.broadcast(RareIndex(known, df, n))

    def run(texts: list) -> list[list]:
        found, n_words = [], []
        for t in texts:
            words = words_of(t)
            n_words.append(len(words))
            found.append([dict(zip(("label", "first_word", "last_word", "score", "exact"), m, strict=True)) for m in index.value.scan(words)])
        return [n_words, found]

    return add_columns(docs, [text_col], run, {"n_words": "long", "matches": MATCH})


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = scan_licenses(docs).select("doc_id", "n_words", "matches", F.filter("matches", lambda m: m["exact"]).alias("base"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.col(c)["label"])), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base")["first_word"]).alias("first_word"), F.array_max(F.col("base")["first_word"]).alias("last_word"),
        labels("base").alias("base_labels"), labels("matches").alias("labels"),
        F.coalesce(F.array_max(F.col("matches")["score"]), F.lit(0.0)).alias("score"),
    )
