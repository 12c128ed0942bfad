"""License scans with a generalised suffix automaton over the tokens of licence templates.

The automaton is built once from the templates (notices, identifiers, warranty paragraphs). Each file's tokens are
streamed through it, which gives matching statistics: for every token the longest stretch of some
template that ends there. Long matches of one template are chained into covered spans.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .text import as_bytes, slices

# Phrases whose places are always counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices by which texts state their licence.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by": ["Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "artistic-2.0": ["is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0"],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "released under the CC0 1.0 Universal Public Domain Dedication"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "eupl-1.2": ["Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL", "Licensed under the European Union Public Licence"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "wtfpl": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
}
# Identifiers of licences in source files, after SPDX_TAG, by label.
SPDX_TAG = "SPDX-License-Identifier: "
SPDX = {
    "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0", "AGPL-1.0"],
    "apache-2.0": ["Apache-2.0"],
    "artistic-2.0": ["Artistic-2.0"],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause"],
    "bsl-1.0": ["BSL-1.0"],
    "cc-by": ["CC-BY-4.0", "CC-BY-3.0"],
    "cc-by-nc": ["CC-BY-NC-4.0", "CC-BY-NC-3.0"],
    "cc-by-sa": ["CC-BY-SA-4.0", "CC-BY-SA-3.0"],
    "cc0": ["CC0-1.0"],
    "epl-2.0": ["EPL-2.0"],
    "eupl-1.2": ["EUPL-1.2"],
    "gpl": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-1.0", "GPL-2.0", "GPL-2.0+", "GPL-3.0", "GPL-3.0+"],
    "isc": ["ISC"],
    "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-2.0", "LGPL-2.0+", "LGPL-2.1", "LGPL-2.1+", "LGPL-3.0", "LGPL-3.0+"],
    "mit": ["MIT"],
    "mpl-2.0": ["MPL-2.0"],
    "unlicense": ["Unlicense"],
    "wtfpl": ["WTFPL"],
    "zlib": ["Zlib"],
}

# Names that licences go by after words such as "licensed under", by label.
LEADS = ["licensed under", "released under", "distributed under", "available under"]
NAMES = {
    "agpl": ["AGPLv3", "AGPL v3", "GNU AGPL"],
    "apache-2.0": ["Apache 2.0", "Apache License 2.0", "Apache-2.0"],
    "bsd": ["BSD license", "2-clause BSD", "3-clause BSD", "BSD 2-Clause", "BSD 3-Clause"],
    "gpl": ["GPLv2", "GPLv3", "GPL v2", "GPL v3", "GNU GPL", "GPL 2.0", "GPL 3.0", "GPL"],
    "lgpl": ["LGPLv2", "LGPLv3", "LGPL v2.1", "LGPL v3", "GNU LGPL", "LGPL"],
    "mit": ["MIT license", "MIT"],
    "mpl-2.0": ["MPL 2.0", "MPLv2", "Mozilla Public License 2.0"],
}

#: Maps A-Z to a-z, keeps a-z, 0-9 and all bytes of non-ASCII characters, and blanks the rest.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A match shorter than this many tokens starts no chain.
MIN_MATCH = 4
#: Tokens that may stand between two matches of one chain.
MAX_GAP = 8
#: Share of a notice that a chain must cover to carry its label; an identifier must be there as a whole.
MIN_COVER = 0.7
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<label:string,start:long,end:long>>"


def tokens(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """Suffix automaton of several token sequences; sequences count from 0 in the order they are added."""

    def __init__(self, sequences: list[list[bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]  # by state and sequence: where its strings end there, in order
        self.sizes = [len(s) for s in sequences]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in s] for s in sequences]
        for code in coded:
            last = 0
            for token in code:
                last = self._extend(last, token)
        for k, code in enumerate(coded):  # where each sequence passes; suffixes end there too
            state = 0
            for at, token in enumerate(code):
                state = self.next[state][token]
                above = state
                while above > 0:
                    self.ends[above].setdefault(k, []).append(at + 1)
                    above = self.link[above]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, parent: int, token: int) -> int:
        """The state of ``parent`` + token, cut off from a state that also holds longer strings."""
        child = self.next[parent][token]
        if self.length[child] == self.length[parent] + 1:
            return child
        copy = self._state(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(token) == child:
            self.next[parent][token] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and token not in self.next[last]:
            self.next[last][token] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, token)
        return new


class Scanner:
    def __init__(self) -> None:
        phrases = [tokens(p.encode()) for p in PHRASES]
        notices = [(label, tokens(text.encode())) for label, texts in TEMPLATES.items() for text in texts]
        tags = [(label, tokens((SPDX_TAG + name).encode())) for label, names in SPDX.items() for name in names]
        notices += tags
        #: Openings after which a name stands, the names by their first token (longest first), and whether names may be joined there.
        identifiers = [(label, t[len(tokens(SPDX_TAG.encode())) :]) for label, t in tags]
        spoken = [(label, tokens(name.encode())) for label, names in NAMES.items() for name in names]
        self.openings = [(tokens(SPDX_TAG.encode()), self.by_token(identifiers), True)] + [(tokens(lead.encode()), self.by_token(spoken), False) for lead in LEADS]
        self.n_phrases = len(phrases)
        self.least = [0.0] * len(phrases) + [MIN_COVER] * (len(notices) - len(tags)) + [1.0] * len(tags)
        self.names = [*PHRASES.values(), *(label for label, _ in notices)]
        self.automaton = a = Automaton(phrases + [t for _, t in notices])
        own = {}
        for k, phrase in enumerate(phrases):
            state = 0
            for word in phrase:
                state = a.next[state][a.vocabulary[word]]
            own[state] = k
        #: By state: the phrases that end there if the match is long enough.
        self.phrases: list[tuple[int, ...]] = [()] * len(a.next)
        for state in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            self.phrases[state] = self.phrases[a.link[state]] + ((own[state],) if state in own else ())

    @staticmethod
    def by_token(names: list[tuple[str, list[bytes]]]) -> dict[bytes, list[tuple[list[bytes], str]]]:
        found: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for label, name in sorted(names, key=lambda n: -len(n[1])):
            found.setdefault(name[0], []).append((name, label))
        return found

    def named(self, doc: list[bytes]) -> list[tuple[str, int, int]]:
        """Licences by name: identifiers after their tag, joined by OR and AND and with exceptions (WITH), and names after words such as "licensed under"."""
        spans = []
        for opening, names, joined in self.openings:
            at = -1
            while True:
                try:
                    at = doc.index(opening[-1], at + 1)
                except ValueError:
                    break
                start = at + 1 - len(opening)
                if start < 0 or doc[start : at + 1] != opening:
                    continue
                here = at + 1
                while here < len(doc):
                    if not joined and doc[here] in (b"the", b"a"):
                        here += 1
                        continue
                    name = next(((n, label) for n, label in names.get(doc[here], ()) if doc[here : here + len(n)] == n), None)
                    if name is None:
                        break
                    here += len(name[0])
                    spans.append((name[1], start, here))
                    if joined and doc[here : here + 1] == [b"with"]:  # an exception: some words up to the next joint
                        here = next((k for k in range(here + 1, min(here + 8, len(doc))) if doc[k] in (b"or", b"and")), len(doc))
                    if not joined or doc[here : here + 1] not in ([b"or"], [b"and"]):
                        break
                    here += 1
        return spans

    def run(self, codes: list[int], at: int, base: list[tuple[int, int]], matches: list[tuple[int, int, int]]) -> None:
        """Streams one stretch of template tokens that begins at word ``at``: its phrase places and maximal matches."""
        a = self.automaton
        following, link, length, sizes = a.next, a.link, a.length, a.sizes
        state = size = 0
        for i, token in enumerate(codes):
            if token not in following[state]:
                if size >= MIN_MATCH:
                    matches.append((at + i - size, at + i, state))
                while state and token not in following[state]:
                    state = link[state]
                size = length[state]
            if token in following[state]:
                state = following[state][token]
                size += 1
                for k in self.phrases[state]:
                    if size >= sizes[k]:
                        base.append((at + i + 1 - sizes[k], k))
        if size >= MIN_MATCH:
            matches.append((at + len(codes) - size, at + len(codes), state))

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
        """Spans of chained matches that cover enough of one notice, in its order.

        Notices of several licences are much alike. Where spans of two labels overlap by more than half of
        the shorter one, the one stays whose notice and span are covered better; equal ones both stay.
        """
        held: dict[int, list[int]] = {}  # by notice: start, end, covered tokens, end within the notice
        spans = []

        def close(k: int) -> None:
            start, end, covered, _ = held.pop(k)
            if covered >= self.least[k] * self.automaton.sizes[k]:
                spans.append((self.names[k], start, end, min(covered / self.automaton.sizes[k], covered / (end - start))))

        for start, end, state in matches:
            for k, places in self.automaton.ends[state].items():
                if k < self.n_phrases:
                    continue
                there = next((p for p in places if k in held and p > held[k][3]), places[0])
                if k in held and (start - held[k][1] > MAX_GAP or there <= held[k][3]):
                    close(k)
                    there = places[0]
                if k in held:
                    new = min(end - max(start, held[k][1]), there - held[k][3])
                    held[k] = [held[k][0], end, held[k][2] + new, there]
                else:
                    held[k] = [start, end, end - start, there]
        for k in list(held):
            close(k)
        spans.sort(key=lambda s: (s[1], s[2], s[0]))
        starts, longest, kept = [s[1] for s in spans], max((s[2] - s[1] for s in spans), default=0), []
        for label, start, end, share in spans:
            near = spans[bisect_left(starts, start - longest) : bisect_left(starts, end)]
            if not any(o[0] != label and o[3] > share and 2 * (min(end, o[2]) - max(start, o[1])) > min(end - start, o[2] - o[1]) for o in near):
                kept.append((label, start, end))
        return sorted(set(kept), key=lambda s: (s[1], s[2], s[0]))

    def scan(self, batch: pa.RecordBatch) -> dict[str, list]:
        words = [tokens(t or b"") for t in batch.column("text").to_pylist()]
        counts = np.array([len(w) + 1 for w in words])  # a gap after each text
        code = self.automaton.vocabulary.get
        codes = np.array([c for doc in words for c in (*[code(w, -1) for w in doc], -1)], np.int64)
        known = np.flatnonzero(np.diff(np.concatenate([[0], (codes >= 0).astype(np.int8), [0]])))
        begins = np.cumsum(counts) - counts
        base: list[list] = [[] for _ in words]
        matches: list[list] = [[] for _ in words]
        starts, ends = known[::2], known[1::2]
        long = ends - starts >= 2  # the shortest phrase has two words
        for start, end, doc in zip(starts[long].tolist(), ends[long].tolist(), (np.searchsorted(begins, starts[long], "right") - 1).tolist(), strict=True):
            self.run(codes[start:end].tolist(), start - int(begins[doc]), base[doc], matches[doc])
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for doc, places, found in zip(words, base, matches, strict=True):
            spans = sorted({*(self.chains(found) if found else []), *self.named(doc)}, key=lambda s: (s[1], s[2], s[0]))
            base_labels = {self.names[k] for _, k in places}
            covered = {i for _, start, end in spans for i in range(start, end)} | {i for start, k in places for i in range(start, start + self.automaton.sizes[k])}
            out["n_words"].append(len(doc))
            out["n_base"].append(len(places))
            out["first_word"].append(min((p for p, _ in places), default=None))
            out["last_word"].append(max((p for p, _ in places), default=None))
            out["base_labels"].append(sorted(base_labels))
            out["labels"].append(sorted(base_labels | {s[0] for s in spans}))
            out["score"].append(len(covered) / len(doc) if doc else 0.0)
            out["spans"].append([{"label": a, "start": b, "end": c} for a, b, c in spans])
        return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()), "score": pa.float64(), "spans": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))}
    for batch in slices(batches):
        found = scanner.scan(batch)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[k], t) for k, t in types.items())], ["doc_id", *types])


def scan_licenses(documents: DataFrame) -> DataFrame:
    """One row per document: base places, labels, covered spans (in words, end exclusive) and the covered share.

    ``documents`` needs doc_id and text; others are ignored. A null or empty text has no words, no
    labels and score 0. Repeated rows each give a row, doc_id keeps its type; an empty table gives an empty table.
    """
    schema = StructType([documents.schema["doc_id"], *_parse_datatype_string(SCHEMA)])
    return documents.select("doc_id", as_bytes("text")).mapInArrow(_scan, schema)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score",
        F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string")))).alias("spans"),
    )
