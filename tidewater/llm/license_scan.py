"""License scans by patience alignment (operator 1).

A template is aligned with a stretch of a text: words that occur once in both are anchors, the longest increasing
subsequence of their places is kept, and the gaps between kept anchors are aligned the same way; a gap without anchors by
its equal heads and tails.  Coverage is the
largest share of the template's words aligned inside a stretch of 1.5 template lengths.  Coverage alone doesn't tell
neighbouring licenses apart, so each template has keys (``KEYS``): word sequences, as names and versions, of which each
must be aligned whole, with nothing inserted, and a version must not go on (2 is not 2.1, but is 2.0).

A coverage of ``MIN_COVERAGE`` leaves out fewer than r = (1 - MIN_COVERAGE) * words + 1 of the template's words, so every
hit holds one of any r of them.  For each text the r words with the fewest occurrences are taken, and only stretches around
their places are aligned.

* Templates of up to ``EXACT`` words: every stretch that holds such a place, from one template word to another, no longer
  than allowed.  No hit is lost (other words at the ends of a stretch change nothing).
* Longer templates are laid on the text by the word's place in them, and the text there is aligned with half a template
  length to spare on both sides, for notices with inserted words, with an eighth, and with none, for notices that follow
  each other closely (their words are not unique in a wider stretch).  Then the text between accepted stretches is looked
  through in the same way by itself, until nothing more is found.  A long notice can be lost if words are inserted in it and
  the same words stand next to it, outside of any accepted stretch.

Defined cases: null and empty texts, and texts without a hit, have a null license, coverage 0 and no place; of several
hits the one with the most words aligned wins, then the larger coverage, then the name; ``hits`` has all of them, those of
one template without overlap, in order of their places, and ``n_licenses`` counts their names; repeated rows are scanned each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import slices, small_batches

MIN_COVERAGE = 0.8
#: Templates of so many words are aligned with every stretch around a place.
EXACT = 24
REACH = 1.5
SCHEMA = "doc_id long, license string, coverage double, n_aligned long, start long, end long, n_licenses long, "\
         "hits array<struct<license:string,coverage:double,n_aligned:long,start:long,end:long>>"
_WORD = re.compile(r"\w+")

#: License notices as published.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""",
    "mit": "Released under the MIT License.",
    "mit-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
}

#: Word sequences that tell a template from its neighbours' texts.
KEYS = {"apache-2.0": ["apache", "2 0"], "apache-2.0-notice": ["apache", "2 0"], "cc-by-nc-4.0": ["cc by nc 4 0"],
        "gpl-3.0": ["gnu general public license", "version 3"],
        "gpl-3.0-notice": ["gnu general public license", "version 3"], "mit": ["mit license"]}


def _add(name: str, text: str, *keys: str) -> None:
    if name not in TEMPLATES:
        TEMPLATES[name], KEYS[name] = text, [*keys]


def _add_neighbours() -> None:
    """Neighbouring licenses and versions, in the wordings of the templates above."""
    for v in ("1.0", "1.1"):
        _add(f"apache-{v}", f"Licensed under the Apache License, Version {v}.", "apache", v.replace(".", " "))
    parts = {"nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
    for kind in ("", "nc", "sa", "nd", "nc-sa", "nc-nd"):
        short = "-".join(["by", *filter(None, [kind])])
        full = "-".join(["Attribution", *(parts[k] for k in kind.split("-") if k)])
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            number = v.replace(".", " ")
            area = {"4.0": "International", "3.0": "Unported"}.get(v, "Generic")
            _add(f"cc-{short}-{v}", f"Licensed under CC {short.upper()} {v}.", f"cc {short.replace('-', ' ')} {number}")
            _add(f"cc-{short}-{v}-notice", f"This work is licensed under a Creative Commons {full} {v} {area} License.",
                 f"creative commons {full.lower().replace('-', ' ')} {number}")
    _add("cc0-1.0", "Released under CC0 1.0.", "cc0 1 0")
    notice = TEMPLATES["gpl-3.0-notice"]
    for name, title, v in (("gpl-1.0", "General", "1"), ("gpl-2.0", "General", "2"), ("gpl-3.0", "General", "3"),
                           ("lgpl-2.0", "Library General", "2"), ("lgpl-2.1", "Lesser General", "2.1"),
                           ("lgpl-3.0", "Lesser General", "3"), ("agpl-3.0", "Affero General", "3")):
        gnu, key, number = f"GNU {title} Public License", f"gnu {title.lower()} public license", v.replace(".", " ")
        _add(name, f"This work is licensed under the {gnu}, version {v}.", key, f"version {number}")
        _add(f"{name}-v", f"This work is licensed under the {gnu} v{v}.", f"{key} v{number}")
        _add(f"{name}-notice", notice.replace("GNU General Public License", gnu).replace("version 3", f"version {v}"), key,
             f"version {number}")
    for name, title, versions in (("mpl", "Mozilla Public", ("1.0", "1.1", "2.0")), ("epl", "Eclipse Public", ("1.0", "2.0")),
                                  ("artistic", "Artistic", ("1.0", "2.0")), ("bsl", "Boost Software", ("1.0",)),
                                  ("cddl", "Common Development and Distribution", ("1.0", "1.1")),
                                  ("eupl", "European Union Public", ("1.1", "1.2")), ("ofl", "SIL Open Font", ("1.0", "1.1"))):
        for v in versions:
            _add(f"{name}-{v}", f"Licensed under the {title} License, version {v}.", f"{title.lower()} license", v.replace(".", " "))
    _add("mpl-2.0-notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
         "mozilla public license", "2 0")
    for name, title in (("bsd", "BSD"), ("bsd-2-clause", "BSD 2-Clause"), ("bsd-3-clause", "BSD 3-Clause"),
                        ("bsd-4-clause", "BSD 4-Clause"), ("isc", "ISC"), ("zlib", "zlib"), ("mit-0", "MIT No Attribution")):
        _add(name, f"Released under the {title} License.", f"{title.lower().replace('-', ' ')} license")
    _add("unlicense", "Released under the Unlicense.", "unlicense")
    terms = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution."""
    advert = """All advertising materials mentioning features or use of this software must display the following
        acknowledgement:"""
    names = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission."""
    _add("bsd-2-clause-notice", f"{terms} THIS SOFTWARE IS PROVIDED", "with the distribution this software is provided")
    _add("bsd-3-clause-notice", f"{terms} {names}", "with the distribution neither the name")
    _add("bsd-3-clause-numbered-notice", f"{terms} 3. {names}", "with the distribution 3 neither the name")
    _add("bsd-4-clause-notice", f"{terms} {advert}", "all advertising materials")
    _add("isc-notice", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
         "with or without fee is hereby granted", "provided that the above copyright notice")


_add_neighbours()


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence of distinct numbers."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        j = bisect_left(tails, p)
        before[i] = at[j - 1] if j else -1
        tails[j:j + 1], at[j:j + 1] = [p], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Patience alignment: pairs of places (text, template), increasing in both."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        n = Counter(text[a:b])
        once = Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if n[w] == 1 and once.get(w) == 1}
        anchors = [(place[w], j) for j, w in enumerate(template[c:d], c) if w in place]
        if not anchors:  # words that repeat: equal heads and tails of the gap
            while a < b and c < d and text[a] == template[c]:
                out.append((a, c))
                a, c = a + 1, c + 1
            while a < b and c < d and text[b - 1] == template[d - 1]:
                b, d = b - 1, d - 1
                out.append((b, d))
            continue
        kept = [anchors[i] for i in increasing([i for i, _ in anchors])]
        out += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _apart(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches without overlap: most words first, then the shorter, then the earlier."""
    out: list[tuple[int, int, int]] = []
    ends: list[tuple[int, int]] = []  # accepted stretches in order
    for n, a, b in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])):
        i = bisect_left(ends, (a, b))
        if (i == 0 or ends[i - 1][1] < a) and (i == len(ends) or ends[i][0] > b):
            ends.insert(i, (a, b))
            out.append((n, a, b))
    return out


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE,
                 keys: dict[str, list[str]] = KEYS):
        self.min_coverage = min_coverage
        words = {name: _WORD.findall(t.lower()) for name, t in templates.items()}
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for t in words.values() for w in t))}
        self.templates = {name: [self.ids[w] for w in t] for name, t in words.items() if t}
        # of each template: per key its length, its places in the template, and if it ends in a number
        self.keys, self.key_words = {}, {}
        for name in self.templates:
            own = [_WORD.findall(k.lower()) for k in keys.get(name, [])]
            self.keys[name] = [(len(k), [j for j in range(len(words[name])) if words[name][j:j + len(k)] == k], k[-1][-1].isdigit())
                               for k in own]
            self.key_words[name] = frozenset(self.ids.get(w, -1) for k in own for w in k)

    def _keyed(self, pairs: list[tuple[int, int]], keys: list, goes_on: set[int]) -> list[list[tuple[int, int]]]:
        """Of each key: (text places of the first, last word) where it is aligned whole with nothing inserted."""
        text_at = {j: i for i, j in pairs}
        out = []
        for size, starts, number in keys:
            found = []
            for j in starts:
                i = text_at.get(j)
                if (i is not None and all(text_at.get(j + k) == i + k for k in range(size))
                        and not (number and i + size - 1 in goes_on)):
                    found.append((i, i + size - 1))
            out.append(found)
        return out

    def _stretches(self, text: list[int], name: str, goes_on: set[int], first: int, end: int) -> set[tuple[int, int, int]]:
        """(words aligned, first, last place) inside text[first:end] wherever the alignment covers enough, with all keys."""
        template, need = self.templates[name], self.min_coverage * len(self.templates[name])
        if end - first < need:
            return set()
        both = [(i + first, j) for i, j in align(text[first:end], template)]
        if len(both) < need:
            return set()
        keyed = self._keyed(both, self.keys[name], goes_on)
        if not all(keyed):
            return set()
        pairs, reach, low, out = [i for i, _ in both], int(REACH * len(template)) + 1, 0, set()
        for high, p in enumerate(pairs):
            while p - pairs[low] >= reach:
                low += 1
            n = high - low + 1
            if n >= need and all(any(a >= pairs[low] and b <= p for a, b in k) for k in keyed):
                out.add((n, pairs[low], p))
        return out

    def _exact(self, text: list[int], name: str, goes_on: set[int], seeds: list[int]) -> set[tuple[int, int, int]]:
        """Stretches of all windows that hold a seed."""
        m, own = len(self.templates[name]), set(self.templates[name])
        reach, need = int(REACH * m) + 1, self.min_coverage * m
        done: set[tuple[int, int]] = set()
        out: set[tuple[int, int, int]] = set()
        for p in seeds:
            left = [i for i in range(max(0, p - reach + 1), p + 1) if text[i] in own]
            right = [i for i in range(p, min(len(text), p + reach)) if text[i] in own]
            for x, a in enumerate(left):
                for y, b in enumerate(right):
                    if b - a < reach and len(left) - x + y >= need and (a, b) not in done:
                        done.add((a, b))
                        out |= self._stretches(text, name, goes_on, a, b + 1)
        return out

    def _laid(self, text: list[int], name: str, goes_on: set[int], start: int, end: int, laid: list[int]) -> set[tuple[int, int, int]]:
        """Stretches inside text[start:end] where the template is laid on it."""
        m = len(self.templates[name])
        step, out = max(1, m // 8), set()
        for spare in (m // 2, m // 8, 0):
            for at in sorted({x // step * step for x in laid} if spare else set(laid)):
                out |= self._stretches(text, name, goes_on, max(start, at - spare), min(end, at + m + spare + (step if spare else 0)))
        return out

    def _hits(self, text: list[int], places: dict[int, list[int]], name: str, goes_on: set[int]) -> list[tuple[int, int, int]]:
        """(words aligned, first, last place) of the stretches that cover enough of the template, without overlap."""
        template, m = self.templates[name], len(self.templates[name])
        spare = m - max(1, -int(-self.min_coverage * m // 1)) + 1  # any so many words meet every hit
        rare = sorted(range(m), key=lambda j: (len(places.get(template[j], ())), j))[:spare]
        if m <= EXACT:
            seeds = sorted({p for j in rare for p in places.get(template[j], ())})
            return _apart(self._exact(text, name, goes_on, seeds))
        seeded = sorted((p, p - j) for j in rare for p in places.get(template[j], ()))
        out, open_parts = [], [(0, len(text))]
        while open_parts:
            start, end = open_parts.pop()
            lo, hi = bisect_left(seeded, (start,)), bisect_left(seeded, (end,))
            if lo == hi or end - start < self.min_coverage * m:
                continue
            new = _apart(self._laid(text, name, goes_on, start, end, [x for _, x in seeded[lo:hi]]))
            if new:
                out += new
                edges = [(start, start), *sorted((a, b + 1) for _, a, b in new), (end, end)]
                open_parts += [(b, c) for (_, b), (c, _) in zip(edges, edges[1:], strict=False)]
        return out

    def scan(self, text: str | None) -> tuple:
        """license, coverage, n_aligned, start, end (characters), n_licenses, hits."""
        low = (text or "").lower()
        words = [self.ids.get(w, -1) for w in _WORD.findall(low)]
        places: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w >= 0:
                places[w].append(i)
        spans, goes_on, hits = None, set(), []
        for name, template in self.templates.items():
            if not self.key_words[name] <= places.keys():
                continue
            if sum(w in places for w in template) < self.min_coverage * len(template):
                continue
            if spans is None:
                spans = [m.span() for m in _WORD.finditer(low)]
                # words that a point and a number other than 0 follow at once
                goes_on = {i for i, ((_, a), (b, c)) in enumerate(zip(spans, spans[1:], strict=False))
                           if low[a:b] == "." and low[b:c].isdigit() and low[b:c].strip("0")}
            hits += [(-n, -n / len(template), name, a, b) for n, a, b in self._hits(words, places, name, goes_on)]
        if not hits:
            return None, 0.0, 0, None, None, 0, []
        told = [{"license": name, "coverage": -coverage, "n_aligned": -n, "start": spans[a][0], "end": spans[b][1]}
                for n, coverage, name, a, b in sorted(hits, key=lambda x: (x[3], x[4], x[2]))]
        n, coverage, name, first, last = min(hits)
        return name, -coverage, -n, spans[first][0], spans[last][1], len({h[2] for h in hits}), told


def scan_documents(docs: DataFrame, templates: dict[str, str] = TEMPLATES,
                   min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The best license and all hits of every row; one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_coverage)
        hit = pa.struct([("license", pa.string()), ("coverage", pa.float64()), *((n, pa.int64()) for n in ("n_aligned", "start", "end"))])
        kinds = [pa.string(), pa.float64(), *[pa.int64()] * 4, pa.list_(hit)]
        names = ["doc_id", "license", "coverage", "n_aligned", "start", "end", "n_licenses", "hits"]
        for b in slices(batches):
            columns = zip(*(scanner.scan(t) for t in b.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, columns, kinds)], names=names)

    return small_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
