"""License wording: base phrases and template-markup matching.

A template is plain wording with three kinds of markup: `<<optional>> ... <<end>>`
may be missing as a whole, of `<<either>> ... <<or>> ... <<end>>` one side stands,
and `<<any N>>` stands for up to N words of free choice (names, list numbers).
Notices are the sentences that name a license; licenses are whole, with their
conditions and their disclaimer as mandatory wording. A template is compiled to an automaton over words whose states are the bits of
one integer, so that all optional ways through it advance together. A text is
accepted only where the whole mandatory wording stands; the two words that
begin each template find the places where the automaton has to start.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgemeter.llm import arrays

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Wording of licenses and of statements that name one.
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and"
    " associated documentation files <<optional>>the software<<end>> to deal in the software without"
    " restriction including without limitation the rights to use copy modify merge publish distribute"
    " sublicense and or sell copies of the software and to permit persons to whom the software is"
    " furnished to do so subject to the following conditions <<any 1>> the above copyright notice and this"
    " permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or"
    " substantial portions of the software the software is provided as is without warranty of any kind"
    " express or implied including but not limited to the warranties of merchantability fitness for a"
    " particular purpose and <<either>>noninfringement<<or>>non infringement<<end>> in no event shall"
    " <<any 12>> be liable for any claim damages or other liability whether in an action of contract tort"
    " or otherwise arising from out of or in connection with the software or the use or other dealings in"
    " the software"
)
_ISC = (
    "permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with"
    " or without fee is hereby granted provided that the above copyright notice and this permission notice"
    " appear in all copies the software is provided as is and <<any 8>>"
    " <<either>>disclaims<<or>>disclaim<<end>> all warranties with regard to this software including all"
    " implied warranties of merchantability and fitness in no event shall <<any 8>> be liable for any"
    " special direct indirect or consequential damages or any damages whatsoever resulting from loss of"
    " use data or profits whether in an action of contract negligence or other tortious action arising out"
    " of or in connection with the use or performance of this software"
)
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided"
    " that the following conditions are met <<any 1>> redistributions of source code must retain the above"
    " copyright notice this list of conditions and the following disclaimer <<any 1>> redistributions in"
    " binary form must reproduce the above copyright notice this list of conditions and the following"
    " disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_NAMES = (
    "<<any 1>> neither the <<either>>name<<or>>names<<end>> of <<any 12>> nor the names of"
    " <<either>>its<<or>>their<<or>>any<<end>> contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission"
)
_BSD_DISCLAIMER = (
    "this software is provided by <<any 12>> as is and any express or implied warranties including but not"
    " limited to the implied warranties of merchantability and fitness for a particular purpose are"
    " disclaimed in no event shall <<any 12>> be liable for any direct indirect incidental special"
    " exemplary or consequential damages including but not limited to procurement of substitute goods or"
    " services loss of use data or profits or business interruption however caused and on any theory of"
    " liability whether in contract strict liability or tort including negligence or otherwise arising in"
    " any way out of the use of this software even if advised of the possibility of such damage"
)
_ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will"
    " <<any 8>> be held liable for any damages arising from the use of this software permission is granted"
    " to anyone to use this software for any purpose including commercial applications and to alter it and"
    " redistribute it freely subject to the following restrictions <<any 1>> the origin of this software"
    " must not be misrepresented you must not claim that you wrote the original software if you use this"
    " software in a product an acknowledgment in the product documentation would be appreciated but is not"
    " required <<any 1>> altered source versions must be plainly marked as such and must not be"
    " misrepresented as being the original software <<any 1>> this notice may not be removed or altered"
    " from any source distribution"
)
_APACHE_HEADER = (
    "licensed under the apache license version 2 0 <<optional>>the license<<end>> you may not use this file"
    " except in compliance with the license you may obtain a copy of the license at <<any 8>> unless"
    " required by applicable law or agreed to in writing software distributed under the license is"
    " distributed on an as is basis without warranties or conditions of any kind either express or implied"
    " see the license for the specific language governing permissions and limitations under the license"
)
_GPL_HEADER = (
    "this <<either>>program<<or>>library<<or>>file<<end>> is free software you can redistribute it and or"
    " modify it under the terms of the gnu <<optional>><<either>>lesser<<or>>affero<<end>><<end>> general"
    " public license as published by the free software foundation either version <<any 2>> of the license"
    " or at your option any later version this <<either>>program<<or>>library<<or>>file<<end>> is"
    " distributed in the hope that it will be useful but without any warranty without even the implied"
    " warranty of merchantability or fitness for a particular purpose see the gnu"
    " <<optional>><<either>>lesser<<or>>affero<<end>><<end>> general public license for more details"
)
TEMPLATES = {
    "notice-mit": "under <<optional>>the terms of<<end>> <<optional>>the<<end>> mit license",
    "notice-apache-2.0": "under the apache license <<optional>>version<<end>> 2 0",
    "notice-gpl": "under <<optional>>the terms of<<end>> the gnu <<optional>>lesser<<end>>"
                  " <<optional>>affero<<end>> general public license"
                  " <<optional>>as published by the free software foundation<<end>>"
                  " <<optional>>either<<end>> <<optional>>version <<any 1>><<end>>",
    "notice-cc": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by"
                 " <<optional>>nc<<end>> <<optional>>sa<<end>> <<optional>>nd<<end>>",
    "notice-cc-name": "licensed under a creative commons attribution <<any 4>> license",
    "mit": _MIT,
    "isc": _ISC,
    "bsd-2-clause": f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "zlib": _ZLIB,
    "apache-2.0-header": _APACHE_HEADER,
    "gpl-header": _GPL_HEADER,
    "copyright": "copyright c <<any 8>> all rights reserved",
}

WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = True
WORD_BYTES[0x80:] = True

_MARKUP = re.compile(r"<<(optional|either|or|end|any \d+)>>|([^\s<]+)")


class Automaton:
    """Bit i of a state set: the automaton stands before element i."""

    def __init__(self, template: str):
        elements: list[str | None] = []
        skips: list[tuple[int, int]] = []
        # Start of an open region and the ends of its sides so far; None for an optional one.
        regions: list[tuple[int, list[int] | None]] = []
        for markup, word in _MARKUP.findall(template):
            if word:
                elements.append(word)
            elif markup in ("optional", "either"):
                regions.append((len(elements), None if markup == "optional" else []))
            elif markup in ("or", "end") and not regions:
                raise ValueError("a region is not opened")
            elif markup == "or":
                start, ends = regions[-1]
                if ends is None:
                    raise ValueError("an optional region has one side")
                ends.append(len(elements))
                elements.append("")  # no word: the only way on from the end of a side skips the others
                skips.append((start, len(elements)))
            elif markup == "end":
                start, ends = regions.pop()
                skips += [(at, len(elements)) for at in ([start] if ends is None else ends)]
            else:
                for _ in range(int(markup.split()[1])):
                    skips.append((len(elements), len(elements) + 1))
                    elements.append(None)
        if regions:
            raise ValueError("a region is not closed")
        if len(elements) < 2 or not all(elements[:2]) or any(start == 0 for start, _ in skips):
            raise ValueError("a template begins with two words; the second may be in a region")
        self.size = len(elements)
        self.skips = sorted(skips)
        self.any = sum(1 << i for i, e in enumerate(elements) if e is None)
        self.by_word: dict[bytes, int] = {}
        for i, e in enumerate(elements):
            if e:
                key = e.encode()
                self.by_word[key] = self.by_word.get(key, 0) | 1 << i
        self.start = self._close(1)
        self.first = elements[0].encode()
        after = self._close(2)
        self.second = {w for w, bits in self.by_word.items() if bits & after}

    def _close(self, states: int) -> int:
        for start, end in self.skips:
            if states >> start & 1:
                states |= 1 << end
        return states

    def longest(self, words: list[bytes]) -> int:
        """Words of the longest accepted beginning of `words`, 0 if there is none."""
        states, found = self.start, 0
        for i, word in enumerate(words):
            moved = (states & (self.by_word.get(word, 0) | self.any)) << 1
            states = self._close(moved)
            if not states:
                break
            if states >> self.size & 1:
                found = i + 1
        return found


def _hashes(words: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return arrays.word_hash(buf, ends - [len(w) for w in words], ends)


def _scanner(phrases: dict[str, str], templates: dict[str, str]):
    def run(batches):
        base = [(p.encode().split(), label) for p, label in phrases.items()]
        automata = [(Automaton(t), label) for label, t in templates.items()]
        base_hash = [_hashes(words) for words, _ in base]
        first_hash = _hashes([a.first for a, _ in automata])
        second_hash = [_hashes(sorted(a.second)) for a, _ in automata]
        for batch in batches:
            for first, raw, offsets in arrays.text_slices(batch.column("text")):
                buf = arrays.LOWER[raw]
                starts, ends, bounds = arrays.word_spans(buf, offsets, WORD_BYTES)
                words = arrays.word_hash(buf, starts, ends)
                rows = len(bounds) - 1
                row = arrays.row_of(bounds)
                n = len(words)
                text = buf.tobytes()
                word = lambda i: text[starts[i] : ends[i]]  # noqa: B023, E731
                places: list[list[int]] = [[] for _ in range(rows)]
                spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
                base_labels: list[set[str]] = [set() for _ in range(rows)]
                labels: list[set[str]] = [set() for _ in range(rows)]

                def hits(hashes, last):
                    """Places where the first hash is followed by the others in the row."""
                    at = np.flatnonzero(words == hashes[0])  # noqa: B023
                    at = at[at + last < n]  # noqa: B023
                    return at[row[at + last] == row[at]]  # noqa: B023

                for (phrase, label), hashes in zip(base, base_hash, strict=True):
                    at = hits(hashes, len(phrase) - 1)
                    for j in range(1, len(phrase)):
                        at = at[words[at + j] == hashes[j]]
                    for i in at.tolist():
                        if all(word(i + j) == w for j, w in enumerate(phrase)):
                            r = int(row[i])
                            places[r].append(i - int(bounds[r]))
                            base_labels[r].add(label)
                            spans[r].append((i, i + len(phrase)))
                for (automaton, label), head, then in zip(automata, first_hash, second_hash, strict=True):
                    at = hits([head], 1)
                    at = at[np.isin(words[at + 1], then)]
                    for i in at.tolist():
                        r = int(row[i])
                        stop = min(i + automaton.size, int(bounds[r + 1]))
                        length = automaton.longest([word(j) for j in range(i, stop)])
                        if length:
                            labels[r].add(label)
                            spans[r].append((i, i + length))
                counts = np.diff(bounds)
                score = []
                for r in range(rows):
                    covered = edge = 0
                    for a, b in sorted(spans[r]):
                        covered += max(0, b - max(a, edge))
                        edge = max(edge, b)
                    score.append(covered / int(counts[r]) if covered else 0.0)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, rows),
                    pa.array(counts.astype(np.int64)),
                    pa.array([len(p) for p in places], pa.int64()),
                    pa.array([min(p) if p else None for p in places], pa.int64()),
                    pa.array([max(p) if p else None for p in places], pa.int64()),
                    pa.array([",".join(sorted(b)) for b in base_labels], pa.string()),
                    pa.array([",".join(sorted(b | x)) for b, x in zip(base_labels, labels, strict=True)],
                             pa.string()),
                    pa.array(score, pa.float64()),
                ], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                          "labels", "score"])

    return run


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    templates: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    A-Z are lowered; words are runs of 0-9, a-z and everything beyond ASCII.
    `n_base` counts the places where a phrase's words stand consecutively,
    overlapping ones too; `first_word` and `last_word` are their smallest and
    largest word positions from 0, null without a place. `labels` adds those of
    the accepted templates; label lists are distinct and sorted. `score` is the
    share of the text's words that matched wording covers, so 0 without a
    match. Null and empty texts have no words; a null id is returned as null,
    repeated rows as often as given.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        _scanner(phrases or PHRASES, templates or TEMPLATES),
        "doc_id long, n_words long, n_base long, first_word long, last_word long,"
        " base_labels string, labels string, score double",
    )
