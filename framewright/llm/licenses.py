"""License scans by template-markup matching.

A template is wording with markup: ``<<optional>> ... <</optional>>`` around words that may be missing, and
``<<var N>>`` for up to N words of any kind. It is compiled into an automaton over tokens. A text carries the
license if some stretch of its words is accepted: the mandatory words exactly and in order, nothing between
them but what the markup allows. The longest accepted stretch from a start counts.

Words are maximal runs of a-z (after lower-casing A-Z), 0-9 and non-ASCII characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.arrow import slices
from framewright.llm.names import col

#: Phrases that alone give a label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label and template. Whole license texts first, with the regions that their publishers let vary, then notices.
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of <<var 8>> <<optional>>the software <</optional>>to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software "
    "is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph <</optional>>shall be "
    "included in all copies or substantial portions of the software"
)
_MIT_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose "
    "and noninfringement in no event shall <<var 8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
    "connection with the software or the use or other dealings in the software"
)
_BSD_TERMS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>>1 <</optional>>"
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>>2 <</optional>>redistributions in binary "
    "form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_NAMES = "<<optional>>3 <</optional>>neither the name of <<var 12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
_BSD_WARRANTY = (
    "this software is provided by <<var 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a "
    "particular purpose are disclaimed in no event shall <<var 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited "
    "to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict "
    "liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GNU_PROGRAM = "is free software you can redistribute it and or modify it under the terms of the gnu {kind} public license as published by the free software foundation either version {version} of the license or <<optional>>at your option <</optional>>any later version"
_GNU_NOTICE = "under the <<optional>>terms of the <</optional>>gnu {kind} public license <<optional>>as published by the free software foundation <<optional>>either <</optional>><</optional>>version {version}"
_GNU_OTHER_WAY = "under <<optional>>the terms of <</optional>>version {version} of the gnu {kind} public license"
#: Label, the license's kind and version in words, and what follows the title of its whole text.
_GNU = (
    ("gpl-2", "general", "2", "june 1991"), ("gpl-3", "general", "3", "29 june 2007"), ("lgpl-2", "library general", "2", "june 1991"), ("lgpl-2", "lesser general", "2", ""),
    ("lgpl-2.1", "lesser general", "2 1", "february 1999"), ("lgpl-3", "lesser general", "3", "29 june 2007"), ("agpl-3", "affero general", "3", "19 november 2007"),
)
_CC_NAMES = {"by": ("attribution",), "sa": ("sharealike", "share alike"), "nc": ("noncommercial", "non commercial"), "nd": ("noderivatives", "noderivs", "no derivatives")}
_CC = (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd"))
_CC_VERSIONS = ("4 0", "3 0", "2 0")


def _gnu() -> list[tuple[str, str]]:
    out = []
    for label, kind, version, date in _GNU:
        out += [(label, t.format(kind=kind, version=version)) for t in (_GNU_PROGRAM, _GNU_NOTICE, _GNU_OTHER_WAY)]
        if date:
            out.append((label, f"gnu {kind} public license version {version} {date}"))
    return out


def _creative_commons() -> list[tuple[str, str]]:
    """Codes with a version, and names with or without."""
    out = []
    some = "".join(f"<<optional>>{x} <</optional>>" for x in (*_CC_VERSIONS, "international", "unported", "public"))
    for parts in _CC:
        label, names = "-".join(("cc", *parts)), [""]
        for part in parts:
            names = [f"{n} {x}".strip() for n in names for x in _CC_NAMES[part]]
        out += [(label, f"<<optional>>licensed <</optional>>under <<optional>>a <</optional>><<optional>>the <</optional>>cc {' '.join(parts)} {v}") for v in _CC_VERSIONS]
        out += [(label, f"<<optional>>licensed <</optional>>under <<optional>>a <</optional>><<optional>>the <</optional>>creative commons {n} {some}license") for n in names]
    return out


TEMPLATES = (
    ("mit", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    ("isc", "permission to use copy modify and <<optional>>or <</optional>>distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", f"{_BSD_TERMS}<<optional>>{_BSD_NAMES}<</optional>>{_BSD_WARRANTY}"),
    ("apache-2", "licensed under the apache license version 2 0 <<optional>>the license <</optional>>you may not use <<var 3>> except in compliance with the license you may obtain a copy of the license at <<optional>>http <</optional>><<optional>>https <</optional>>www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2", "apache license version 2 0 january 2004"),
    *_gnu(),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<optional>>http <</optional>><<optional>>https <</optional>>mozilla org mpl 2 0"),
    ("mpl-2", "mozilla public license version 2 0 <<optional>>1 <</optional>>definitions"),
    ("mit", "<<optional>>this <<var 3>> is <</optional>>released under the <<optional>>terms of the <</optional>>mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of <<var 8>> to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license <<optional>>version <</optional>>2 <<optional>>0<</optional>>"),
    ("apache-2", "you may not use this file except in compliance with the license <<var 14>> www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("lgpl", "under the <<optional>>terms of the <</optional>>gnu lesser general public license"),
    ("agpl", "under the <<optional>>terms of the <</optional>>gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license <<optional>>v <</optional>>2 0"),
    *_creative_commons(),
    ("all-rights-reserved", "all rights reserved <<optional>>worldwide<</optional>>"),
)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MARK = re.compile(r"<<(/?optional|var \d+)>>|([^\s<]+)")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


@dataclass(frozen=True)
class Automaton:
    """``steps[s]``: (word or None for any, next state); ``free[s]``: states reached without a word."""

    label: str
    steps: tuple[tuple[tuple[bytes | None, int], ...], ...]
    free: tuple[tuple[int, ...], ...]
    accept: int
    #: Words with which a match can begin.
    first: frozenset[bytes]
    #: Mandatory words up to each state, the most on a path.
    depth: tuple[int, ...]

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def run(self, words: list[bytes], start: int) -> tuple[int | None, float]:
        """End of the longest accepted stretch from ``start``; share of mandatory words on the furthest path."""
        states, end, far = self.closure({0}), None, 0
        for i in range(start, len(words)):
            states = self.closure({t for s in states for w, t in self.steps[s] if w is None or w == words[i]})
            if not states:
                break
            far = max(far, max(self.depth[s] for s in states))
            if self.accept in states:
                end = i + 1
        return end, far / max(1, self.depth[self.accept])


def compile_template(label: str, template: str) -> Automaton:
    """Raises ValueError for unbalanced markup, or if a match could begin with any word or be empty."""
    steps: list[list[tuple[bytes | None, int]]] = [[]]
    free: list[list[int]] = [[]]
    depth, opened = [0], []

    def new(at: int, more: int) -> int:
        steps.append([])
        free.append([])
        depth.append(depth[at] + more)
        return len(steps) - 1

    at = 0
    for mark, word in _MARK.findall(template):
        if word:
            nxt = new(at, not opened)
            steps[at].append((word.encode(), nxt))
            at = nxt
        elif mark == "optional":
            opened.append(at)
        elif mark == "/optional":
            if not opened:
                raise ValueError(f"{label}: optional region closed before it opened")
            begin, end = opened.pop(), new(at, 0)
            free[at].append(end)
            free[begin].append(end)
            at = end
        else:
            end = new(at, 0)
            free[at].append(end)
            for _ in range(int(mark.split()[1])):
                nxt = new(at, 0)
                steps[at].append((None, nxt))
                free[nxt].append(end)
                at = nxt
            free[at].append(end)
            at = end
    if opened or not depth[at]:
        raise ValueError(f"{label}: optional region not closed, or nothing mandatory")
    draft = Automaton(label, tuple(map(tuple, steps)), tuple(map(tuple, free)), at, frozenset(), tuple(depth))
    begins = draft.closure({0})
    first = {w for s in begins for w, _ in steps[s]}
    if None in first or at in begins:
        raise ValueError(f"{label}: a match must begin with a word of the template")
    return Automaton(label, draft.steps, draft.free, at, frozenset(first), draft.depth)


def compile_all(templates=TEMPLATES) -> list[Automaton]:
    return [compile_template(*t) for t in templates]


def places_of(words: list[bytes], wanted: frozenset[bytes]) -> list[int]:
    """Where wanted words stand. Texts have few or none of them, so words are looked through by built-in searches."""
    out = []
    for w in wanted.intersection(words):
        at = words.index(w)
        while True:
            out.append(at)
            try:
                at = words.index(w, at + 1)
            except ValueError:
                break
    return sorted(out)


def longest(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Stretches that don't lie within a longer one, so that a license isn't taken for another whose wording it extends."""
    out: list[tuple[str, int, int]] = []
    for x in sorted(found, key=lambda s: (s[1], -s[2], s[0])):
        if not out or x[2] > max_end or x[1:] == out[-1][1:]:
            out.append(x)
            max_end = x[2]
    return out


def spans(words: list[bytes], begins: dict[bytes, list[Automaton]]) -> tuple[list[tuple[str, int, int]], float]:
    """Accepted stretches (label, first word, end) that no longer one holds, and the best share of a template's mandatory words."""
    found, best = [], 0.0
    for i in places_of(words, frozenset(begins)):
        for a in begins[words[i]]:
            end, share = a.run(words, i)
            best = max(best, share)
            if end is not None:
                found.append((a.label, i, end))
    return longest(found), best


def by_first_word(automata: list[Automaton]) -> dict[bytes, list[Automaton]]:
    begins: dict[bytes, list[Automaton]] = {}
    for a in automata:
        for w in a.first:
            begins.setdefault(w, []).append(a)
    return begins


def _phrase_places(words: list[bytes], heads: dict[bytes, list[tuple[list[bytes], str]]]) -> list[tuple[int, str]]:
    return [(i, label) for i in places_of(words, frozenset(heads)) for p, label in heads[words[i]] if words[i : i + len(p)] == p]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates=TEMPLATES) -> DataFrame:
    """A row per document with its license labels and where they stand.

    doc_id, n_words, n_base (places of phrases), first_word and last_word (smallest and largest start of a
    phrase, from 0), base_labels, labels (with the templates'), score, spans (label, start, end of accepted
    stretches). Score: 1 with a label, else the largest share of a template's mandatory words that a stretch covers, from
    a word with which the template can begin to where it departs from it. A text of any length is read whole. Labels
    found twice stand once; a stretch within a longer one doesn't count, whatever their labels.
    A null text is an empty one: no words, no labels (empty strings), score 0. Repeated rows and null ids are
    rows like any other; an empty table gives an empty result; other columns aren't read.
    """
    heads: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for phrase, label in (PHRASES if phrases is None else phrases).items():
        own = phrase.encode().split()
        heads.setdefault(own[0], []).append((own, label))
    begins = by_first_word(compile_all(templates))
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    slim = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for t in part.column("text").cast(pa.binary()):
                    words = words_of(t.as_py())
                    places = _phrase_places(words, heads)
                    stretches, best = spans(words, begins)
                    own = {label for _, label in places}
                    labels = own | {x[0] for x in stretches}
                    starts = [i for i, _ in places]
                    rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), 1.0 if labels else best, [dict(zip(("label", "start", "end"), x, strict=True)) for x in stretches]))
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return slim.mapInArrow(look, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>")
