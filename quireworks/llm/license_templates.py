"""License scans: template-markup matching by token automata.

A template is a text with markup: ``<<optional>> ... <<end>>`` may be left out, ``<<any N>>`` stands for up to N words of any wording.
It is compiled to an automaton over words, which accepts a stretch of a text if all mandatory words are there, in order and exactly,
with nothing between them but what markup allows. Every place of a text where the first words fit is tried.

Beside the templates, fixed phrases give base labels wherever their words stand consecutively.

Cases: a null text has no words; texts without any hit have null places and empty labels; repeated rows give equal rows; an empty table
gives an empty result; columns beyond doc_id and text are ignored; very long texts are scanned whole, an automaton being tried only where its first words fit
and all its mandatory words occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Public licences and licence headers from first to last word, with what may be absent or replaced.
LICENCES = {
    "mit-text": """<<optional>>the <<any 1>> mit license<<end>> <<optional>>copyright <<any 16>><<end>> permission is hereby granted free of charge to any person obtaining a copy of this software and
        associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
        sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice
        and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software the software is provided as is
        without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event
        shall the <<any 8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
        or the use or other dealings in the software""",
    "isc-text": """<<optional>>copyright <<any 16>><<end>> permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that
        the above copyright notice and this permission notice appear in all copies the software is provided as is and <<any 8>> disclaims all warranties with regard to this software including
        all implied warranties of merchantability and fitness in no event shall <<any 8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting
        from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "bsd-text": """<<optional>>copyright <<any 16>><<end>> <<optional>>all rights reserved<<end>> redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met <<any 1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<any 1>>
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with
        the distribution <<optional>><<any 1>> neither the name of <<any 12>> nor the names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission<<end>> this software is provided by <<any 8>> as is and any express or implied warranties including but not limited to the implied warranties of
        merchantability and fitness for a particular purpose are disclaimed in no event shall <<any 8>> be liable for any direct indirect incidental special exemplary or consequential damages
        including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in
        contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage""",
    "apache-header": """<<optional>>copyright <<any 16>><<end>> licensed under the apache license version 2 0 the license you may not use <<any 2>> except in compliance with the license you may obtain a copy of
        the license at <<optional>>http<<end>> <<optional>>https<<end>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under
        the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions
        and limitations under the license""",
    "gpl-header": """<<optional>>copyright <<any 16>><<end>> <<any 4>> is free software you can redistribute it and or modify it under the terms of the gnu <<optional>>lesser<<end>> <<optional>>affero<<end>> general
        public license as published by the free software foundation either version <<any 3>> of the license or at your option any later version <<any 4>> is distributed in the hope that it will
        be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu <<optional>>lesser<<end>>
        <<optional>>affero<<end>> general public license for more details you should have received a copy of the gnu <<optional>>lesser<<end>> <<optional>>affero<<end>> general public license
        along with <<any 3>> if not""",
}

#: Notices of licences and openings of their grants, with what may be absent or replaced.
TEMPLATES = LICENCES | {
    "mit-notice": "<<optional>>this <<any 3>> is<<end>> released under the <<optional>>terms of the<<end>> mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<optional>>the software<<end>> to deal in the software without restriction",
    "gpl-notice": "<<optional>>this <<any 3>> is<<end>> licensed under the <<optional>>terms of the<<end>> gnu general public license <<optional>>version <<any 3>><<end>>",
    "gpl-grant": "you can redistribute it and or modify it under the terms of the gnu <<optional>>lesser<<end>> general public license as published by the free software foundation",
    "apache-notice": "<<optional>>this <<any 3>> is<<end>> licensed under the apache license version 2 0 <<optional>>the license<<end>>",
    "cc-by-notice": "<<optional>>this <<any 3>> is<<end>> licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by <<optional>>nc<<end>> <<optional>>sa<<end>> <<optional>>nd<<end>> <<any 2>>",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "rights-reserved": "all rights reserved",
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


@dataclass(frozen=True)
class Automaton:
    """States by number; ``steps[s]`` are (word or None for any, next state), ``free[s]`` states reached without a word."""

    steps: tuple[tuple[tuple[bytes | None, int], ...], ...]
    free: tuple[tuple[int, ...], ...]
    final: int
    required: frozenset[bytes]
    size: int

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def first_words(self) -> set[bytes]:
        return {w for s in self.closure({0}) for w, _ in self.steps[s] if w is not None}

    def match(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted stretch that begins at ``at``, or -1."""
        states, end = self.closure({0}), -1
        while states:
            if self.final in states:
                end = at
            if at >= len(words):
                break
            states = self.closure({t for s in states for w, t in self.steps[s] if w is None or w == words[at]})
            at += 1
        return end


def compile_template(template: str) -> Automaton:
    """The automaton of a template; ValueError if its markup isn't closed or nothing in it is mandatory."""
    steps: list[list] = [[]]
    free: list[list] = [[]]
    opened: list[int] = []
    required: list[bytes] = []

    def state() -> int:
        steps.append([])
        free.append([])
        return len(steps) - 1

    for part in re.findall(r"<<[^>]*>>|[^<]+", template):
        if part == "<<optional>>":
            opened.append(last := len(steps) - 1)
            new = state()
            free[last].append(new)
        elif part == "<<end>>":
            if not opened:
                raise ValueError(f"an end without its beginning: {template}")
            start, last = opened.pop(), len(steps) - 1
            new = state()
            free[last].append(new)
            free[start].append(new)
        elif part.startswith("<<any "):
            skips = []
            for _ in range(int(part[6:-2])):
                skips.append(last := len(steps) - 1)
                new = state()
                steps[last].append((None, new))
            for s in skips:
                free[s].append(len(steps) - 1)
        else:
            for w in words_of(part):
                last, new = len(steps) - 1, state()
                steps[last].append((w, new))
                if not opened:
                    required.append(w)
    if opened or not required:
        raise ValueError(f"markup isn't closed, or nothing is mandatory: {template}")
    return Automaton(tuple(map(tuple, steps)), tuple(map(tuple, free)), len(steps) - 1, frozenset(required), len(required))


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = {k: compile_template(v) for k, v in sorted(templates.items())}
        self.phrases = [(tuple(words_of(p)), label) for p, label in sorted(phrases.items())]
        starts: dict[bytes, list[str]] = {}
        for k, a in self.automata.items():
            for w in a.first_words():
                starts.setdefault(w, []).append(k)
        self.starts = starts
        #: a text without the rarest-looking word of every template and phrase needs no second look
        key = [max(a.required, key=lambda w: (len(w), w)) for a in self.automata.values()] + [max(p, key=lambda w: (len(w), w)) for p, _ in self.phrases]
        self.hint = re.compile(b"|".join(sorted({re.escape(k) for k in key})))

    def scan(self, text: str | None) -> tuple:
        """n_words, places of phrases [(place, label)], stretches of templates [(name, start, end)]."""
        data = (text or "").encode().lower()
        words = _WORD.findall(data)
        if not self.hint.search(data):
            return len(words), [], []
        places = []
        for phrase, label in self.phrases:
            at = -1
            while (at := _index(words, phrase[0], at + 1)) >= 0:
                if tuple(words[at : at + len(phrase)]) == phrase:
                    places.append((at, label))
        found, present = [], set(words)
        live = {k for k, a in self.automata.items() if a.required <= present}
        if live:
            begin = {w: [k for k in ks if k in live] for w, ks in self.starts.items()}
            for at, w in enumerate(words):
                for k in begin.get(w, ()):
                    if (end := self.automata[k].match(words, at)) >= 0:
                        found.append((k, at, end))
        return len(words), sorted(places), found


def _index(words: list[bytes], word: bytes, start: int) -> int:
    try:
        return words.index(word, start)
    except ValueError:
        return -1


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, places (array of place, label) and matches (array of template, start, end: words from 0, end excluded)."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    place_type = pa.list_(pa.struct([("place", pa.int64()), ("label", pa.string())]))
    match_type = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            n, places, found = [], [], []
            for x in batch.column("text"):
                a, b, c = scanner.scan(x.as_py())
                n.append(a)
                places.append([{"place": p, "label": q} for p, q in b])
                found.append([{"template": k, "start": s, "end": e} for k, s, e in c])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, place_type), pa.array(found, match_type)], ["doc_id", "n_words", "places", "matches"])

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(work, "doc_id bigint, n_words bigint, places array<struct<place: bigint, label: string>>, matches array<struct<template: string, start: bigint, end: bigint>>")


def label(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of what ``scan`` found.

    The score is 1 with a whole licence or licence header, 0.75 with a notice or the opening of a grant, 0.5 with a phrase alone, else 0.
    """
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    at, base = F.transform("places", lambda p: p["place"]), F.transform("places", lambda p: p["label"])
    named = F.concat(base, F.transform("matches", lambda m: m["template"]))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), joined(base).alias("base_labels"), joined(named).alias("labels"), F.when(F.exists("matches", lambda m: m["template"].isin(*LICENCES)), 1.0).when(F.size("matches") > 0, 0.75).when(F.size("places") > 0, 0.5).otherwise(0.0).alias("score"))
