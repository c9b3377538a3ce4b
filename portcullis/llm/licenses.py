"""License scans by template markup.

A template is mandatory wording with optional regions (``<<beginOptional>> ... <<endOptional>>``, nestable)
and replaceable ones (``<<var;most=N>>``, up to N words of any kind). It is compiled once into a token
automaton: a state for every place in the template, word arcs, any-word arcs for replaceable places, and
the places reachable without a word closed over beforehand. A text is read word by word with the set of
live states; it is accepted from the first to the last word of the longest run whose mandatory wording
matches word for word. Only places whose word can begin a template start a run.

Templates of whole licences reach to their last mandatory word, liability clauses included, and are worth 1; where
only the opening of a licence stands, or its name is given, the text is worth less.

Beside templates, short phrases are counted wherever their words stand in a row; their labels are kept
even where no template matches. One projection of each whole text; nothing is shuffled.

Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. Defined results: null and empty texts
have no words, no labels and score 0; repeated rows are scanned each; other columns are kept.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from portcullis.llm.common import small_batches

# --- fixed values: phrases and their labels ------------------------------------------------------
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# --- fixed values: wording of public licences, with markup ----------------------------------------
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>> Redistributions in binary form
must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var;most=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
<<var;most=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the
Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;most=12>> BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, <<beginOptional>>and/or<<endOptional>> <<beginOptional>>and<<endOptional>>
distribute this software for any purpose with or without fee is hereby granted"""
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND <<var;most=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;most=8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE_HEAD = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""
_ALSO = "<<beginOptional>>or (at your option) any later version<<endOptional>>"
TEMPLATES = [
    ("mit", 1.0, _MIT_GRANT + " " + _AS_IS),
    ("mit", 0.6, _MIT_GRANT),
    ("isc", 1.0, _ISC_GRANT + _ISC_NOTICE + " " + _ISC_TAIL),
    ("isc", 0.6, _ISC_GRANT + _ISC_NOTICE),
    ("0bsd", 1.0, _ISC_GRANT + ". " + _ISC_TAIL),
    ("bsd-2", 1.0, _BSD_HEAD + " " + _BSD_TAIL),
    ("bsd", 0.6, _BSD_HEAD),
    ("bsd-3", 1.0, _BSD_HEAD + """ <<beginOptional>>3<<endOptional>> Neither the name of <<var;most=12>> nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""" + _BSD_TAIL),
    ("unlicense", 1.0, _UNLICENSE_HEAD + """ In jurisdictions that recognize copyright laws, the author or authors of this software
dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public
at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law. """ + _AS_IS),
    ("unlicense", 0.6, _UNLICENSE_HEAD),
    ("apache-2", 1.0, """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at <<var;most=12>> Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied."""),
    ("gpl", 1.0, f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version <<var;most=2>> of the License, {_ALSO}."""),
    ("lgpl", 1.0, f"""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version <<var;most=2>> of the License, {_ALSO}."""),
    ("mpl-2", 1.0, """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."""),
    ("apache-2", 0.8, """Licensed under the Apache License, Version 2 <<beginOptional>>0<<endOptional>>"""),
    ("mit", 0.8, """<<beginOptional>>This <<var;most=2>> is<<endOptional>> released under the MIT License"""),
    ("mit", 0.8, """Licensed under the MIT License"""),
    ("cc-by-nc", 0.8, """Licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC <<beginOptional>>4.0
<<endOptional>>"""),
    ("cc-by-sa", 0.8, """Licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-SA"""),
    ("cc-by-nc", 1.0, """licensed under a Creative Commons Attribution-NonCommercial <<var;most=1>> <<beginOptional>>4.0
<<endOptional>> International License"""),
    ("cc-by", 1.0, """licensed under a Creative Commons Attribution <<beginOptional>>4.0<<endOptional>> International License"""),
]
# ---------------------------------------------------------------------------------------------------
#: Score of a text with a phrase only.
PHRASE_SCORE = 0.5
_BLANKS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
_MARKUP = re.compile(r"<<\s*(beginOptional|endOptional|var)\s*(?:;[^>]*?most=(\d+)[^>]*)?>>")


def scan_words(text: bytes) -> list[bytes]:
    return text.translate(_BLANKS).split()


@dataclass
class Automaton:
    """arcs[s] maps a word to the next state; any_word[s] is the next state for whatever word, or None;
    skips[s] are states reachable without a word."""
    label: str
    worth: float
    arcs: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any_word: list[int | None] = field(default_factory=lambda: [None])
    skips: list[set[int]] = field(default_factory=lambda: [set()])
    closed: list[frozenset[int]] = field(default_factory=list)

    def state(self) -> int:
        self.arcs.append({})
        self.any_word.append(None)
        self.skips.append(set())
        return len(self.arcs) - 1

    def close(self) -> None:
        for s in range(len(self.arcs)):
            reach, todo = {s}, [s]
            while todo:
                for t in self.skips[todo.pop()] - reach:
                    reach.add(t)
                    todo.append(t)
            self.closed.append(frozenset(reach))

    @property
    def first_words(self) -> set[bytes]:
        return {w for s in self.closed[0] for w in self.arcs[s]}

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run that begins at ``at``, or -1."""
        final, end, live = len(self.arcs) - 1, -1, self.closed[0]
        for i in range(at, len(words)):
            w, following = words[i], set()
            for s in live:
                if (t := self.arcs[s].get(w)) is not None:
                    following |= self.closed[t]
                if (t := self.any_word[s]) is not None:
                    following |= self.closed[t]
            if not following:
                break
            live = following
            if final in live:
                end = i + 1
        return end


def compile_template(label: str, worth: float, template: str) -> Automaton:
    a, now, open_ = Automaton(label, worth), 0, []

    def literal(text: str, now: int) -> int:
        for w in scan_words(text.encode()):
            a.arcs[now][w] = now = a.state()
        return now

    at = 0
    for m in _MARKUP.finditer(template):
        before = literal(template[at:m.start()], now)
        at, now = m.end(), before
        if m[1] == "beginOptional":
            # a fresh state, so that skipping leaves no arc behind
            nxt = a.state()
            a.skips[now].add(nxt)
            now = nxt
            open_.append(now)
        elif m[1] == "endOptional":
            nxt = a.state()
            a.skips[now].add(nxt)
            a.skips[open_.pop()].add(nxt)
            now = nxt
        else:
            begin, middle = now, []
            for _ in range(int(m[2] or 1)):
                nxt = a.state()
                a.any_word[now] = nxt
                middle.append(now)
                now = nxt
            after = a.state()
            for s in [*middle, now, begin]:
                a.skips[s].add(after)
            now = after
    if open_:
        raise ValueError("an optional region is not closed")
    now = literal(template[at:], now)
    last = a.state()
    a.skips[now].add(last)
    a.close()
    if last in a.closed[0]:
        raise ValueError("a template needs mandatory wording")
    return a


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES) -> None:
        self.automata = [compile_template(*t) for t in templates]
        self.begins: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            if any(a.any_word[s] is not None for s in a.closed[0]):
                raise ValueError("a template begins with a replaceable region")
            for w in a.first_words:
                self.begins.setdefault(w, []).append(a)
        self.phrases = [([w.encode() for w in p.split()], label) for p, label in phrases.items()]

    def phrase_places(self, words: list[bytes], present: set[bytes]) -> list[tuple[int, str]]:
        out = []
        for phrase, label in self.phrases:
            if present.issuperset(phrase):
                n = len(phrase)
                out += [(i, label) for i, w in enumerate(words) if w == phrase[0] and words[i:i + n] == phrase]
        return out

    def matches(self, words: list[bytes], present: set[bytes]) -> list[tuple[str, float, int, int]]:
        """(label, worth, start, end) of accepted runs; the runs of one template do not overlap."""
        out = []
        starts = present & self.begins.keys()
        if starts:
            free: dict[int, int] = {}
            for i, w in enumerate(words):
                if w in starts:
                    for a in self.begins[w]:
                        if i >= free.get(id(a), 0) and (end := a.longest(words, i)) > 0:
                            out.append((a.label, a.worth, i, end))
                            free[id(a)] = end
        return out


_FOUND = ArrayType(StructType([StructField("label", StringType()), StructField("kind", StringType()), StructField("start", LongType()),
                               StructField("end", LongType())]))


def scan(docs: DataFrame, column: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Every column of ``docs``, and _n_words, _found (label, kind, start, end of each phrase and template,
    in words) and _score."""
    from pyspark.sql.pandas.types import to_arrow_type
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = small_batches(docs).toDF(*names).withColumn("t", F.coalesce(names[docs.columns.index(column)], F.lit("")).cast("binary"))
    found_type = to_arrow_type(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(templates, phrases)
        for b in batches:
            ns, founds, scores = [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                ws = scan_words(t)
                present = set(ws)
                plain = s.phrase_places(ws, present)
                accepted = s.matches(ws, present)
                lengths = {label: len(p) for p, label in s.phrases}
                founds.append([{"label": label, "kind": "phrase", "start": i, "end": i + lengths[label]} for i, label in plain]
                              + [{"label": label, "kind": "template", "start": i, "end": j} for label, _, i, j in accepted])
                ns.append(len(ws))
                scores.append(max([PHRASE_SCORE] * bool(plain) + [w for _, w, _, _ in accepted], default=0.0))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ns, pa.int64()), pa.array(founds, found_type), pa.array(scores, pa.float64())],
                                             names=[*names, "n", "f", "s"])

    kept = inner.schema.fields[:-1]
    from pyspark.sql.types import DoubleType
    out = inner.mapInArrow(run, StructType([*kept, StructField("n", LongType()), StructField("f", _FOUND), StructField("s", DoubleType())]))
    return out.toDF(*docs.columns, "_n_words", "_found", "_score")
