"""Licence scans: templates with optional and replaceable regions, compiled into token automata.

Markup: <<beginOptional>> ... <<endOptional>> is a region that may be missing; <<var;name=NAME;max=N>> stands for 0 to N
words of any kind. All other words are mandatory. A text matches where the automaton, started at the template's first
words, reaches its end: every mandatory word stands there exactly, in order, with nothing else between.

Words: A-Z lower-cased, then runs of ASCII letters, digits and non-ASCII characters. Null text is empty: no words, no
labels, score 0. Texts are scanned whole. Repeated rows give equal answers, a null id stays null, an empty table gives no
rows, other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r"<<(.*?)>>", re.S)

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Templates by label; public licence notices.
TEMPLATES = {
    "mit-grant": "Released under the<<beginOptional>> terms of the<<endOptional>> MIT License",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0<<beginOptional>> (the \"License\"); you may not use this file except in compliance with the License<<endOptional>>",
    "gpl-notice": "This <<var;name=work;max=4>> is <<beginOptional>>free software <<endOptional>>licensed under the GNU <<beginOptional>>Lesser <<endOptional>><<beginOptional>>Affero <<endOptional>>General Public License<<beginOptional>>, version 3<<endOptional>><<beginOptional>> or any later version<<endOptional>>",
    "cc-by-nc-4.0": "Licensed under<<beginOptional>> a Creative Commons<<endOptional>> CC BY-NC 4.0",
    "cc-by-4.0": "Licensed under<<beginOptional>> a Creative Commons<<endOptional>> CC BY 4.0",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software.<<beginOptional>> THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND<<endOptional>>",
    "isc-text": "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\"",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<beginOptional>>3. Neither the name of <<var;name=organisation;max=12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. <<endOptional>>THIS SOFTWARE IS PROVIDED BY <<var;name=holder;max=12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES",
    "bsd-3-clause-text": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<beginOptional>>3. <<endOptional>>Neither the name of <<var;name=organisation;max=12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the author<<beginOptional>>s<<endOptional>> be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "bsl-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl-header": "is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser <<endOptional>><<beginOptional>>Library <<endOptional>><<beginOptional>>Affero <<endOptional>>General Public License as published by the Free Software Foundation; either version <<var;name=version;max=3>><<beginOptional>> of the License<<endOptional>>, or (at your option) any later version",
    "gpl-only-header": "is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License<<beginOptional>> v<<endOptional>><<beginOptional>>, v.<<endOptional>> 2.0",
    "cc-by-sa-4.0": "Licensed under<<beginOptional>> a Creative Commons<<endOptional>> CC BY-SA 4.0",
    "cc0-1.0-notice": "To the extent possible under law, <<var;name=author;max=12>> has waived all copyright and related or neighboring rights to<<beginOptional>> this work<<endOptional>>",
    "wtfpl-text": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION",
    "spdx-tag": "SPDX-License-Identifier: <<var;name=expression;max=1>>",
}


def words_of(text: str | bytes) -> list[bytes]:
    return _WORD.findall((text.encode() if isinstance(text, str) else text).lower())


class Automaton:
    """States 0..n; an arc is (word, target), a blank arc has no word, a wild arc takes any word."""

    def __init__(self, template: str):
        self.arcs: list[list[tuple[bytes, int]]] = [[]]
        self.blank: list[list[int]] = [[]]
        self.wild: list[list[int]] = [[]]
        self.anchor: list[bytes] = []
        at, open_regions, plain = 0, [], True
        for i, part in enumerate(_MARKUP.split(template)):
            if i % 2 == 0:
                for w in words_of(part):
                    at = self._new(at, w)
                    if plain:
                        self.anchor.append(w)
            elif part == "beginOptional":
                open_regions.append(at)
                plain = False
            elif part == "endOptional":
                at = self._join(at, open_regions.pop())
            elif part.startswith("var"):
                plain = False
                most = int(dict(x.split("=") for x in part.split(";")[1:])["max"])
                exits = [at]
                for _ in range(most):
                    target = self._state()
                    self.wild[at].append(target)
                    at = target
                    exits.append(at)
                for s in exits[:-1]:
                    self.blank[s].append(at)
            else:
                raise ValueError(f"unknown markup: {part}")
        if open_regions or not self.anchor:
            raise ValueError("a template starts with a mandatory word and closes its regions")
        self.end = at

    def _state(self) -> int:
        for x in (self.arcs, self.blank, self.wild):
            x.append([])
        return len(self.arcs) - 1

    def _new(self, at: int, word: bytes) -> int:
        target = self._state()
        self.arcs[at].append((word, target))
        return target

    def _join(self, at: int, opened: int) -> int:
        self.blank[opened].append(at)
        return at

    def _closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.blank[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def match(self, words: list[bytes], start: int) -> int | None:
        """The longest match from start: the word after it, else None."""
        states, found, i = self._closure({0}), None, start
        while states:
            if self.end in states:
                found = i
            if i == len(words):
                break
            w = words[i]
            states = self._closure({t for s in states for x, t in self.arcs[s] if x == w} | {t for s in states for t in self.wild[s]})
            i += 1
        return found


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    k = len(phrase)
    return [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + k] == phrase]


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first, last) of every row."""
    base = [(words_of(p), label) for p, label in phrases.items()]
    automata = {label: Automaton(t) for label, t in templates.items()}
    # Every match holds its first mandatory words, each a plain substring: texts without any of them are only counted.
    longest = lambda words: max(words, key=len)
    needed = sorted({longest(p) for p, _ in base} | {longest(a.anchor) for a in automata.values()})
    inner = np.ones(256, bool)
    inner[[b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)]] = False

    def run(batches):
        for part in slices(batches, rows=512):
            texts = [(t or b"").lower() for t in part.column(1).to_pylist()]
            buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
            is_word = inner[buf]
            begins = np.flatnonzero(is_word[1:] & ~is_word[:-1])
            edges = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)]
            counts = np.diff(np.searchsorted(begins, edges))
            cols: list[list] = [[] for _ in range(7)]
            for text in texts:
                starts, marks, spans = [], set(), []
                if any(n in text for n in needed):
                    words = _WORD.findall(text)
                    for phrase, label in base:
                        if at := _places(words, phrase):
                            starts += at
                            marks.add(label)
                    for label, automaton in automata.items():
                        for i in _places(words, automaton.anchor):
                            if (end := automaton.match(words, i)) is not None:
                                spans.append({"label": label, "first": i, "last": end - 1})
                every = marks | {s["label"] for s in spans}
                row = (len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(marks)), ",".join(sorted(every)), 1.0 if spans else 0.5 if starts else 0.0, spans)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts.astype(np.int64)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long>>")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("spans")
