"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template is wording with markup. ``<<beginOptional>> ... <<endOptional>>`` may be left out (and may be nested), and
``<<var;name="owner";words="0-20">>`` stands for so many words of any kind; every other word is mandatory. All templates
and phrases become one automaton over words that reads each text once; a text holds a template's wording where the
automaton accepts, so all mandatory words stand there in order with nothing between them but what the regions allow.
States are sets of places in the templates, made when a text first needs them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases whose every place is counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of public licenses and notices, by the label it gives. The mandatory words are the licenses' own.
TEMPLATES = {
    "mit-notice": '<<beginOptional>>this <<var;name="what";words="1-3">> is<<endOptional>> <<beginOptional>>released<<endOptional>>'
                  " <<beginOptional>>licensed<<endOptional>> <<beginOptional>>distributed<<endOptional>> under the"
                  " <<beginOptional>>terms of the<<endOptional>> MIT License",
    "apache-notice": "licensed under the Apache License <<beginOptional>>Version<<endOptional>> 2.0"
                     ' <<beginOptional>>(the "License"); you may not use this file except in compliance with the License'
                     "<<endOptional>>",
    "gpl-notice": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU"
                  " <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License"
                  ' version <<var;name="version";words="1-2">>',
    "gpl-grant": "This program is free software <<beginOptional>>you can redistribute it and/or modify it<<endOptional>>"
                 " under the terms of the GNU General Public License as published by the Free Software Foundation; either"
                 ' version <<var;name="version";words="1-2">> of the License, or (at your option) any later version',
    "cc-notice": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>>"
                 " <<beginOptional>>Creative Commons<<endOptional>> CC BY <<beginOptional>>NC<<endOptional>>"
                 " <<beginOptional>>SA<<endOptional>> <<beginOptional>>ND<<endOptional>> 4.0",
    "rights-reserved": '<<beginOptional>>Copyright <<var;name="owner";words="0-20">><<endOptional>> All rights reserved',
    "spdx-tag": 'SPDX License Identifier <<var;name="id";words="1-4">>',
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
                ' documentation files (the "Software"), to deal in the Software without restriction, including without'
                " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
                " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
                " conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next"
                " paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software."
                ' <<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,'
                " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
                ' NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";words="1-12">> BE LIABLE FOR ANY CLAIM, DAMAGES OR'
                " OTHER LIABILITY<<endOptional>>",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
                " hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
                ' that the following conditions are met: <<var;name="bullet";words="0-1">> Redistributions of source code'
                " must retain the above copyright notice, this list of conditions and the following disclaimer"
                ' <<var;name="bullet";words="0-1">> Redistributions in binary form must reproduce the above copyright notice',
}

#: Letters A-Z become small; what is no letter, digit or part of a character beyond ASCII ends a word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_MARK = re.compile(r"<<(.*?)>>", re.S)
_VAR = re.compile(r'var;\s*name="[^"]*";\s*words="(\d+)-(\d+)"$')
#: States that a worker keeps at most; beyond them it forgets all and goes on.
STATES = 20_000


def words_of(raw: bytes) -> list[bytes]:
    """The words of UTF-8 text, A-Z lower-cased."""
    return raw.translate(_FOLD).split()


def parsed(template: str) -> list:
    """Items of a template: a word, (least, most) for a replaceable region, or a list for an optional one."""
    stack: list[list] = [[]]
    at = 0
    for mark in [*_MARK.finditer(template), None]:
        stack[-1] += words_of(template[at : mark.start() if mark else None].encode())
        if mark is None:
            break
        at, kind = mark.end(), mark[1].strip()
        if kind == "beginOptional":
            stack.append([])
        elif kind == "endOptional" and len(stack) > 1:
            region = stack.pop()
            stack[-1].append(region)
        elif found := _VAR.match(kind):
            stack[-1].append((int(found[1]), int(found[2])))
        else:
            raise ValueError(f"markup {mark[0]!r} is not known here")
    if len(stack) > 1:
        raise ValueError("an optional region does not end")
    if not any(isinstance(item, bytes) for item in stack[0]):
        raise ValueError("a template needs a mandatory word")
    return stack[0]


class Automaton:
    """The automaton of several templates. ``anywhere``: wording may begin at every word, else at the first alone."""

    def __init__(self, templates: list[list], anywhere: bool = True):
        self.codes: dict[bytes, int] = {}
        self.on_word: list[dict[int, int]] = []
        self.on_any: list[int | None] = []
        self.free: list[list[int]] = []
        self.ends: dict[int, int] = {}
        starts = []
        for number, items in enumerate(templates):
            start = self._place()
            starts.append(start)
            self.ends[self._path(items, start)] = number
        self.begin = self._closed(starts)
        self.restart = self.begin if anywhere else frozenset()
        self._forget()

    def _place(self) -> int:
        self.on_word.append({})
        self.on_any.append(None)
        self.free.append([])
        return len(self.free) - 1

    def _path(self, items: list, at: int) -> int:
        for item in items:
            if isinstance(item, bytes):
                to = self._place()
                self.on_word[at][self.codes.setdefault(item, len(self.codes) + 1)] = to
                at = to
            elif isinstance(item, tuple):
                least, most = item
                skips = []
                for k in range(most):
                    if k >= least:
                        skips.append(at)
                    self.on_any[at] = at = self._place()
                for s in skips:
                    self.free[s].append(at)
            else:
                inner = self._place()  # a place of its own: what follows must not loop into the region
                self.free[at].append(inner)
                to = self._path(item, inner)
                after = self._place()
                self.free[to].append(after)
                self.free[at].append(after)
                at = after
        return at

    def _closed(self, places) -> frozenset:
        found, todo = set(places), list(places)
        while todo:
            for p in self.free[todo.pop()]:
                if p not in found:
                    found.add(p)
                    todo.append(p)
        return frozenset(found)

    def _forget(self) -> None:
        self.sets: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.next: list[dict[int, int]] = []
        self.accepts: list[tuple[int, ...]] = []
        self.start = self._state(self.begin)

    def _state(self, places: frozenset) -> int:
        if places not in self.numbers:
            self.numbers[places] = len(self.sets)
            self.sets.append(places)
            self.next.append({})
            self.accepts.append(tuple(sorted({self.ends[p] for p in places if p in self.ends})))
        return self.numbers[places]

    def _step(self, state: int, code: int) -> int:
        moved = []
        for p in self.sets[state]:
            if code in self.on_word[p]:
                moved.append(self.on_word[p][code])
            if self.on_any[p] is not None:
                moved.append(self.on_any[p])
        return self._state(self._closed(moved) | self.restart)

    def coded(self, words: list[bytes]) -> list[int]:
        """The number of each word, 0 for words of no template."""
        get = self.codes.get
        return [get(w, 0) for w in words]

    def accepted(self, codes: list[int]) -> list[tuple[int, tuple[int, ...]]]:
        """Where wording ends (words read so far) and of which templates."""
        if len(self.sets) > STATES:
            self._forget()
        found, state, moves, accepts = [], self.start, self.next, self.accepts
        for n, code in enumerate(codes, 1):
            to = moves[state].get(code)
            if to is None:
                to = moves[state][code] = self._step(state, code)
            state = to
            if accepts[state]:
                found.append((n, accepts[state]))
        return found

    def longest(self, codes: list[int], at: int) -> int:
        """How many words from ``at`` on are accepted, the most there are; 0 for none. For automata without ``anywhere``."""
        state, best = self.start, 0
        for n in range(at, len(codes)):
            to = self.next[state].get(codes[n])
            if to is None:
                to = self.next[state][codes[n]] = self._step(state, codes[n])
            state = to
            if not self.sets[state]:
                break
            if self.accepts[state]:
                best = n + 1 - at
        return best


class Scanner:
    """All phrases and templates, ready for one worker."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases.items()]
        self.labels = [label for _, label in self.phrases] + list(templates)
        items = [words for words, _ in self.phrases] + [parsed(t) for t in templates.values()]
        self.all = Automaton(items)
        self.single = [Automaton([i], anywhere=False) for i in items]

    def scan(self, raw: bytes) -> dict:
        words = words_of(raw)
        starts, base, own = [], set(), set()
        for end, numbers in self.all.accepted(self.all.coded(words)):
            for k in numbers:
                if k < len(self.phrases):
                    starts.append(end - len(self.phrases[k][0]))
                    base.add(k)
                else:
                    own.add(k)
        names = {self.labels[k] for k in own}
        spans = [s for k in sorted(own) for s in self._spans(words, k)]
        return {
            "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None),
            "last_word": max(starts, default=None), "base_labels": ",".join(sorted({self.labels[k] for k in base})),
            "labels": ",".join(sorted(names | {self.labels[k] for k in base})),
            "score": 1.0 - 0.5 ** (len(starts) + 2 * len(names)),
            "spans": sorted(spans, key=lambda s: (s["start"], s["end"], s["label"])),
            "whole": any(s["start"] == 0 and s["end"] == len(words) for s in spans),
        }

    def _spans(self, words: list[bytes], k: int) -> Iterator[dict]:
        """Leftmost longest places of one template that do not overlap."""
        automaton = self.single[k]
        codes, at = automaton.coded(words), 0
        first = {c for p in automaton.begin for c in automaton.on_word[p]}
        free = any(automaton.on_any[p] is not None for p in automaton.begin)
        while at < len(codes):
            n = automaton.longest(codes, at) if free or codes[at] in first else 0
            if n:
                yield {"label": self.labels[k], "start": at, "end": at + n}
            at += max(1, n)


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("whole", T.BooleanType()),
])
_ARROW = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
          "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
          "spans": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])), "whole": pa.bool_()}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None,
                  templates: dict[str, str] | None = None) -> DataFrame:
    """For each row of ``docs``: ``id_col``, what its text says of licenses, and where.

    n_words; n_base, first_word and last_word: number, least and greatest start of the places of ``phrases`` (words from
    0, null without one); base_labels: the labels of the phrases; labels: those and the ones of the ``templates`` whose
    wording the text holds, both distinct, sorted and comma-joined; score: 0 without any, halving its distance to 1 with
    every place of a phrase and twice with every template; spans: the templates' leftmost longest places (end exclusive);
    whole: a template accepts the text from its first word to its last.

    A null or empty text has no words, empty labels and score 0. Repeated rows each get a row, a null id stays null, other
    columns play no part, an empty table gives an empty result. Texts of any length are read whole, once.
    """
    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    known = (PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*known)
        for batch in batches:
            raw = batch.column("text").cast(pa.binary())
            found = [scanner.scan(t.as_py() or b"") for t in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array([r[c] for r in found], kind) for c, kind in _ARROW.items()]],
                names=["id", *_ARROW])

    return chosen.mapInArrow(run, T.StructType([chosen.schema["id"], *RESULT.fields])).withColumnRenamed("id", id_col)


def pattern(items: list) -> str:
    """The items as a regular expression over words that are each followed by a space."""
    out = []
    for item in items:
        if isinstance(item, bytes):
            out.append(item.decode() + " ")
        elif isinstance(item, tuple):
            out.append(f"(?:[^ ]+ ){{{item[0]},{item[1]}}}")
        else:
            out.append(f"(?:{pattern(item)})?")
    return "".join(out)


def sql() -> str:
    """The scan of ``documents`` with the templates as regular expressions."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    tests = ", ".join(f"CASE WHEN regexp_matches(joined, ' {pattern(parsed(t))}') THEN '{label}' END" for label, t in TEMPLATES.items())
    return f"""
WITH split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
   '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
phrases(words, label) AS (VALUES {phrases}),
places AS (SELECT doc_id, w, label, unnest(range(0, len(w)::BIGINT)) AS nth, words FROM split, phrases),
found AS (SELECT doc_id, label, nth FROM places WHERE w[nth + 1 : nth + len(words)] = words),
base AS (SELECT doc_id, count(*) AS n_base, min(nth) AS first_word, max(nth) AS last_word, list(DISTINCT label) AS l
 FROM found GROUP BY doc_id),
own AS (SELECT doc_id, len(w)::BIGINT AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM split),
named AS (SELECT doc_id, n_words, list_filter([{tests}], lambda x: x IS NOT NULL) AS m FROM own)
SELECT n.doc_id, n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
 coalesce(array_to_string(list_sort(l), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(l, []), m))), ','), '') AS labels,
 1 - power(0.5::DOUBLE, coalesce(n_base, 0) + 2 * len(m)) AS score
FROM named n LEFT JOIN base b ON n.doc_id = b.doc_id"""
