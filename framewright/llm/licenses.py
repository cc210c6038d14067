"""License scans by template markup.

A template is license wording with optional regions `[[ ... ]]` and replaceable regions `{{name:most}}`, which take up to
`most` words of any kind. Templates are compiled to automata over words. A text is accepted where the mandatory
wording stands word by word, with the optional regions there or not, and anything short in the replaceable ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.base import chunks, query, table, utf8

SURE = 20  # mandatory words from which on a match is taken as certain (score 1)

# Phrases and labels of the base scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public license wording, as templates. Labels may have several; white space and punctuation do not count.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "released under [[the terms of]] [[the]] mit license"),
    ("mit", "licensed under [[the terms of]] [[the]] mit license"),
    ("mit", "spdx license identifier mit"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of {{work:8}} and associated documentation "
        'files (the "{{name:3}}"), to deal in {{name:4}} without restriction, including without limitation the rights to use, '
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of {{name:4}}, and to permit persons to whom "
        "{{name:4}} is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of {{name:4}}.",
    ),
    ("apache", "licensed under the apache license [[version {{number:2}}]]"),
    ("apache", "spdx license identifier apache 2 0"),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use {{what:4}} except in compliance with '
        "the License. You may obtain a copy of the License at [[http://www.apache.org/licenses/LICENSE-2.0]]"
        "[[https://www.apache.org/licenses/LICENSE-2.0]] Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied.",
    ),
    ("gpl", "licensed under the [[terms of the]] gnu general public license [[version {{number:2}}]]"),
    ("gpl", "spdx license identifier gpl"),
    (
        "gpl",
        "is free software [[:]] you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, [[either]] version {{number:2}} [[of the License]]",
    ),
    (
        "lgpl",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation",
    ),
    ("lgpl", "licensed under the [[terms of the]] gnu lesser general public license"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
        "the distribution",
    ),
    ("bsd", "licensed under [[the]] [[{{clauses:1}} clause]] bsd license"),
    (
        "isc",
        "Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law {{who:12}} has waived all copyright and related or neighboring rights to"),
    ("cc-by", "licensed under [[a]] [[the]] creative commons attribution [[{{number:2}}]] [[international]] license"),
    ("cc-by", "licensed under [[a]] [[the]] cc by"),
    ("cc-by-nc", "licensed under [[a]] [[the]] cc by nc"),
    ("cc-by-nc", "licensed under [[a]] [[the]] creative commons attribution noncommercial [[{{number:2}}]] [[international]] license"),
    ("cc-by-sa", "licensed under [[a]] [[the]] cc by sa"),
    ("cc-by-sa", "licensed under [[a]] [[the]] creative commons attribution sharealike [[{{number:2}}]] [[international]] license"),
]

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))
_MARK = re.compile(r"(\[\[|\]\]|\{\{[a-z]+:\d+\}\})")


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased."""
    return text.translate(_FOLD).split()


def parse(markup: str) -> list[tuple]:
    """A template as a tree: ("word", w), ("any", most), ("maybe", [...])."""
    stack: list[list] = [[]]
    for part in _MARK.split(markup):
        if part == "[[":
            stack.append([])
        elif part == "]]":
            if len(stack) == 1:
                raise ValueError(f"an optional region ends that never began: {markup!r}")
            inner = stack.pop()
            stack[-1].append(("maybe", inner))
        elif part.startswith("{{"):
            stack[-1].append(("any", int(part[2:-2].split(":")[1])))
        else:
            stack[-1] += [("word", w) for w in words_of(part.encode())]
    if len(stack) > 1:
        raise ValueError(f"an optional region does not end: {markup!r}")
    while stack[0] and stack[0][-1][0] != "word":  # what need not be there at an end decides nothing
        stack[0].pop()
    while stack[0] and stack[0][0][0] != "word":
        stack[0].pop(0)
    if not stack[0]:
        raise ValueError(f"a template needs mandatory words: {markup!r}")
    return stack[0]


@dataclass(frozen=True)
class Template:
    """A compiled template: `steps[state]` maps a word (None: any word) to the states after it."""

    label: str
    lead: bytes  # the mandatory words that it begins with
    mandatory: int
    steps: tuple[dict, ...]
    start: frozenset[int]
    last: int

    def match(self, words: list[bytes], at: int) -> int | None:
        """End of the longest accepted run of words that begins at `at`."""
        states, end = self.start, None
        for i in range(at, len(words) + 1):
            if self.last in states:
                end = i
            if i == len(words):
                break
            after: set[int] = set()
            for s in states:
                step = self.steps[s]
                after.update(step.get(words[i], ()), step.get(None, ()))
            if not after:
                break
            states = after
        return end


def compile_template(label: str, markup: str) -> Template:
    """States are places between words; those reached without a word are merged into the steps beforehand."""
    tree = parse(markup)
    edges: list[list[tuple]] = [[]]  # per state: (word or None, to) and, for a free move, ("", to)

    def add(nodes: list[tuple], state: int) -> int:
        for kind, value in nodes:
            if kind == "word":
                edges.append([])
                edges[state].append((value, len(edges) - 1))
                state = len(edges) - 1
            elif kind == "any":
                ends = [state]
                for _ in range(value):
                    edges.append([])
                    edges[state].append((None, len(edges) - 1))
                    state = len(edges) - 1
                    ends.append(state)
                for e in ends[:-1]:
                    edges[e].append(("", state))
            else:
                before = state
                state = add(value, state)
                edges.append([])
                edges[state].append(("", len(edges) - 1))
                state = len(edges) - 1
                edges[before].append(("", state))
        return state

    last = add(tree, 0)

    def closure(state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for on, to in edges[todo.pop()]:
                if on == "" and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    closed = [closure(s) for s in range(len(edges))]
    steps = []
    for out in edges:
        step: dict = {}
        for on, to in out:
            if on != "":
                step[on] = step.get(on, frozenset()) | closed[to]
        steps.append(step)
    lead = []
    for kind, value in tree:
        if kind != "word":
            break
        lead.append(value)
    mandatory = sum(kind == "word" for kind, _ in tree)
    return Template(label, b" ".join(lead), mandatory, tuple(steps), closed[0], last)


def as_pattern(markup: str) -> str:
    """The same template as a regular expression over words that each have a blank behind them."""

    def build(nodes: list[tuple]) -> str:
        out = ""
        for kind, value in nodes:
            if kind == "word":
                out += re.escape(value.decode()) + " "
            elif kind == "any":
                out += f"(?:[^ ]+ ){{0,{value}}}"
            else:
                out += f"(?:{build(value)})?"
        return out

    return build(parse(markup))


def _starts(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers at which a phrase stands in words that have a blank on both sides."""
    wanted, at, seen, word = b" " + phrase + b" ", 0, 0, 0
    while (at := joined.find(wanted, at)) >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        yield word
        at += 1


PLACE = "array<struct<kind:string,label:string,start:long,end:long,words:long>>"


def scan_licenses(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """`docs` with `n_words` (long) and `places`: struct (kind, label, start, end, words), word numbers from 0, end exclusive.

    Words are what is left of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Places of kind `phrase` are
    all places of the base phrases; of kind `template` the accepted runs of each template, leftmost and longest, not
    overlapping each other; `words` is the number of mandatory words. Places are ordered by start, then kind and label.

    A null or empty text has no words and no places. Rows are judged one by one, so repeated rows, ids and ties do not
    matter. Texts of any length are read whole. Input columns of the two new names are replaced, others stay as they
    are; an empty table gives no rows.
    """
    known = TEMPLATES if templates is None else templates
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "places", "__text")]
    added = T._parse_datatype_string(f"n_words long, places {PLACE}").fields
    schema = T.StructType([*[docs.schema[c] for c in kept], *added])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [compile_template(*t) for t in known]
        for batch in chunks(batches, "__text"):
            sizes, places = [], []
            for x in utf8(batch.column(len(kept))):
                words = words_of(x)
                joined = b" " + b" ".join(words) + b" "
                found = []
                for phrase, label in PHRASES.items():
                    n = phrase.count(" ") + 1
                    found += [("phrase", label, s, s + n, n) for s in _starts(joined, phrase.encode())]
                for t in compiled:
                    free = 0
                    for s in _starts(joined, t.lead):
                        if s >= free and (end := t.match(words, s)) is not None:
                            found.append(("template", t.label, s, end, t.mandatory))
                            free = end
                found.sort(key=lambda p: (p[2], p[0], p[1], p[3]))
                sizes.append(len(words))
                places.append([dict(zip(("kind", "label", "start", "end", "words"), p, strict=True)) for p in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sizes, pa.int64()), pa.array(places, kind)], [*kept, "n_words", "places"])

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(scan, schema)


def _oracle() -> str:
    tests = ",\n".join(
        f"({n}, '{label}', {compile_template(label, markup).mandatory}, ' {as_pattern(markup)}')" for n, (label, markup) in enumerate(TEMPLATES)
    )
    phrases = ",\n".join(f"('{p}', '{label}', {p.count(' ') + 1})" for p, label in PHRASES.items())
    return rf"""
    WITH split AS (
        SELECT row_number() OVER () AS id, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
        FROM documents
    ), joined AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS line FROM split
    ), words AS (
        SELECT id, unnest(words) AS w, unnest(range(len(words))) AS i FROM split
    ), runs AS (
        SELECT id, i, w || ' ' || lead(w) OVER o AS two,
               w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS four
        FROM words WINDOW o AS (PARTITION BY id ORDER BY i)
    ), phrases(phrase, label, n) AS (VALUES {phrases}
    ), base AS (SELECT id, i, label, n FROM runs JOIN phrases ON phrase = two OR phrase = four
    ), templates(k, label, n, pattern) AS (VALUES {tests}
    ), accepted AS (SELECT id, label, n FROM joined, templates WHERE regexp_matches(line, pattern)
    ), summed AS (
        SELECT id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
        FROM base GROUP BY id
    ), labelled AS (
        SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(n) AS most
        FROM (SELECT id, label, n FROM base UNION ALL SELECT * FROM accepted) GROUP BY id
    )
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
           last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           least(coalesce(most, 0) / {SURE}.0::DOUBLE, 1.0::DOUBLE) AS score
    FROM joined LEFT JOIN summed USING (id) LEFT JOIN labelled USING (id)
    """


@query("op13_license_scan", _oracle())
def op13_license_scan(spark, sf_dir):
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("places", lambda p: p.kind == "phrase")
    found = found.select("doc_id", "n_words", "places", base.alias("base"))

    def labels(of: str):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: p.label))), ",")

    most = F.coalesce(F.array_max(F.transform("places", lambda p: p.words)), F.lit(0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p.start)).alias("first_word"),
        F.array_max(F.transform("base", lambda p: p.start)).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("places").alias("labels"),
        F.least(most / F.lit(float(SURE)), F.lit(1.0)).alias("score"),
    )
