"""License scans: base phrases, and templates with optional and replaceable regions as token automata.

A template is words with markup: ``[...]`` holds words that may be absent, ``{n}`` stands for up to
n words of any kind. It compiles to an automaton over words that accepts exactly the texts with
all its mandatory words in order and nothing else between them; a scan looks for accepted
stretches anywhere in a text. A template's longest run of mandatory words has to be in the text as
it is, which rules out nearly every text by one substring search.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches

#: Phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
    "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
    "arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and "
    "the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of "
    "conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
#: Templates of public license texts and notices, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 [the license]",
    "bsd-2-clause": _BSD + " this software is provided by",
    "bsd-3-clause": _BSD + " [3] neither the name of {12} nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission",
    "cc-by-4.0": "licensed under [a] [the] [creative commons] cc by 4 0",
    "cc-by-nc-4.0": "licensed under [a] [the] [creative commons] cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under [a] [the] [creative commons] cc by sa 4 0",
    "gpl-notice": "this [program] [library] [file] [work] is free software you can redistribute it and or modify it under the "
    "terms of the gnu general public license as published by the free software foundation [either] version {1} of the license "
    "[or at your option any later version]",
    "gpl-3.0": "licensed under the [terms of the] gnu general public license [v] [version] 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "mit-notice": "[this] [work] [is] released under [the terms of] the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights to "
    "use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
    "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
    "[including the next paragraph] shall be included in all copies or substantial portions of the software " + _AS_IS,
}

_MARKUP = re.compile(r"\[([^\]]*)\]|\{(\d+)\}|([^\[\]{}\s]+)")

#: Bytes as words have them: A-Z in lower case, other ASCII than letters and digits as a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def parts(template: str) -> list[tuple]:
    """('word', w), ('optional', words) and ('any', n) in order."""
    out: list[tuple] = []
    for optional, count, word in _MARKUP.findall(template):
        if word:
            out.append(("word", word.encode()))
        elif count:
            out.append(("any", int(count)))
        else:
            out.append(("optional", optional.encode().split()))
    return out


class Automaton:
    """States are numbers; a state has edges by word, edges for any word, and edges without one."""

    def __init__(self, template: str):
        self.words: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        runs: list[list[bytes]] = [[]]
        state = 0
        for kind, value in parts(template):
            if kind == "word":
                state = self._step(state, value)
                runs[-1].append(value)
                continue
            runs.append([])
            if kind == "optional":
                start = state
                for word in value:
                    state = self._step(state, word)
                end = self._new()
                self.free[state].append(end)
                self.free[start].append(end)
                state = end
            else:
                end, places = self._new(), [state]
                for _ in range(value):
                    after = self._new()
                    self.any[places[-1]] = after
                    places.append(after)
                for place in places:
                    self.free[place].append(end)
                state = end
        self.final = state
        longest = max(runs, key=len)
        self.anchor = b" " + b" ".join(longest) + b" "
        self.begin = self._close({0})
        #: Words that a match can start with; None if any can.
        self.starts = None if any(self.any[s] is not None for s in self.begin) else {w for s in self.begin for w in self.words[s]}

    def _new(self) -> int:
        self.words.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.words) - 1

    def _step(self, state: int, word: bytes) -> int:
        after = self._new()
        self.words[state][word] = after
        return after

    def _close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for after in self.free[todo.pop()]:
                if after not in states:
                    states.add(after)
                    todo.append(after)
        return states

    def matches(self, words: list[bytes]) -> bool:
        """Whether some stretch of ``words`` is accepted."""
        now: set[int] = set()
        for word in words:
            if self.starts is None or word in self.starts:
                now = now | self.begin
            after = set()
            for state in now:
                step = self.words[state].get(word)
                if step is not None:
                    after.add(step)
                if self.any[state] is not None:
                    after.add(self.any[state])
            now = self._close(after)
            if self.final in now:
                return True
        return False


def pattern(template: str) -> str:
    """The template as a regular expression over words with a space before and after each."""
    out = " "
    for kind, value in parts(template):
        if kind == "word":
            out += value.decode() + " "
        elif kind == "any":
            out += f"(?:[^ ]+ ){{0,{value}}}"
        else:
            out += f"(?:{b' '.join(value).decode()} )?"
    return out


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Words, base phrases and labels of each row's whole ``text``.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score. With e
    the base places plus twice the templates found, the score is e / (e + 1). Texts without words
    (or null) have zeros, null positions and empty labels; repeated rows give repeated results.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = (
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double"
    )

    def run(batches):
        automata = {label: Automaton(t) for label, t in templates.items()}
        phrases = [(b" " + p.encode() + b" ", label) for p, label in base.items()]
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                raw = value.as_buffer()
                words = raw.to_pybytes().translate(_PLAIN).split() if raw is not None else []
                text = b" " + b" ".join(words) + b" "
                places, labels = [], set()
                for phrase, label in phrases:
                    at, last, place = text.find(phrase), 0, 0
                    while at >= 0:
                        place += text.count(b" ", last, at)
                        places.append(place)
                        labels.add(label)
                        last, at = at, text.find(phrase, at + 1)
                found = {label for label, a in automata.items() if a.anchor in text and a.matches(words)}
                weight = len(places) + 2 * len(found)
                row = (len(words), len(places), min(places, default=None), max(places, default=None))
                row += (",".join(sorted(labels)), ",".join(sorted(labels | found)), weight / (weight + 1))
                for column, x in zip(out, row):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def _oracle() -> str:
    """DuckDB text: the templates as regular expressions in place of automata."""
    listed = ", ".join(f"('{p}', '{label}')" for p, label in BASE.items())
    matched = ", ".join(f"CASE WHEN regexp_matches(t, '{pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
j AS (SELECT doc_id, len(ws) AS n_words, CASE WHEN len(ws) = 0 THEN '  ' ELSE ' ' || array_to_string(ws, ' ') || ' ' END AS t, ws FROM w),
p AS (SELECT * FROM (VALUES {listed}) p(phrase, label)),
h AS (SELECT doc_id, label, unnest(list_filter(range(0, n_words),
    lambda i: array_to_string(ws[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase)) AS place
  FROM j, p WHERE contains(t, ' ' || phrase || ' ')),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS ls FROM h GROUP BY doc_id),
m AS (SELECT j.doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(ls, []) AS ls,
    list_filter([{matched}], lambda x: x IS NOT NULL) AS fs
  FROM j LEFT JOIN b USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_base::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(ls), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(ls, fs))), ',') AS labels,
  (n_base + 2 * len(fs))::DOUBLE / (n_base + 2 * len(fs) + 1) AS score
FROM m
"""


ORACLE = _oracle()
