"""License scans: marked-up license wordings compiled to token automata.

A template is a line of words with two kinds of regions:

* ``[[ ... ]]``: optional wording; regions do not nest;
* ``<<n>>``: replaceable wording, 0 to n arbitrary words.

All other words are mandatory and must match exactly.  ``compile_templates`` turns the templates of a
set into one deterministic automaton whose alphabet is the templates' own words plus one class for
every other word.  A scan starts the automaton at each word that can begin a template and steps all
starts of a chunk together through the transition table, so that its cost follows the number of
starts, not the number of templates.

Edge cases: null and empty texts have no words, no places, empty labels and score 0; places of
different phrases or of one phrase may overlap and all count; repeated rows give repeated results; null ids are
kept; an empty table gives an empty result; texts of any length are scanned whole; other columns are ignored.  ``score`` is the largest share of a template's mandatory words that a scan
got through from some start: 1.0 where a template is accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.shared import text_rows
from headway.llm.textvec import Words, chunks, member

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Wordings of well-known notices in template markup, with their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software [[and associated documentation files]] <<3>> to deal in the software without restriction"),
    ("mit", "[[this work is]] licensed under the [[terms of the]] mit license"),
    ("mit", "released under the [[terms of the]] mit license"),
    ("apache-2", "licensed under the apache license version 2 0 [[the license]]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "licensed under the <<2>> bsd license"),
    ("gpl-3", "licensed under the gnu general public license version 3 [[or later]]"),
    ("gpl-2", "licensed under the gnu general public license version 2 [[or later]]"),
    ("gpl", "under the terms of the gnu general public license [[as published by the free software foundation]]"),
    ("lgpl", "licensed under the gnu lesser general public license [[version]] <<1>>"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under [[a]] creative commons attribution <<2>> license"),
    ("cc-by-nc", "licensed under [[a]] creative commons attribution noncommercial <<2>> license"),
    ("cc-by-sa", "licensed under [[a]] creative commons attribution sharealike <<2>> license"),
    ("cc0", "dedicated to the public domain [[under cc0]]"),
    ("all-rights-reserved", "copyright <<4>> all rights reserved"),
)
_MARK = re.compile(r"\[\[(.*?)\]\]|<<(\d+)>>|(\S+)")


class Automaton:
    """table[state, class] is the next state (0: dead), accepts[state] the templates that end there.

    ``progress[state]`` is the largest share of a template's mandatory words read so far.
    """

    def __init__(self, templates: Iterable[tuple[str, str]]) -> None:
        self.labels = [label for label, _ in templates]
        vocabulary: dict[str, int] = {}
        edges: list[dict[int, list[int]]] = []  # by nfa state: class -> next states; class -1: any word
        skips: list[list[int]] = []
        share: list[float] = []
        ends: dict[int, int] = {}

        def new(progress: float) -> int:
            edges.append({})
            skips.append([])
            share.append(progress)
            return len(edges) - 1

        def word(at: int, text: str, progress: float) -> int:
            to = new(progress)
            edges[at].setdefault(vocabulary.setdefault(text, len(vocabulary)), []).append(to)
            return to

        starts = []
        for t, (_, wording) in enumerate(templates):
            parts = list(_MARK.finditer(wording))
            mandatory = sum(1 for m in parts if m[3]) or 1
            read, at = 0, new(0.0)
            starts.append(at)
            for m in parts:
                if m[3]:
                    read += 1
                    at = word(at, m[3], read / mandatory)
                elif m[2]:
                    out, here = new(read / mandatory), at
                    skips[here].append(out)
                    for _ in range(int(m[2])):
                        step = new(read / mandatory)
                        edges[here].setdefault(-1, []).append(step)
                        skips[step].append(out)
                        here = step
                    at = out
                else:
                    here = at
                    for text in m[1].split():
                        here = word(here, text, read / mandatory)
                    skips[at].append(here)
                    at = here
            ends[at] = t

        def closed(states: set[int]) -> frozenset[int]:
            todo, out = list(states), set(states)
            while todo:
                for x in skips[todo.pop()]:
                    if x not in out:
                        out.add(x)
                        todo.append(x)
            return frozenset(out)

        names = {frozenset(): 0, (first := closed(set(starts))): 1}
        todo, rows = [first], {0: [0] * (len(vocabulary) + 1)}
        while todo:
            here = todo.pop()
            row = []
            for c in range(len(vocabulary) + 1):
                to = closed({x for s in here for k in (c, -1) for x in edges[s].get(k, ())})
                if to not in names:
                    names[to] = len(names)
                    todo.append(to)
                row.append(names[to])
            rows[names[here]] = row
        self.vocabulary = [w for w, _ in sorted(vocabulary.items(), key=lambda x: x[1])]
        self.table = np.array([rows[i] for i in range(len(names))], dtype=np.int32)
        self.accepts = [sorted({ends[s] for s in states if s in ends}) for states, _ in sorted(names.items(), key=lambda x: x[1])]
        self.progress = np.array([max([share[s] for s in states], default=0.0) for states, _ in sorted(names.items(), key=lambda x: x[1])])
        self.final = np.array([bool(x) for x in self.accepts])

    def classes(self, w: Words) -> np.ndarray:
        """The class of each word; words found by hash are compared byte by byte, all at once."""
        own = Words(pa.array([" ".join(self.vocabulary)]))
        order = np.argsort(own.hash)
        at = member(w.hash, own.hash[order])
        out = np.where(at >= 0, order[at], len(self.vocabulary))
        known = np.flatnonzero(at >= 0)
        size = w.end[known] - w.start[known]
        same = size == (own.end - own.start)[out[known]]
        known, size = known[same], size[same]
        out[np.setdiff1d(np.flatnonzero(at >= 0), known, assume_unique=True)] = len(self.vocabulary)
        owner = np.repeat(np.arange(len(known)), size)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        other = w.data[w.start[known][owner] + inside] != own.data[own.start[out[known]][owner] + inside]
        out[known[np.unique(owner[other])]] = len(self.vocabulary)
        return out

    def matches(self, w: Words, cls: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        """(first word, words, template) of every accepted stretch; the best progress from each word."""
        best = np.zeros(len(cls))
        at = np.flatnonzero(self.table[1, cls] > 0)
        state, steps, found = self.table[1, cls[at]], 1, []
        end = np.repeat(w.first[1:], w.counts())[at]
        while len(at):
            best[at] = np.maximum(best[at], self.progress[state])
            for i in np.flatnonzero(self.final[state]):
                found += [(int(at[i]), steps, t) for t in self.accepts[state[i]]]
            on = at + steps < end
            at, state, end = at[on], state[on], end[on]
            state = self.table[state, cls[at + steps]]
            at, state, end = at[state > 0], state[state > 0], end[state > 0]
            steps += 1
        return found, best


def _scan(templates, base):
    def run(batches):
        whole = Automaton([*base, *templates])
        for batch in batches:
            for part in chunks(batch):
                w = Words(part.column("text"))
                found, best = whole.matches(w, whole.classes(w))
                row = np.searchsorted(w.first, [f for f, _, _ in found], side="right") - 1
                out = [[] for _ in range(part.num_rows)]
                for r, (first, n, t) in zip(row, found, strict=True):
                    out[r].append({"label": whole.labels[t], "base": t < len(base), "start": int(first - w.first[r]), "words": n})
                score = [float(best[a:b].max()) if b > a else 0.0 for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("words", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(w.counts(), pa.int64()), pa.array(out, kind), pa.array(score, pa.float64())], ["doc_id", "n_words", "places", "score"])

    return run


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE_PHRASES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (label, base, start, words), score of every document."""
    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan(tuple(templates), tuple(base)), f"doc_id {kind}, n_words long, places array<struct<label:string,base:boolean,start:long,words:int>>, score double")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``scan``'s result."""
    base = F.filter("places", lambda p: p["base"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"])
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), "score")
