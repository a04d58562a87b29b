"""Licence scanning with a generalised suffix automaton over licence notices.

The automaton of all templates, as word sequences, is small and fixed. Every text streams its
words through it once, which gives the matching statistics: at each word the longest stretch of
any template that ends there. Maximal stretches of ``SEED`` words or more are chained, per
template, in the order of both text and template; a template of which a chain covers enough is
reported with its label.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainproof.llm.common import short_batches, sliced

#: Base phrases and their labels. Fixed values.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Short notices and opening passages of public licences, with their labels. Fixed values.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
]

#: Words of a stretch that seeds a chain; share of a template that a chain has to cover, and the
#: words that are enough of a long one.
SEED, COVER, ENOUGH = 3, 0.8, 24

#: Bytes of words after A-Z are lower-cased: 0-9, a-z and all that are not ASCII.
_FOLD = bytes((i + 32 if 65 <= i <= 90 else i) if 48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences. ``ends[s]`` has the (template, end) places
    of the strings of state s, and ``phrases[s]`` the (template, words) of the base phrases that
    are suffixes of its longest string."""

    def __init__(self, sequences: list[list[bytes]], base: set[int]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, seq in enumerate(sequences):
            last = 0
            for i, w in enumerate(seq):
                last = self._extend(last, self.ids.setdefault(w, len(self.ids) + 1))
                own[last].append((t, i))
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for s, places in own.items():
            while s > 0:
                self.ends[s] += places
                s = self.link[s]
        whole = {}
        for t in base:
            s = 0
            for w in sequences[t]:
                s = self.next[s][self.ids[w]]
            whole[s] = (*whole.get(s, ()), (t, len(sequences[t])))
        self.phrases: list[tuple[tuple[int, int], ...]] = []
        for s in range(len(self.link)):
            found, at = (), s
            while at > 0:
                found += whole.get(at, ())
                at = self.link[at]
            self.phrases.append(found)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, x: int) -> int:
        """The state of p's longest string and x, parted from q, whose strings are longer."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, x: int) -> int:
        if (q := self.next[last].get(x)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, x)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, x)
        return new

    def statistics(self, seq: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest template stretch that ends at each word."""
        s = n = 0
        for x in seq:
            while s and x not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if x in self.next[s]:
                s, n = self.next[s][x], n + 1
            yield s, n


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], base: dict[str, str]):
        self.labels = [*base.values(), *(label for label, _ in templates)]
        self.sequences = [words(t) for t in (*base, *(t for _, t in templates))]
        self.n_base = len(base)
        self.automaton = Automaton(self.sequences, set(range(self.n_base)))

    def scan(self, text: str | None) -> dict:
        """What one text holds, with the covered spans of words: (template, from, to, cover)."""
        a = self.automaton
        seq = words(text)
        ids = np.fromiter(map(a.ids.get, seq, _ZEROS(len(seq))), dtype=np.int32, count=len(seq))
        inside = np.flatnonzero(ids)
        starts: list[int] = []
        kinds: set[str] = set()
        seeds: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        # only runs of template words can hold a stretch; others leave the automaton at its start
        for run in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1) if len(inside) >= SEED else ():
            if len(run) < SEED:
                continue
            at, before = int(run[0]), (0, 0)
            for i, (s, n) in enumerate(a.statistics(ids[run[0] : run[-1] + 1].tolist()), at):
                for t, size in a.phrases[s]:
                    if n >= size:
                        starts.append(i - size + 1)
                        kinds.add(self.labels[t])
                if n != before[1] + 1:
                    self._seed(seeds, *before, i - 1)
                before = s, n
            self._seed(seeds, *before, int(run[-1]))
        spans, score = [], 0.0
        for t, found in seeds.items():
            covered, first, last = chained(found)
            cover = covered / len(self.sequences[t])
            score = max(score, cover)
            if t >= self.n_base and (cover >= COVER or covered >= ENOUGH):
                spans.append((t, first, last, cover))
        base = sorted(kinds)
        labels = sorted({*kinds, *(self.labels[t] for t, *_ in spans)})
        return {"n_words": len(seq), "starts": starts, "base": base, "labels": labels, "score": min(1.0, score), "spans": spans}

    def _seed(self, seeds: dict, s: int, n: int, end: int) -> None:
        if n >= SEED:
            for t, e in self.automaton.ends[s]:
                seeds[t].append((end - n + 1, e - n + 1, n))


def _ZEROS(n: int) -> Iterator[int]:
    return iter([0] * n)


def chained(seeds: list[tuple[int, int, int]], gap: int = 12) -> tuple[int, int, int]:
    """The best chain of (text start, template start, words) that ascend in both, with at most
    ``gap`` words of text between neighbours: words covered, first and last word of the text."""
    best, all_best = [], (0, 0, 0)
    seeds = sorted(set(seeds))
    longest = max((n for _, _, n in seeds), default=0)
    for i, (x, y, n) in enumerate(seeds):
        own = (n, x, x + n - 1)
        for j in range(i - 1, -1, -1):
            px, py, pn = seeds[j]
            if x - px > gap + longest:  # seeds ascend by start, so none before ends near enough
                break
            if px + pn <= x <= px + pn + gap and py + pn <= y and best[j][0] + n > own[0]:
                own = (best[j][0] + n, best[j][1], x + n - 1)
        best.append(own)
        all_best = max(all_best, own)
    return all_best


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score and spans (array of label, first and last word, cover).

    Null and empty texts have no words, null places, empty labels and score 0. Null and repeated
    keys are scanned row by row; an empty table gives no rows; other columns are ignored.
    """
    scanner = Scanner(templates, base)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, last_word: long, cover: double>>"
    kinds = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows = []
            for doc, t in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                r = scanner.scan(t.as_py())
                at = r["starts"]
                rows.append({
                    "doc_id": doc, "n_words": r["n_words"], "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None),
                    "base_labels": ",".join(r["base"]), "labels": ",".join(r["labels"]), "score": float(r["score"]),
                    "spans": [{"label": scanner.labels[t], "first_word": a, "last_word": b, "cover": c} for t, a, b, c in r["spans"]],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, schema)
