"""License scans by a positional index of rare words.

Templates are short licence notices with key phrases that must be there, and bare
phrases. How many documents hold each of their words is counted over the whole corpus.
In a file, a template's rarest words are looked up: each place of such a word, less the
word's places in the template, is a start that it votes for, and starts for which
enough different words vote within a few words are candidates. A candidate is a find if
its window holds the key phrases and enough of the template's words. The postings of
all templates are small and bounded by the templates given, so files meet them where
they are read and nothing of a text is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, clean

#: Fixed: bytes of words once A-Z is in lower case. All bytes from 0x80 belong to words, so words of UTF-8 bytes are those of the text.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Fixed: bare phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Rarest words of a template that are looked up, the share of them that must vote for a start, and the share of a template's words that a find holds.
RAREST, VOTES, COVER = 8, 0.6, 0.8


@dataclass(frozen=True)
class Template:
    """A notice, the label that it gives, and phrases without which it isn't one."""

    label: str
    text: str
    key_phrases: tuple[str, ...]

    @property
    def words(self) -> list[bytes]:
        return words_of(self.text)


#: Notices as their licences give them.
TEMPLATES = (
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "version 2 of the license")),
    Template("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3 of the license")),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
)


def words_of(text: str | bytes) -> list[bytes]:
    """The words of a text, A-Z in lower case and nothing else changed."""
    return WORD.findall((text.encode() if isinstance(text, str) else text).lower())


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text").cast(pa.large_binary()):
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """The number of rows of ``docs`` (text), and of those that hold each word of ``vocabulary``; all rows count."""

    def run(batches):
        n, held = 0, Counter()
        for batch in batches:
            n += batch.num_rows
            for text in _texts(batch):
                held.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_pydict({"word": [None, *held], "n": pa.array([n, *held.values()], pa.int64())}, pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    counts = {r[0] if r[0] is None else bytes(r[0]): r[1] for r in docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n")).collect()}  # a row for each word of the templates at most
    return counts.pop(None, 0), counts


def _starts(words: list[bytes], at: dict[bytes, list[int]], rank: dict[bytes, int], phrase: list[bytes]) -> list[int]:
    """Where ``phrase`` stands: the places of its rarest word, and the other words at their distance."""
    key = min(phrase, key=rank.get)
    offset, n = phrase.index(key), len(phrase)
    return [p - offset for p in at[key] if p >= offset and words[p - offset : p - offset + n] == phrase]


class Index:
    """Postings of templates and phrases with the rank of each word by rareness; small, and the same in every task."""

    def __init__(self, templates: tuple[Template, ...], phrases: tuple[tuple[str, str], ...], n: int, held: dict[bytes, int]) -> None:
        self.phrases = [(words_of(p), label) for p, label in phrases]
        self.templates = [(t.label, t.words, set(t.words), [words_of(p) for p in t.key_phrases]) for t in templates]
        every = {w for p, _ in self.phrases for w in p} | {w for _, ws, _, keys in self.templates for w in [*ws, *(x for k in keys for x in k)]}
        order = sorted(every, key=lambda w: (-log((n + 1) / (held.get(w, 0) + 1)), w))
        self.rank = {w: i for i, w in enumerate(order)}  # 0: the highest inverse document frequency
        self.postings = [{w: [i for i, x in enumerate(ws) if x == w] for w in s} for _, ws, s, _ in self.templates]

    def scan(self, text: bytes) -> tuple[int, list[int], set[str], dict[str, float]]:
        """Number of words, starts of the phrases' places, their labels, and for each label that a template gives the share of its words found."""
        words = words_of(text)
        there = self.rank.keys() & set(words)
        near = [(t, p) for t, p in zip(self.templates, self.postings, strict=True) if len(t[2] & there) >= COVER * len(t[2]) and all(there.issuperset(k) for k in t[3])]
        base = [(p, label) for p, label in self.phrases if there.issuperset(p)]
        if not near and not base:
            return len(words), [], set(), {}
        keys = {min(p, key=self.rank.get) for p, _ in base} | {min(k, key=self.rank.get) for t, _ in near for k in t[3]} | {w for t, _ in near for w in self._rarest(t[2] & there)}
        at: dict[bytes, list[int]] = {w: [] for w in keys}
        for i, w in enumerate(words):
            if w in at:
                at[w].append(i)
        places, labels = [], set()
        for p, label in base:
            found = _starts(words, at, self.rank, p)
            places += found
            labels |= {label} if found else set()
        shares: dict[str, float] = {}
        for (label, ws, distinct, key_phrases), posting in near:
            keyed = [_starts(words, at, self.rank, k) for k in key_phrases]
            if all(keyed):
                share = self._best(words, at, self._rarest(distinct & there), posting, ws, distinct, key_phrases, keyed)
                if share >= COVER:
                    shares[label] = max(share, shares.get(label, 0.0))
        return len(words), places, labels, shares

    def _rarest(self, words: set[bytes]) -> list[bytes]:
        return sorted(words, key=self.rank.get)[:RAREST]

    def _best(self, words, at, rare, posting, ws, distinct, key_phrases, keyed) -> float:
        """The largest share of a template's words in a window that enough rare words vote for and that holds its key phrases."""
        slack = 2 + len(ws) // 8
        votes = sorted((p - i, w) for w in rare for p in at[w] for i in posting[w])
        need, best, seen, low, done = ceil(VOTES * len(rare)), 0.0, Counter(), 0, None
        for shift, w in votes:
            seen[w] += 1
            while votes[low][0] < shift - slack:
                seen[votes[low][1]] -= 1
                if not seen[votes[low][1]]:
                    del seen[votes[low][1]]
                low += 1
            start = votes[low][0]
            if len(seen) < need or start == done or best == 1:
                continue
            done = start
            a, b = max(0, start - slack), min(len(words), start + len(ws) + 2 * slack)
            if all((k := bisect_left(s, a)) < len(s) and s[k] + len(p) <= b for s, p in zip(keyed, key_phrases, strict=True)):
                best = max(best, len(distinct.intersection(words[a:b])) / len(distinct))
        return best


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of ``docs``.

    n_base counts all places of the phrases, overlapping ones too, first_word and
    last_word are the least and largest start, by words from 0, null if there are none.
    labels adds the labels of templates found; both lists are distinct, sorted and
    joined by commas. score is 1 with a phrase, else the largest share of a found
    template's words in its window, else 0. A null text is empty; repeated rows count
    and come back each; a text of any length is scanned whole, in one task. Other
    columns are left out, so their names can't clash. An empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    d = clean(docs, id_col, text_col)
    vocabulary = {w for t in templates for w in t.words} | {w for p in [*(p for p, _ in phrases), *(k for t in templates for k in t.key_phrases)] for w in words_of(p)}
    index = Index(templates, phrases, *document_frequencies(d, vocabulary))

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in _OUT.split(", ")[1:]}
            for text in _texts(batch):
                n, places, labels, shares = index.scan(text)
                row = (n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | shares.keys())), 1.0 if places else max(shares.values(), default=0.0))
                for values, value in zip(out.values(), row, strict=True):
                    values.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=["doc_id", *out])

    return d.mapInArrow(run, _OUT)
