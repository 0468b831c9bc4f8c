"""License scan: an exact set-similarity join of text blocks with license templates.

A template is the set of its words. Blocks are runs of ``2 L`` words, one every ``L``
words, so any passage of up to ``L`` words lies whole in a block; ``L`` is 16 for
short notices and 128 for long ones. A block matches when it holds at least
``containment`` of the template's words. Words are ordered by how many documents of
the whole corpus hold them, rarest first, and three filters leave few blocks to
count: a block must hold one of the template's first words in that order (prefix),
enough words (length), and enough words from the first shared one on (position).
None of them can lose a match.

Templates and phrases are few and fixed, so they travel with the tasks; texts are
read in place, twice, and nothing is shuffled but counts of template words.

Defined results: null or empty texts have no words and no labels; equal matches of
one template keep the earliest block; repeated rows are answered each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, LOWER, WordReader, batch, mapped

CONTAINMENT = 0.9
BLOCK_WORDS = (16, 128)

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public license notices and their labels.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
            "list of conditions and the following disclaimer."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
             "(at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

_MATCH = "array<struct<label: string, first_word: bigint, last_word: bigint, containment: double>>"


def plain_words(text: str) -> list[str]:
    """The words of a phrase or template."""
    block = next(WordReader(ALNUM, LOWER).blocks(pa.array([text])))
    return [bytes(block.data[a:b]).decode() for a, b in zip(block.starts, block.ends)]


def _digests(text: str) -> np.ndarray:
    return next(WordReader(ALNUM, LOWER).blocks(pa.array([text]))).digests


@dataclass
class _Template:
    label: str
    tokens: np.ndarray    # places in the frequency order, rarest first
    need: int             # shared words that make a match
    prefix: np.ndarray = field(init=False)

    def __post_init__(self):
        self.prefix = self.tokens[:len(self.tokens) - self.need + 1]

    def shared(self, block: np.ndarray, n_block: int) -> int:
        """Shared words if enough, else 0. ``block``: its template words in frequency order, of ``n_block`` distinct."""
        if n_block < self.need:
            return 0
        first = next((i for i, t in enumerate(self.prefix) if t in block), None)
        if first is None:
            return 0
        at = int(np.searchsorted(block, self.tokens[first]))
        if 1 + min(len(self.tokens) - first - 1, n_block - at - 1) < self.need:
            return 0
        n = len(np.intersect1d(self.tokens, block, assume_unique=True))
        return n if n >= self.need else 0


class _Scanner:
    """What a task holds: the vocabulary in frequency order, templates by block length, phrases."""

    def __init__(self, order: np.ndarray, templates, phrases, containment: float):
        self.reader = WordReader(ALNUM, LOWER)
        self.by_digest = np.argsort(order)
        self.sorted = order[self.by_digest]
        self.phrases = [(_digests(p), label) for p, label in phrases.items()]
        self.sizes = []
        below = 0
        for size in BLOCK_WORDS:
            own = []
            for label, text in templates:
                words = _digests(text)
                if below < len(words) <= size:
                    tokens = np.unique(self.places(words))
                    own.append(_Template(label, tokens, max(1, int(np.ceil(containment * len(tokens) - 1e-9)))))
            rare = np.zeros(len(order) + 1, bool)
            for t in own:
                rare[t.prefix] = True
            self.sizes.append((size, own, rare))
            below = size

    def places(self, digests: np.ndarray) -> np.ndarray:
        """Place in the frequency order, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.sorted, digests), len(self.sorted) - 1)
        return np.where(self.sorted[at] == digests, self.by_digest[at], -1)

    def phrase_places(self, block) -> list[tuple[np.ndarray, str]]:
        docs = block.docs
        for words, label in self.phrases:
            n = len(block.digests) - len(words) + 1
            if n <= 0:
                continue
            hit = docs[:n] == docs[len(words) - 1:]
            for i, w in enumerate(words):
                hit &= block.digests[i:i + n] == w
            yield np.flatnonzero(hit), label

    def matches(self, digests: np.ndarray, places: np.ndarray) -> list[tuple]:
        """Best match of each template label in one text."""
        best: dict[str, tuple] = {}
        for size, templates, rare in self.sizes:
            at = np.flatnonzero(rare[places])    # -1 reads the spare last entry, never rare
            if not len(at):
                continue
            for b in np.unique(np.concatenate([at // size, at // size - 1])):
                if b < 0:
                    continue
                lo, hi = int(b) * size, min((int(b) + 2) * size, len(places))
                inside = places[lo:hi]
                tokens, n_block = np.unique(inside[inside >= 0]), len(np.unique(digests[lo:hi]))
                for t in templates:
                    if n := t.shared(tokens, n_block):
                        found = lo + np.flatnonzero(np.isin(inside, t.tokens))
                        score = n / len(t.tokens)
                        if t.label not in best or score > best[t.label][3]:
                            best[t.label] = (t.label, int(found[0]), int(found[-1]), score)
        return [best[k] for k in sorted(best)]


def _check_templates(templates) -> None:
    for label, text in templates:
        if not 0 < len(_digests(text)) <= BLOCK_WORDS[-1]:
            raise ValueError(f"a template has 1 to {BLOCK_WORDS[-1]} words; {label} has {len(_digests(text))}")


def template_word_counts(docs: DataFrame, vocabulary: np.ndarray, text: str = "text") -> np.ndarray:
    """Documents that hold each word of the vocabulary, over the whole table."""
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])
    by_digest = np.argsort(vocabulary)
    known = vocabulary[by_digest]

    def count(reader: WordReader, rows: pa.RecordBatch) -> pa.RecordBatch:
        held = np.zeros(len(known), np.int64)
        for block in reader.blocks(rows.column(0)):
            at = np.minimum(np.searchsorted(known, block.digests), len(known) - 1)
            hit = known[at] == block.digests
            pairs = np.unique(block.docs[hit] * len(known) + at[hit])
            held += np.bincount(pairs % len(known), minlength=len(known))
        some = np.flatnonzero(held)
        return batch(schema, word=by_digest[some], n=held[some])

    counts = mapped(docs.select(text), count, "word int, n long", lambda: WordReader(ALNUM, LOWER), gathered=True)
    out = np.zeros(len(vocabulary), np.int64)
    for word, n in counts.groupBy("word").agg(F.sum("n")).collect():    # a row per template word at most
        out[word] = n
    return out


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES,
                  containment: float = CONTAINMENT) -> DataFrame:
    """Per row: ``key, n_words, phrases`` (label and first word of each place) and ``matches`` (best per template label)."""
    _check_templates(templates)
    vocabulary = np.unique(np.concatenate([_digests(t) for _, t in templates]))
    counts = template_word_counts(docs, vocabulary, text)
    order = vocabulary[np.lexsort((vocabulary, counts))]
    place = pa.struct([("label", pa.string()), ("first_word", pa.int64())])
    match = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())])

    def scan(scanner: _Scanner, rows: pa.RecordBatch) -> pa.RecordBatch:
        n = len(rows)
        n_words, found, matches = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
        for block in scanner.reader.blocks(rows.column(1)):
            n_words[block.first:block.last] = np.diff(block.bounds)
            for at, label in scanner.phrase_places(block):
                docs_of = np.searchsorted(block.bounds, at, "right") - 1
                for d, i in zip(docs_of, at):
                    found[block.first + d].append((label, int(i - block.bounds[d])))
            places = scanner.places(block.digests)
            some = np.zeros(len(places), bool)
            for _, _, rare in scanner.sizes:
                some |= rare[places]
            for d in np.unique(np.searchsorted(block.bounds, np.flatnonzero(some), "right") - 1):
                a, b = block.bounds[d], block.bounds[d + 1]
                matches[block.first + d] = scanner.matches(block.digests[a:b], places[a:b])
        dicts = [[dict(zip(("label", "first_word", "last_word", "containment"), m)) for m in row] for row in matches]
        spots = [[{"label": a, "first_word": b} for a, b in sorted(row, key=lambda x: x[1])] for row in found]
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(n_words), pa.array(spots, pa.list_(place)), pa.array(dicts, pa.list_(match))],
            names=[key, "n_words", "phrases", "matches"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), scan,
                  f"`{key}` {kind}, n_words bigint, phrases array<struct<label: string, first_word: bigint>>, matches {_MATCH}",
                  lambda: _Scanner(order, templates, phrases, containment))


def license_report(docs: DataFrame) -> DataFrame:
    """The scan as flat columns; the score is 1 where a phrase stands, else the best containment."""
    found = scan_licenses(docs)
    starts, base = F.col("phrases.first_word"), F.array_distinct(F.col("phrases.label"))
    both = F.array_distinct(F.concat("phrases.label", "matches.label"))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(both), ",").alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0))).alias("score"))
