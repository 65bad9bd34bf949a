"""Licence scan: a trained paragraph classifier whose predictions templates confirm.

A paragraph is a line, or a notice wrapped over consecutive lines, which is
reported at the line where it begins. Features are hashed words and pairs of
words; lines, and runs of lines without a blank one, of more than two pieces of
``PIECE`` words are scored by every two pieces in a row. Each separate stretch
of such windows that states a family is reported once, by its best window; a
window that states several families reports each. The model is a multinomial
logistic regression over the licence families and the class ``unknown``,
trained on disturbed copies of the templates (words lost, prose around them)
against lines of a bounded sample of the documents (``SAMPLE_DOCS`` in hash
order, ``SAMPLE_CHARS`` characters each) and against lines that talk about
licences without granting one.

A third of the training rows is held out to calibrate: a temperature that
makes the probabilities fit, and the least probability of a family, chosen so
that at most ``FALSE_RATE`` of the held-out unknown lines would pass. A
prediction stands only if enough of the word pairs of one template of its
family are in the same window; otherwise the line stays unknown.

Defined cases: null and empty texts have no licence; every licensed line of a
text is reported, with one entry for each family and stretch; repeated rows are answered row by row; without documents to
learn from, the fixed lines alone stand for the unknown class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.llm import words
from seqrec.llm.common import column, fresh

UNKNOWN = "unknown"
BITS = 15
PIECE = 16
SAMPLE_DOCS, SAMPLE_CHARS = 384, 4000
COPIES = 30
FALSE_RATE = 0.001
CONFIRM = 0.6
SEED = 11

# Notices by which works state their licence, by family.
TEMPLATES = {
    "agpl": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             "This work is licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Use of this source code is governed by a BSD-style license", "Released under the BSD 3-Clause License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
            "Released into the public domain under CC0 1.0 Universal."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            "Released under the ISC License."],
    "lgpl": ["This work is licensed under the GNU Lesser General Public License, version 3.",
             "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License.", "This project is licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Licensed under the Mozilla Public License, version 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Lines about licences that grant none of the families.
NEAR_MISSES = [
    "A driving license and a valid permit are required.", "The license fee is due every year.",
    "Please contact the author about licensing.", "This work was released last year by the public library.",
    "Copyright by the authors, all rights reserved.", "The software requires a license key.",
    "Permission to enter the building is granted by the office.", "The general public is invited to this work.",
    "Version 3 of the product was released.", "The foundation published a work on free software.",
    "Licensed under the terms of a private agreement.", "See the license file for details.",
]


def grams(hashes: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word, and of every pair of words (of its first word; -1 at the end of a line)."""
    shift = np.uint64(64 - BITS)
    single = (hashes >> shift).astype(np.int32)
    pair = np.full(len(hashes), -1, np.int32)
    same = line[1:] == line[:-1]
    mixed = words.mixed(hashes[:-1] * np.uint64(3) + hashes[1:])
    pair[:-1][same] = (mixed[same] >> shift).astype(np.int32)
    return single, pair


def _features(text: str) -> np.ndarray:
    hashes = words.of_text(text)
    single, pair = grams(hashes, np.zeros(len(hashes), np.int64))
    return np.concatenate([single, pair[pair >= 0]])


def _pairs(text: str) -> set[int]:
    hashes = words.of_text(text)
    return set(words.mixed(hashes[:-1] * np.uint64(3) + hashes[1:]).tolist())


@dataclass(frozen=True)
class Model:
    families: list[str]
    weights: np.ndarray  # a row per bucket, the last one for missing pairs; a column per family, the last unknown
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, sums: np.ndarray, n_grams: np.ndarray) -> np.ndarray:
        return _softmax((sums / np.sqrt(np.maximum(n_grams, 1))[:, None] + self.bias) / self.temperature)


def _softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _disturbed(template: str, prose: list[str], draw: np.random.Generator) -> str:
    kept = [w for w in template.split() if draw.random() > 0.06] or template.split()
    around = [prose[int(draw.integers(len(prose)))].split()[:int(draw.integers(0, 12))] for _ in range(2)]
    return " ".join([*around[0], *kept, *around[1]])


def _training_rows(lines: list[str], draw: np.random.Generator) -> list[tuple[str, int]]:
    known = [_pairs(t) for ts in TEMPLATES.values() for t in ts]
    prose = [" ".join(line.split()[:2 * PIECE]) for line in [*lines, *NEAR_MISSES]]
    # a line that looks like a template is no example of the unknown class
    prose = [p for p in prose if p and all(len(k & _pairs(p)) < CONFIRM * len(k) for k in known)]
    rows = [(p, len(TEMPLATES)) for p in prose] + [(n, len(TEMPLATES)) for n in NEAR_MISSES * 10]
    for at, templates in enumerate(TEMPLATES.values()):
        for template in templates:
            rows += [(_disturbed(template, prose, draw) if i else template, at) for i in range(COPIES)]
    return rows


def train(lines: list[str], *, rounds: int = 100, rate: float = 4.0, decay: float = 1e-4) -> Model:
    """The classifier, from sampled lines and the templates."""
    draw = np.random.default_rng(SEED)
    rows = _training_rows(lines, draw)
    features, target = [_features(text) for text, _ in rows], np.array([c for _, c in rows])
    held = np.arange(len(rows)) % 3 == 1
    size = len(TEMPLATES) + 1
    lengths = np.array([len(f) for f in features])
    owner = np.repeat(np.arange(len(rows)), lengths)
    bucket = np.concatenate(features)
    scale = 1 / np.sqrt(np.maximum(lengths, 1))
    seen, compact = np.unique(bucket, return_inverse=True)
    dense = np.zeros((len(rows), len(seen)), np.float32)
    np.add.at(dense, (owner, compact), scale[owner])
    fit, wanted = dense[~held], np.eye(size, dtype=np.float32)[target[~held]]
    share = 1 / np.maximum(wanted.sum(axis=0), 1)
    balance = wanted @ share.astype(np.float32)
    balance = (balance / balance.sum())[:, None]
    weights, bias = np.zeros((len(seen), size), np.float32), np.zeros(size, np.float32)
    for _ in range(rounds):
        off = (_softmax(fit @ weights + bias) - wanted) * balance
        weights -= rate * (size * (fit.T @ off) + decay * weights)
        bias -= rate * off.sum(axis=0)
    logits, truth = dense[held] @ weights + bias, target[held]
    fits = {t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
            for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    temperature = min(fits, key=fits.get)
    families = _softmax(logits / temperature)[truth == size - 1][:, :-1].max(axis=1, initial=0)
    threshold = max(0.5, float(np.quantile(families, 1 - FALSE_RATE)) if len(families) else 0.5)
    full = np.zeros(((1 << BITS) + 1, size), np.float32)
    full[seen] = weights
    return Model(list(TEMPLATES), full, bias, temperature, min(threshold, 0.95))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Train on a bounded sample: ``SAMPLE_DOCS`` rows in the order of a hash of their id."""
    keys = docs.filter(column(text).isNotNull()).select(column(doc_id).alias("id"))
    chosen = [r["id"] for r in keys.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS).collect()]
    some = docs.filter(column(doc_id).isin(chosen)).select(
        column(doc_id).alias("id"), F.substring(column(text), 1, SAMPLE_CHARS).alias("text"))
    texts = [r["text"] for r in some.orderBy("id", "text").limit(SAMPLE_DOCS).collect() if r["text"]]
    lines = sorted({line for t in texts for line in t.split("\n")})
    np.random.default_rng(SEED).shuffle(lines)
    return train(lines[:2 * SAMPLE_DOCS])


class Scanner:
    """Applies a model to many texts at once."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.templates = {f: [_pairs(t) for t in TEMPLATES[f]] for f in model.families}

    def _windows(self, found: words.Words, n_lines: int) -> tuple[np.ndarray, ...]:
        """Windows of two pieces in a row: line, first and last word, class sums and number of grams."""
        counts = np.diff(found.first)
        line = np.repeat(np.arange(n_lines), counts)
        single, pair = grams(found.hashes, line)
        pieces = -(-counts // PIECE)
        piece_line = np.repeat(np.arange(n_lines), pieces)
        nth = np.arange(len(piece_line)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = found.first[:-1][piece_line] + nth * PIECE
        values = self.model.weights[single] + self.model.weights[pair]
        sums = np.add.reduceat(values, begin, axis=0)
        n_grams = np.add.reduceat(1 + (pair >= 0), begin)
        end = np.append(begin[1:], len(found.hashes))
        follows = np.append(piece_line[1:] == piece_line[:-1], False)
        # every piece with the one after it; a last piece stands alone only if it is the only one
        use = follows | (nth == 0)
        second = np.minimum(np.arange(len(begin)) + 1, len(begin) - 1)
        both = follows[use]
        return (piece_line[use], begin[use], np.where(both, end[second][use], end[use]),
                sums[use] + np.where(both[:, None], sums[second][use], 0),
                n_grams[use] + np.where(both, n_grams[second][use], 0))

    def _cover(self, pairs: list[int], template: set[int]) -> tuple[int, int]:
        """First and last place of the shortest run of pairs that holds all the template's pairs there are."""
        wanted, last, best = len(template.intersection(pairs)), {}, (0, len(pairs))
        for at, pair in enumerate(pairs):
            if pair in template:
                last.pop(pair, None)
                last[pair] = at
                first = next(iter(last.values()))
                if len(last) == wanted and at - first < best[1] - best[0]:
                    best = first, at
        return best

    def _stated(self, hashes: np.ndarray, name: str, sure: float) -> list[tuple[str, float, float, int, int]]:
        """Families a window states: name, probability, contained, first and last word of the statement.

        The classifier names one. Another is stated where a template of its
        own is contained, the classifier names it for that statement's words
        alone, and the statement holds no pair that only the families before
        it have (a statement of one family resembles those of its relatives).
        """
        pairs = words.mixed(hashes[:-1] * np.uint64(3) + hashes[1:]).tolist()
        own, out, foreign = set(pairs), [], set()
        for other in [name, *(f for f in self.model.families if f != name)]:
            contained, template = max(((len(own & t) / len(t), t) for t in self.templates[other]), key=lambda c: c[0])
            if contained < CONFIRM:
                if other == name:
                    return []
                continue
            first, last = self._cover(pairs, template)
            chance = sure
            if other != name:
                # pairs of the families before that this one does not have
                strange = foreign.difference(*self.templates[other])
                used = [first + i for i, p in enumerate(pairs[first:last + 1]) if p not in strange]
                if len(used) <= last - first:
                    inside = {pairs[i] for i in used if pairs[i] not in foreign}
                    if len(inside & template) < CONFIRM * len(template):
                        continue
                keep = np.unique([place for i in used if pairs[i] in template for place in (i, i + 1)])
                single, pair = grams(hashes[keep], np.cumsum(np.append(0, np.diff(keep) > 1)))
                sums = (self.model.weights[single] + self.model.weights[pair]).sum(axis=0)[None, :]
                scores = self.model.probabilities(sums, np.array([len(single) + np.count_nonzero(pair >= 0)]))[0]
                if self.model.families[int(scores[:-1].argmax())] != other or scores[:-1].max() < self.model.threshold:
                    continue
                chance = float(scores[:-1].max())
            out.append((other, chance, contained, first, last + 2))
            foreign |= own & set().union(*self.templates[other])
        return out

    def _notices(self, found: words.Words, n_parts: int, *, whole: bool = False) -> list[tuple[int, str, float, float, int, int]]:
        """Statements in each part: its number, family, probability, contained, first and last word. One per stretch."""
        if not len(found.hashes):
            return []
        part, begin, end, sums, n_grams = self._windows(found, n_parts)
        chance = self.model.probabilities(sums, n_grams)
        family = chance[:, :-1].argmax(axis=1)
        sure = chance[np.arange(len(chance)), family]
        best: dict[tuple[int, str, int], tuple] = {}
        latest: dict[tuple[int, str], tuple[int, int]] = {}
        for w in np.flatnonzero(sure >= self.model.threshold).tolist():
            for name, probability, contained, first, last in self._stated(
                    found.hashes[begin[w]:end[w]], self.model.families[family[w]], float(sure[w])):
                key = int(part[w]), name
                before, stretch = latest.get(key, (-2, w))
                stretch = stretch if before == w - 1 else w
                latest[key] = w, stretch
                place = (probability, contained, int(begin[w]) + first, int(begin[w]) + last)
                # a wrapped notice is placed by the window that holds most of it
                rank = (contained, probability) if whole else (probability,)
                best[*key, stretch] = max(best.get((*key, stretch), ((0.0,),)), (rank, *place))
        return [(number, name, *place) for (number, name, _), (_, *place) in best.items()]

    def _without_relatives(self, notices: list[tuple], hashes: np.ndarray) -> list[tuple]:
        """Of overlapping statements of which one is made of the other's pairs, the one that holds more of its template."""
        notices, lost = sorted(notices, key=lambda n: (n[4], n[5], n[1])), set()
        for i, a in enumerate(notices):
            for j in range(i + 1, len(notices)):
                b = notices[j]
                if b[4] >= a[5]:
                    break
                if a[1] == b[1]:
                    continue
                low, high, loser = (a, b, i) if (a[3], a[2]) < (b[3], b[2]) else (b, a, j)
                part = hashes[low[4]:low[5]]
                pairs = set(words.mixed(part[:-1] * np.uint64(3) + part[1:]).tolist())
                pairs &= set().union(*self.templates[low[1]])
                if 2 * len(pairs & set().union(*self.templates[high[1]])) >= len(pairs):
                    lost.add(loser)
        return [n for i, n in enumerate(notices) if i not in lost]

    def scan(self, texts: pa.Array) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for at, data, offsets in words.slices(texts):
            breaks = np.flatnonzero(data == 10) + 1
            edges = np.unique(np.concatenate([offsets, breaks]))
            found = words.hashed(data, edges)
            if not len(found.hashes):
                continue
            n_lines = len(edges) - 1
            lines = self._notices(found, n_lines)
            stated = {(number, name) for number, name, *_ in lines}
            # runs of lines: a run begins with a text, and where only white space lies since the line before
            blank = np.diff(found.first) == 0
            begins = np.isin(edges[:-1], offsets)
            empty = blank & np.array([not data[edges[i]:edges[i + 1]].tobytes().strip() if blank[i] else False
                                      for i in range(n_lines)], bool)
            begins[1:] |= empty[:-1]
            runs = np.append(np.flatnonzero(begins), n_lines)
            wrapped = words.Words(found.hashes, found.first[runs], found.starts)
            for _, name, probability, contained, first, last in self._notices(wrapped, len(runs) - 1, whole=True):
                top, bottom = (int(np.searchsorted(found.first, w, side="right")) - 1 for w in (first, last))
                if top < bottom and not any((n, name) in stated for n in range(top, bottom + 1)):
                    lines.append((top, name, probability, contained, first, last))
            lines = self._without_relatives(lines, found.hashes)
            for number, name, probability, contained, *_ in lines:
                start = edges[number]
                text = int(np.searchsorted(offsets, start, side="right")) - 1
                out[at + text].append({
                    "paragraph": int(np.count_nonzero(breaks <= start) - np.count_nonzero(breaks <= offsets[text])),
                    "family": name, "probability": round(probability, 6), "contained": round(contained, 6)})
        return out


FOUND = "array<struct<paragraph:int,family:string,probability:double,contained:double>>"
_ARROW = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()),
                             ("contained", pa.float64())]))


def licences(docs: DataFrame, model: Model, text: Column) -> Column:
    """The licensed paragraphs of a text column, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(shared.value)
        for texts in batches:
            yield pa.array(scanner.scan(texts), _ARROW)

    return find.asNondeterministic()(text)


def scan(docs: DataFrame, model: Model, text: str = "text", licences_as: str = "licences") -> DataFrame:
    """All columns of ``docs`` and the licensed paragraphs; a clashing name gets an underscore more."""
    (name,) = fresh(docs, licences_as)
    return docs.withColumn(name, licences(docs, model, column(text)))
