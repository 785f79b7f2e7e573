"""Licence notices by exact set-similarity join.

A text block matches a template if it contains at least a given share of the template's distinct words. Blocks are all
windows of consecutive words, across line breaks too, that are as long as the template with a tenth of other words
between its own. Words are ordered by their count in the whole corpus, rarest first. A block that shares enough words
must share one of the template's first ones (prefix filter) and needs enough template words at all (length filter);
where its first shared word stands at place i of the template, no more than those from there on can be shared
(positional filter). What is left is counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, slices, span_hashes, text_bytes, word_spans

# Phrases of the contract and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of common licence notices and their labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "Creative Commons Attribution ShareAlike License"),
    ("cc0", "dedicated to the public domain under CC0"),
    ("reserved", "All rights reserved"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _hashed(words: list[str]) -> list[int]:
    return [int(span_hashes(d := np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(d)]))[0]) for w in words]


def _words(text: str) -> list[str]:
    d = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    s, e, _ = word_spans(d, np.array([0, len(d)]), _WORD)
    return [d[a:b].tobytes().decode() for a, b in zip(s, e)]


class Templates:
    """Distinct words of each template as hashes, and what the filters need once corpus counts are known."""

    def __init__(self, templates: list[tuple[str, str]], share: float):
        self.labels = [label for label, _ in templates]
        self.sets = [sorted(set(_hashed(_words(text)))) for _, text in templates]
        self.need = [math.ceil(share * len(s) - 1e-9) for s in self.sets]
        self.wide = [math.ceil(len(_words(text)) / share - 1e-9) for _, text in templates]
        self.vocabulary = np.array(sorted({h for s in self.sets for h in s}), np.uint64)

    def order(self, counts: dict[int, int]) -> None:
        """counts: occurrences in the corpus by place in the vocabulary. Ties go by hash."""
        rank = np.empty(len(self.vocabulary), np.int64)
        rank[sorted(range(len(rank)), key=lambda k: (counts.get(k, 0), k))] = np.arange(len(rank))
        self.places = np.full((len(self.sets), len(rank)), -1)  # of each word of the vocabulary in each ordered template
        for t, words in enumerate(self.sets):
            at = np.searchsorted(self.vocabulary, np.array(words, np.uint64))
            self.places[t, at[np.argsort(rank[at])]] = np.arange(len(at))

    def matches(self, t: int, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin that contain template t, as places in at, and how many of its words each has. at: places of the vocabulary's words, rising."""
        size, need, wide = len(self.sets[t]), self.need[t], self.wide[t]
        place = self.places[t, word]
        anchors = at[(place >= 0) & (place <= size - need)]
        near = np.flatnonzero(place >= 0)
        near = near[np.searchsorted(anchors, at[near] + wide - 1, side="right") > np.searchsorted(anchors, at[near] - wide + 1)]
        at, place = at[near], place[near]
        end = np.searchsorted(at, at + wide)  # a window begins with each word of the template
        start = np.arange(len(at))
        first = np.full(len(at), size)
        for k in range(size - need, -1, -1):
            seen = np.concatenate([[0], np.cumsum(place == k)])
            first[seen[end] > seen[start]] = k
        start = np.flatnonzero((first <= size - need) & (np.minimum(end - start, size - first) >= need))
        before = np.full(len(at), -1)  # where the same word stood last
        by = np.argsort(place, kind="stable")
        same = place[by][1:] == place[by][:-1]
        before[by[1:][same]] = by[:-1][same]
        both = np.zeros(len(start), np.int64)
        for k in range(int((end[start] - start).max(initial=0))):
            inside = np.minimum(start + k, len(at) - 1)
            both += (start + k < end[start]) & (before[inside] < start)
        return near[start[both >= need]], both[both >= need]


def _tokens(part: pa.RecordBatch, vocabulary: np.ndarray):
    raw, offsets = text_bytes(part.column("text"))
    data = _LOWER[raw]
    start, end, doc = word_spans(data, offsets, _WORD)
    hashes = span_hashes(data, start, end)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return raw, offsets, start, doc, hashes, np.where(vocabulary[at] == hashes, at, -1)


def word_counts(df: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each word of the vocabulary occurs in all texts; the vocabulary is that of the fixed templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for part in slices(batches):
            known = _tokens(part, vocabulary)[-1]
            total += np.bincount(known[known >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    rows = df.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def license_scan(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, share: float = 0.9) -> DataFrame:
    """One row for each row of (doc_id, text): word count, phrase places, labels of phrases and of matched templates.

    Null and empty texts have no words and no labels, an empty table gives no rows; texts of any length are read whole;
    score is the largest share of a template or phrase that a block holds, 0 below the threshold. Repeated rows give
    repeated rows; other columns, also such as ``labels`` or ``score``, are not read.
    """
    known = Templates(templates, share)
    known.order(word_counts(df, known.vocabulary))
    spoken = [(label, np.array(_hashed(_words(phrase)), np.uint64)) for phrase, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw, offsets, start, doc, hashes, vocab = _tokens(part, known.vocabulary)
            rows = part.num_rows
            n_words = np.bincount(doc, minlength=rows)
            first_of = np.concatenate([[0], np.cumsum(n_words)])
            n_base, lo, hi = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
            base: list[set[str]] = [set() for _ in range(rows)]
            score = np.zeros(rows)
            for label, phrase in spoken:
                k = len(phrase)
                if len(hashes) < k:
                    continue
                hit = np.flatnonzero(hashes[: len(hashes) - k + 1] == phrase[0])
                for i in range(1, k):
                    hit = hit[hashes[hit + i] == phrase[i]]
                hit = hit[doc[hit] == doc[hit + k - 1]]
                of, place = doc[hit], hit - first_of[doc[hit]]
                np.add.at(n_base, of, 1)
                np.minimum.at(lo, of, place)
                np.maximum.at(hi, of, place)
                for d in np.unique(of):
                    base[d].add(label)
                    score[d] = 1.0
            labels = [set(x) for x in base]
            inside = np.flatnonzero(vocab >= 0)
            apart = inside + doc[inside] * max(known.wide, default=1)  # no window reaches from one text into the next
            for t, label in enumerate(known.labels):
                at, both = known.matches(t, vocab[inside], apart)
                for d, n in zip(doc[inside[at]].tolist(), both.tolist()):
                    labels[d].add(label)
                    score[d] = max(score[d], n / len(known.sets[t]))
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n_base), pa.array(lo, mask=none), pa.array(hi.astype(np.int64), mask=none),
                    pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
