"""Operator 4: license scans by an exact set-similarity join of text blocks and templates.

A block is a line. A template is found in a block that holds at least `threshold` of its
distinct words. Words of templates are put in a global order, rarest in all documents first.
A block with enough of a template's words must hold one of its first words in that order (the
prefix); such pairs pass the length filter (enough template words in the block) and the
positional filter (enough words left after the match), and are then verified.

With `wrapped`, as the query has it, a template is also found where its words go on over line breaks:
in a window of consecutive words, as long as the template over the threshold, that reaches over
several lines. Windows start at words of the template, are filtered by how many of its words they
hold, and then verified like a block; of windows that overlap the best is kept.

Beside the join, fixed phrases of license names are found where their words stand
consecutively, in any block.

Templates are fixed text, so index and phrases are small whatever the input; word
frequencies are counted over all documents.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are
scanned one by one.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Phrase and label.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices of common licenses and the label of each.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-notice", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-notice", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution International License"),
)


def hashed(text: str) -> np.ndarray:
    data = common.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = common.words(data, np.array([0, len(data)]), common.ALNUM_WORD)
    return common.span_hashes(data, starts, ends)


def vocabulary(templates) -> np.ndarray:
    return np.unique(np.concatenate([hashed(t) for _, t in templates] or [np.zeros(0, np.uint64)]))


def frequencies(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the sorted terms stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        own = shared.value
        n = np.zeros(len(own), np.int64)
        for batch in batches:
            for _, _, data, offsets in common.slices(batch.column(0)):
                data = common.LOWER[data]
                starts, ends, _ = common.words(data, offsets, common.ALNUM_WORD)
                h = common.span_hashes(data, starts, ends)
                at = np.minimum(np.searchsorted(own, h), len(own) - 1)
                n += np.bincount(at[own[at] == h], minlength=len(own))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(n)], names=["t", "n"])

    out = np.zeros(len(terms), np.int64)
    if len(terms):
        for r in docs.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
            out[r.t] = r.n
    return out


class Index:
    """Templates as rows of ranks in the global order, and the inverted index of their prefixes."""

    def __init__(self, templates, terms: np.ndarray, counts: np.ndarray, threshold: float, phrases):
        self.phrases = [(hashed(p), label) for p, label in phrases]
        order = np.lexsort((terms, counts))  # rarest first
        rank = np.empty(len(terms), np.int64)
        rank[order] = np.arange(len(terms))
        self.terms, self.rank = terms, rank
        self.sets = [np.sort(rank[np.searchsorted(terms, np.unique(hashed(t)))]) for _, t in templates]
        self.labels = [label for label, _ in templates]
        self.spans = [math.ceil(len(hashed(t)) / threshold - 1e-9) for _, t in templates]
        self.needed = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for x, (s, need) in enumerate(zip(self.sets, self.needed)):
            for i, r in enumerate(s[: len(s) - need + 1].tolist()):
                self.postings[r].append((x, i))
        self.in_prefix = np.zeros(len(terms) + 1, bool)
        self.in_prefix[list(self.postings)] = True

    def wrapped(self, rank: np.ndarray, doc: np.ndarray, line: np.ndarray) -> list[tuple[int, int, float]]:
        """(place of the first word, template, containment) for windows over several lines that hold enough of a template."""
        out = []
        known = np.flatnonzero(rank < len(self.terms))
        for x, (own, need, span) in enumerate(zip(self.sets, self.needed, self.spans)):
            member = np.zeros(len(self.terms), bool)
            member[own] = True
            at = known[member[rank[known]]]
            ends = np.minimum(np.searchsorted(at, at + span), np.searchsorted(doc[at], doc[at], "right"))
            start = np.arange(len(at))
            several = line[at[ends - 1]] != line[at]
            best, until = None, -1
            for a in np.flatnonzero((ends - start >= need) & several).tolist():
                both = len(np.unique(rank[at[a : ends[a]]]))
                if both < need:
                    continue
                if a >= until:
                    if best:
                        out.append(best)
                    best = (int(at[a]), x, both / len(own))
                elif both / len(own) > best[2]:
                    best = (int(at[a]), x, both / len(own))
                until = int(ends[a])
            if best:
                out.append(best)
        return out

    def scan(self, block: np.ndarray) -> list[tuple[int, float]]:
        """(template, containment) for those that a block, as sorted distinct ranks, holds enough of."""
        out, tried = [], set()
        for j in np.flatnonzero(self.in_prefix[block]).tolist():
            for x, i in self.postings[int(block[j])]:
                if x in tried:
                    continue
                own, need = self.sets[x], self.needed[x]
                if len(block) < need:
                    continue
                if 1 + min(len(own) - i - 1, len(block) - j - 1) < need:  # this is the first word shared
                    tried.add(x)
                    continue
                tried.add(x)
                both = len(np.intersect1d(own, block, assume_unique=True))
                if both >= need:
                    out.append((x, both / len(own)))
        return out


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.9, wrapped: bool = False) -> DataFrame:
    """The `keep` columns of docs(text, ...) with n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    blocks lists (line from 0, label, containment) of every block that meets a template, and with
    `wrapped` of every window over several lines, by its first line.
    """
    terms = vocabulary(templates)
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, terms, frequencies(docs, terms), threshold, phrases))
    frame = docs.select(*(F.col(c).alias(f"_{c}") for c in keep), F.col("text").alias("_text_"))
    types = ", ".join(f"`_{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    blocks = pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))

    def run(batches):
        own = index.value
        for batch in batches:
            n = batch.num_rows
            n_words = np.zeros(n, np.int64)
            places: list[list[int]] = [[] for _ in range(n)]
            base: list[set[str]] = [set() for _ in range(n)]
            found: list[list[dict]] = [[] for _ in range(n)]
            for i, j, data, offsets in common.slices(batch.column(len(keep))):
                data = common.LOWER[data]
                starts, ends, limits = common.words(data, offsets, common.ALNUM_WORD)
                h = common.span_hashes(data, starts, ends)
                n_words[i:j] = np.diff(limits)
                for phrase, label in own.phrases:
                    at = np.flatnonzero(h[: len(h) - len(phrase) + 1] == phrase[0]) if len(h) >= len(phrase) else np.zeros(0, np.int64)
                    for k in range(1, len(phrase)):
                        at = at[h[at + k] == phrase[k]]
                    d = np.searchsorted(limits, at, "right") - 1
                    inside = at + len(phrase) <= limits[d + 1]
                    for p, r in zip(at[inside].tolist(), d[inside].tolist()):
                        places[i + r].append(p - int(limits[r]))
                        base[i + r].add(label)
                if not len(own.terms) or not len(h):
                    continue
                slot = np.minimum(np.searchsorted(own.terms, h), len(own.terms) - 1)
                rank = np.where(own.terms[slot] == h, own.rank[slot], len(own.terms))
                doc = np.searchsorted(limits, np.arange(len(h)), "right") - 1
                line = np.searchsorted(np.flatnonzero(data == 0x0A), starts) + doc  # lines of all documents, one after the other
                first = np.searchsorted(np.flatnonzero(data == 0x0A), offsets[:-1]) + np.arange(j - i)
                edge = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
                for a in np.unique(np.searchsorted(edge, np.flatnonzero(own.in_prefix[rank]), "right") - 1).tolist():
                    low, high = int(edge[a]), int(edge[a + 1]) if a + 1 < len(edge) else len(h)
                    block = np.unique(rank[low:high])
                    r = int(doc[low])
                    for x, share in own.scan(block[block < len(own.terms)]):
                        found[i + r].append({"line": int(line[low] - first[r]), "label": own.labels[x], "containment": share})
                if wrapped:
                    for w, x, share in own.wrapped(rank, doc, line):
                        r = int(doc[w])
                        found[i + r].append({"line": int(line[w] - first[r]), "label": own.labels[x], "containment": share})
            joined = lambda s: ",".join(sorted(s))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(keep)],
                    pa.array(n_words),
                    pa.array([len(p) for p in places], pa.int64()),
                    pa.array([min(p, default=None) for p in places], pa.int64()),
                    pa.array([max(p, default=None) for p in places], pa.int64()),
                    pa.array([joined(b) for b in base], pa.string()),
                    pa.array([joined(b | {x["label"] for x in f}) for b, f in zip(base, found)], pa.string()),
                    pa.array([1.0 if b else max((x["containment"] for x in f), default=0.0) for b, f in zip(base, found)], pa.float64()),
                    pa.array(found, blocks),
                ],
                names=[*(f"_{c}" for c in keep), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"],
            )

    out = frame.mapInArrow(
        run,
        f"{types}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "blocks array<struct<line:bigint,label:string,containment:double>>",
    )
    return out.select(*(F.col(f"_{c}").alias(c) for c in keep), *out.columns[len(keep) :])


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"), wrapped=True).drop("blocks")
