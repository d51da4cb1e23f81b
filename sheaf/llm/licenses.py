"""License scans by a positional index of rare words.

Texts are lower-cased (A-Z) and taken as words of letters, digits and all beyond ASCII. A template is a
license notice or a paragraph of a license, with key phrases that have to stand in it word by word. It is
found at a place of a text if all words of its key phrases stand there, at their positions; its cover is the
share of its words that stand at theirs (words before the text or behind it count as missing). A template
whose cover is ``min_cover`` or more gives its label. The score of a text is the greatest cover found, 0 without.

How places are found: each word of a template that a key phrase holds has a document frequency, counted over
the whole corpus. Of the license words a text may hold, those of the highest IDF are looked up: for every
template the ``anchors`` rarest places of its key phrases (ties: the first). Their postings are pairs of template and
position; word ``i`` of a text with a posting at position ``p`` says that the template may begin at ``i - p``. The beginnings
that all anchors of a template agree on are kept, the key phrases are verified word by word, and the cover is
counted. Anchors are words that every find has to hold, so the index misses no find.

``PHRASES`` are the base: their places count, wherever they stand, and their labels always hold.

The corpus is read twice, once to count and once to look up; only counts of the templates' words move (a few
hundred rows a task), texts stay where they are. Words are compared by 128 bits of hash.

Null and empty texts have no words, no labels and a score of 0. Rows are judged one by one, so repeated rows have equal
results; they count in the frequencies. Other columns stay; the four added ones replace columns of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.arrays import ALNUM, Slice, counts_by_row, hashes, slices, words
from sheaf.llm.tables import add_by_text, quoted

ANCHORS = 3
MIN_COVER = 0.5

#: Base phrases and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)


@dataclass(frozen=True)
class Template:
    """A notice or paragraph; ``keys`` are phrases of it that have to stand in place."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Notices as their licenses word them.
TEMPLATES = (
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("mit", "Licensed under the MIT License.", ("licensed under the mit",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("licensed under the apache license", "2 0")),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        ("except in compliance with the license", "apache org licenses license 2 0"),
    ),
    Template(
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ("required by applicable law or agreed to in writing", "without warranties or conditions of any kind"),
    ),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation",
        ("redistribute it and or modify it under the terms of the gnu general public license",),
    ),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation",
        ("under the terms of the gnu lesser general public license",),
    ),
    Template(
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation",
        ("under the terms of the gnu affero general public license",),
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("terms of the mozilla public license v 2 0",),
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered software released into the public domain",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    Template("cc0-1.0", "Licensed under CC0 1.0.", ("cc0 1 0",)),
)

ADDED = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("places", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("label", T.StringType())]), False), False),
    T.StructField(
        "finds",
        T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("label", T.StringType()), T.StructField("cover", T.DoubleType())]), False),
        False,
    ),
    T.StructField("labels", T.ArrayType(T.StringType(), False), False),
]

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOW))


def key_places(t: Template) -> list[int]:
    """Positions of the words of the key phrases, each phrase where it first stands."""
    own, out = word_list(t.text), set()
    for phrase in t.keys:
        key = word_list(phrase)
        at = next((i for i in range(len(own) - len(key) + 1) if own[i : i + len(key)] == key), None)
        if not key or at is None:
            raise ValueError(f"{phrase!r} does not stand in {t.text!r}")
        out.update(range(at, at + len(key)))
    return sorted(out)


def hash_words(items: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    if not items:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    (s,) = slices(pa.array([" ".join(items)]), 1 << 40)
    spans = words(s, ALNUM)
    return hashes(s.data, spans, 0), hashes(s.data, spans, 1)


class Vocabulary:
    """Words by number; 128-bit hashes of a slice are turned into these numbers, or -1."""

    def __init__(self, items: set[str]) -> None:
        self.words = sorted(items)
        h1, h2 = hash_words(self.words)
        self.order = np.argsort(h1, kind="stable")
        self.h1, self.h2 = h1[self.order], h2[self.order]

    def number(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1)
        if len(self.h1):
            at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
            same = (self.h1[at] == h1) & (self.h2[at] == h2)
            out[same] = self.order[at[same]]
        return out


def template_words(templates: Sequence[Template]) -> Vocabulary:
    return Vocabulary({w for t in templates for w in word_list(t.text)} | {w for p, _ in PHRASES for w in word_list(p)})


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """How many documents there are, and in how many each word of the vocabulary stands. Every task sends its
    sums, so what reaches the driver is a row a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for s in slices(batch.column(0)):
                low = s.lower()
                spans = words(low, ALNUM)
                known = vocabulary.number(hashes(low.data, spans, 0), hashes(low.data, spans, 1))
                at = np.flatnonzero(known >= 0)
                pair = np.unique(spans.row[at] * len(vocabulary.words) + known[at])
                total[:-1] += np.bincount(pair % len(vocabulary.words), minlength=len(vocabulary.words))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "n"])

    counted = docs.select(F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, "word bigint, n bigint")
    sums = {r.word: r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return sums.get(len(vocabulary.words), 0), {w: sums.get(i, 0) for i, w in enumerate(vocabulary.words)}


@dataclass
class Index:
    """Words of all templates by number, and the postings of anchors. ``offset`` is where a template's words begin."""

    vocabulary: Vocabulary
    label: list[str]
    body: np.ndarray
    is_key: np.ndarray
    offset: np.ndarray
    post_word: np.ndarray
    post_template: np.ndarray
    post_place: np.ndarray
    anchors: np.ndarray


def build_index(templates: Sequence[Template], vocabulary: Vocabulary, n_docs: int, frequency: dict[str, int], anchors: int = ANCHORS) -> Index:
    number = {w: i for i, w in enumerate(vocabulary.words)}
    idf = {w: float(np.log((n_docs + 1) / (frequency.get(w, 0) + 1))) for w in vocabulary.words}
    body, is_key, offset, post, used = [], [], [0], [], []
    for k, t in enumerate(templates):
        own, keys = word_list(t.text), key_places(t)
        body += [number[w] for w in own]
        is_key += [i in set(keys) for i in range(len(own))]
        offset.append(len(body))
        chosen = sorted(keys, key=lambda i: (-idf[own[i]], i))[:anchors]
        used.append(len(chosen))
        post += [(number[own[i]], k, i) for i in chosen]
    word, template, place = np.array(sorted(post), np.int64).reshape(-1, 3).T
    return Index(vocabulary, [t.label for t in templates], np.array(body), np.array(is_key, bool), np.array(offset), word, template, place, np.array(used))


def find_templates(index: Index, known: np.ndarray, row: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Finds in a slice whose words have the numbers ``known``: row, beginning (word of the row), template, words in place."""
    at = np.flatnonzero(known >= 0)
    lo, hi = np.searchsorted(index.post_word, known[at]), np.searchsorted(index.post_word, known[at], side="right")
    n = hi - lo
    at, post = np.repeat(at, n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    begin = at - first[row[at]] - index.post_place[post]
    claim, votes = np.unique(np.stack([row[at], index.post_template[post], begin]), axis=1, return_counts=True)
    claim = claim[:, votes == index.anchors[claim[1]]]  # a place votes once for a beginning, so all anchors agree
    in_row, template, begin = claim
    length = index.offset[template + 1] - index.offset[template]
    claims = np.repeat(np.arange(len(length)), length)
    inner = np.arange(len(claims)) - np.repeat(np.cumsum(length) - length, length)
    place = begin[claims] + inner
    inside = (place >= 0) & (place < size[in_row[claims]])
    want = index.offset[template[claims]] + inner
    same = np.zeros(len(claims), bool)
    same[inside] = known[(first[in_row[claims]] + place)[inside]] == index.body[want[inside]]
    broken = np.bincount(claims, weights=index.is_key[want] & ~same, minlength=len(length)) > 0
    matched = np.bincount(claims, weights=same, minlength=len(length)).astype(np.int64)
    whole = np.flatnonzero(~broken)
    return [in_row[whole], begin[whole], template[whole], matched[whole]]


def phrase_places(known: np.ndarray, row: np.ndarray, phrases: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a phrase begins, and which phrase; by place, then phrase."""
    at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, phrase in enumerate(phrases):
        n = len(known) - len(phrase) + 1
        if n > 0:
            hit = row[:n] == row[len(phrase) - 1 :]
            for i, w in enumerate(phrase):
                hit &= known[i : i + n] == w
            at.append(np.flatnonzero(hit))
            which.append(np.full(len(at[-1]), k))
    at, which = np.concatenate(at), np.concatenate(which)
    by = np.lexsort((which, at))
    return at[by], which[by]


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: Sequence[Template] = TEMPLATES, min_cover: float = MIN_COVER, anchors: int = ANCHORS) -> DataFrame:
    """``docs`` with ``n_words``, ``places`` (base phrases: first word, label), ``finds`` (templates: first word, which may lie
    before the text, label, cover) and ``labels`` (distinct, sorted: of the phrases, and of finds with ``min_cover`` or more)."""
    vocabulary = template_words(templates)
    index = build_index(templates, vocabulary, *document_frequencies(docs, vocabulary, text_col), anchors)
    number = {w: i for i, w in enumerate(vocabulary.words)}
    phrases = [[number[w] for w in word_list(p)] for p, _ in PHRASES]
    base = np.array([label for _, label in PHRASES])
    own = np.array(index.label, dtype=str)

    def work(s: Slice) -> list[pa.Array]:
        low = s.lower()
        spans = words(low, ALNUM)
        size = counts_by_row(spans.row, s.rows)
        first = np.cumsum(size) - size
        known = vocabulary.number(hashes(low.data, spans, 0), hashes(low.data, spans, 1))
        at, which = phrase_places(known, spans.row, phrases)
        row, begin, template, matched = find_templates(index, known, spans.row, first, size)
        by = np.lexsort((template, begin, row))
        row, begin, template, matched = row[by], begin[by], template[by], matched[by]
        cover = matched / (index.offset[template + 1] - index.offset[template])
        labels: list[set[str]] = [set() for _ in range(s.rows)]
        for r, label in zip(spans.row[at].tolist(), base[which].tolist(), strict=True):
            labels[r].add(label)
        good = cover >= min_cover
        for r, label in zip(row[good].tolist(), own[template[good]].tolist(), strict=True):
            labels[r].add(label)
        return [
            pa.array(size),
            _lists(spans.row[at], s.rows, {"start": pa.array(at - first[spans.row[at]]), "label": pa.array(base[which].tolist(), pa.string())}),
            _lists(row, s.rows, {"start": pa.array(begin), "label": pa.array(own[template].tolist(), pa.string()), "cover": pa.array(cover, pa.float64())}),
            pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
        ]

    return add_by_text(docs, text_col, ADDED, work)


def _lists(row: np.ndarray, rows: int, fields: dict[str, pa.Array]) -> pa.Array:
    """Structs gathered into a list a row; they come sorted by row."""
    where = np.concatenate([[0], np.cumsum(counts_by_row(row, rows))])
    return pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.StructArray.from_arrays([*fields.values()], names=[*fields]))


def license_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: n_words, n_base (places of base phrases), the first and last of them, base_labels, labels and score."""
    found = scan_licenses(docs.select("doc_id", "text"), **options)
    starts = F.col("places.start")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.coalesce(F.array_max("finds.cover"), F.lit(0.0)).alias("score"),
    )
