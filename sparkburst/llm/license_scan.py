"""License scan: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkburst.llm.common import dropped, stored, texts_of, trimmed, without
from sparkburst.llm.terms import term_pieces, term_table

#: A block meets a notice if it holds this share of the notice's distinct words.
CONTAINMENT = 0.8
#: Words by which blocks of a template advance: the smallest that is no less than the template's words. Blocks are twice as long.
STRIDES = (8, 128, 1024)
#: Most words that all templates may have together; their index is sent to every task.
TEMPLATE_WORDS = 100_000

#: Phrases of which each place counts, with their labels.
BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Statements whose words must stand in a row.
STATEMENTS = (
    ("apache license version 2 0", "apache-2.0"), ("gnu general public license version 2", "gpl-2.0"), ("gnu general public license version 3", "gpl-3.0"), ("gnu lesser general public license", "lgpl"),
    ("cc by 4 0", "cc-by-4.0"), ("cc by nc 4 0", "cc-by-nc-4.0"), ("cc by sa 4 0", "cc-by-sa-4.0"), ("bsd license", "bsd"), ("mozilla public license", "mpl"),
)
#: Notices as their licenses word them.
NOTICES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "bsd"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "apache-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "gpl-3.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl-2.0"),
    ("This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.", "cc-by-4.0"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unlicense"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so", "bsl-1.0"),
)

_TABLE = term_table(digits=True)
_MATCH = pa.struct([("template", pa.int32()), ("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())])
_MATCH_DDL = "array<struct<template: int, label: string, base: boolean, first: bigint, n_words: bigint, containment: double>>"


@dataclass(frozen=True)
class Template:
    """A text to find. in_a_row: its words must stand in this order without others between; else a block that holds the
    share `containment` of its distinct words meets it. base marks phrases that are reported apart."""

    text: str
    label: str
    containment: float = CONTAINMENT
    in_a_row: bool = False
    base: bool = False

    @property
    def words(self) -> list[bytes]:
        return [w for piece in term_pieces(self.text, _TABLE) for w in piece]


TEMPLATES = (
    *(Template(t, x, 1.0, True, True) for t, x in BASE_PHRASES),
    *(Template(t, x, 1.0, True) for t, x in STATEMENTS),
    *(Template(t, x) for t, x in NOTICES),
)


def stride_of(n_words: int) -> int:
    return next((s for s in STRIDES if s >= n_words), n_words)


class _Index:
    """Templates as ascending ranks (rarest word first), and which of them have a word in their prefix."""

    def __init__(self, templates: Sequence[Template], counts: dict[bytes, int]):
        split = [t.words for t in templates]
        ordered = sorted({w for words in split for w in words}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(ordered)}
        self.templates, self.sets, self.rows, self.needed = templates, [], [], []
        self.strides = [stride_of(len(words)) for words in split]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (t, words) in enumerate(zip(templates, split, strict=True)):
            ranks = np.unique(np.array([self.rank[w] for w in words], np.int32))
            need = max(1, math.ceil(t.containment * len(ranks) - 1e-9))
            self.sets.append(ranks)
            self.rows.append(np.array([self.rank[w] for w in words], np.int32))
            self.needed.append(need)
            for i, r in enumerate(ranks[: len(ranks) - need + 1].tolist()):
                self.prefix.setdefault(r, []).append((k, i))
        self.asked = {w for w in ordered if self.rank[w] in self.prefix}
        self.is_prefix = np.zeros(len(ordered) + 1, bool)
        self.is_prefix[list(self.prefix)] = True

    def matches(self, ranks: np.ndarray) -> list[dict]:
        """Every block and template that meet. ranks: a text's words, -1 for those in no template."""
        met: dict[tuple[int, int], int] = {}
        for p in np.flatnonzero(self.is_prefix[ranks]).tolist():
            for k, i in self.prefix[int(ranks[p])]:
                at = p // self.strides[k]
                for block in (at, at - 1) if at else (at,):
                    met[k, block] = min(i, met.get((k, block), i))
        held: dict[tuple[int, int], np.ndarray] = {}
        out = []
        for (k, block), i in sorted(met.items()):
            step, own, need = self.strides[k], self.sets[k], self.needed[k]
            a, b = block * step, min(len(ranks), block * step + 2 * step)
            if (step, block) not in held:
                inside = np.unique(ranks[a:b])
                held[step, block] = inside[inside >= 0]
            inside = held[step, block]
            j = int(np.searchsorted(inside, own[i]))  # the first word of the prefix that both have
            if len(inside) < need or 1 + min(len(own) - i - 1, len(inside) - j - 1) < need:
                continue
            common = int(np.isin(own, inside, assume_unique=True).sum())
            if common < need:
                continue
            t, row = self.templates[k], self.rows[k]
            if t.in_a_row:
                last = min(a + step, len(ranks) - len(row) + 1)
                starts = np.flatnonzero(np.all([ranks[a + x : last + x] == w for x, w in enumerate(row)], axis=0)) + a if last > a else ()
                out += [{"template": k, "label": t.label, "base": t.base, "first": int(s), "n_words": len(row), "containment": 1.0} for s in starts]
            else:
                out.append({"template": k, "label": t.label, "base": t.base, "first": a, "n_words": b - a, "containment": common / len(own)})
        return out


def _counted(names: frozenset[bytes]):
    """(word, n): how often each of names stands in a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in texts_of(batch):
                for piece in term_pieces(text, _TABLE):
                    found.update([w for w in piece if w in names])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return trimmed(run)


def _scanned(index, text: str, carried: list[str]):
    def ranks(piece: list[bytes]) -> np.ndarray:
        get = index.value.rank.get
        return np.fromiter((get(w, -1) for w in piece), np.int32, len(piece))

    def one(value: str | None) -> tuple[int, list[dict]]:
        pieces = term_pieces(value, _TABLE)
        first = next(pieces)
        rest = [ranks(x) for x in pieces]
        if not rest and index.value.asked.isdisjoint(first):
            return len(first), []
        whole = np.concatenate([ranks(first), *rest])
        return len(whole), index.value.matches(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t) for t in texts_of(batch, text)]
            n, matches = pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(_MATCH))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carried), n, matches], [*carried, "n_words", "licenses"])

    return trimmed(run)


def scan_licenses(df: DataFrame, templates: Sequence[Template] = TEMPLATES, text: str = "text") -> DataFrame:
    """df with n_words and licenses: every block of the text that meets a template, as (template's number, label, base,
    first word from 0, n_words, containment); for a template in a row every place where it stands.

    A template of w words has blocks of twice its stride (see STRIDES), which advance by the stride, so that any w words in a
    row lie in one block. Words are ordered by how often they stand in all texts, rarest first. A block that holds `need`
    of a template's distinct words shares one of the template's first size - need + 1 (prefix filter): only such blocks
    are built. They need `need` template words at all (length filter) and enough words behind the first shared one on
    both sides (positional filter); then the overlap is counted, and for templates in a row the order is compared.

    Both passes over the texts run where the rows lie. The driver and the tasks hold the templates and one count for each of
    their words, at most TEMPLATE_WORDS; more is an error. Null and empty texts have no words and meet nothing; templates
    without words meet nothing; repeated rows are scanned alike; a text over a MB is split in pieces and its words are
    held as four bytes each. Columns of df named as an output are replaced, all others stay. An empty table gives no rows.
    """
    templates = [t for t in templates if t.words]
    names = frozenset(w for t in templates for w in t.words)
    if sum(len(t.words) for t in templates) > TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {TEMPLATE_WORDS} words")
    spark = df.sparkSession
    found = stored(df.select(F.col(text).alias("text")).mapInArrow(_counted(names), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    counts = {bytes(r["word"]): r["n"] for r in found.collect()}
    dropped(found)
    index = spark.sparkContext.broadcast(_Index(templates, counts))
    carried = without(df, "n_words", "licenses")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in carried]
    return df.select(*(F.col(f"`{c}`") for c in df.columns)).mapInArrow(_scanned(index, text, carried), ", ".join([*fields, "n_words bigint", f"licenses {_MATCH_DDL}"]))


def license_report(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row per document: places of the base phrases, labels of both kinds, and as score the best containment of a
    template that is met, or 0."""
    base = F.filter("licenses", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["first"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    best = F.array_max(F.transform("licenses", lambda m: m["containment"]))
    return scan_licenses(docs.select("doc_id", "text"), templates).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("licenses")).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"),
    )
