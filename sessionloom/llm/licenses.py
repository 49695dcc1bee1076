"""Licence scan: a trained paragraph classifier, a calibrated unknown class, and template comparison as confirmation.

A paragraph is a line, or a run of lines into which a notice is wrapped. Sparse word and word-pair features go into a multinomial logistic regression over licence families and
`none`; it is trained on filled-in variants of short notices and on paragraphs of a bounded corpus sample. Leaving families
out in turn shows how sure the model gets about licences it does not know; below that level, or where no template of the
family resembles the paragraph, the answer is `unknown`. Documents are scanned in place: every line alone and joined with the
lines behind it, as far as a notice can reach.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package
from .linear import fit_softmax, softmax

NONE, UNKNOWN = "none", "unknown"

#: Short notices by family; {year} and {holder} are filled in.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this "
                   "file except in compliance with the License", "This project is released under the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License", "This software is licensed under the MIT License", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in "
            "the Software without restriction", "Distributed under the terms of the MIT license"],
    "bsd": ["Licensed under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license", "Released under the BSD 2-Clause License",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it "
            "under the terms of the GNU General Public License", "Licensed under the GPL v3", "Released under the GNU GPL version 2 or later",
            "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1", "This library is free software under the terms of the LGPL",
             "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3", "Released under the AGPL v3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", "Licensed under the MPL 2.0",
                "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "Text available under CC-BY 3.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0",
                 "Content is available under CC BY-SA 3.0 unless otherwise noted"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0",
                 "Shared under CC BY-NC 3.0 for non commercial use"],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0 Universal", "Released under CC0", "No rights reserved, public domain dedication"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Released under the Unlicense"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            "Licensed under the ISC License"],
    "proprietary": ["All rights reserved", "Copyright {year} {holder}. All rights reserved", "No part of this publication may be reproduced without permission",
                    "Confidential and proprietary, unauthorized copying is prohibited"],
}
#: Corpus documents and paragraphs sampled for `none`; variants made of each notice.
SAMPLE_DOCS, SAMPLE_LINES, VARIANTS = 300, 3000, 16
#: A paragraph must contain this share of a template's word pairs.
SIMILAR = 0.6
_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)?")
_CUE = re.compile(r"(?i)licen[cs]e|copyright|rights reserved|permission|redistribut|public domain|creative commons|spdx|\bgpl\b")


class Model(NamedTuple):
    """``families`` (the last is `none`), feature numbers, weights (features + 1, families), the least probability of a known
    family, and word pairs of the templates by family."""

    families: list[str]
    features: dict[str, int]
    weights: np.ndarray
    sure: float
    pairs: dict[str, list[frozenset]]


def tokens(paragraph: str) -> list[str]:
    return _TOKEN.findall(paragraph.lower())


def grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def variants(notice: str, rng: random.Random, count: int) -> list[str]:
    """Filled-in copies of a notice, some with a lead or a tail, a word dropped, or other case."""
    out = []
    for _ in range(count):
        text = notice.replace("{year}", str(rng.randrange(1990, 2030))).replace("{holder}", " ".join(rng.choices(["Example", "Acme", "North", "Labs", "Press"], k=2)))
        words = text.split()
        if len(words) > 6 and rng.random() < 0.4:
            words.pop(rng.randrange(len(words)))
        lead = rng.choice(["", "", "", f"Copyright (c) {rng.randrange(1990, 2030)} the authors.", "Notice:", "Note that"])
        tail = rng.choice(["", "", "", "See the LICENSE file for details.", "."])
        text = " ".join(x for x in (lead, " ".join(words), tail) if x)
        out.append(rng.choice([text, text, text.lower(), text.upper()]))
    return out


def _matrix(rows: list[list[str]], features: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(rows), len(features)), dtype=np.float32)
    for i, row in enumerate(rows):
        x[i, [features[g] for g in row if g in features]] = 1
    return x


def fit(negatives: list[str], templates: dict[str, list[str]] | None = None, seed: int = 5) -> Model:
    """Model from the notices and from paragraphs that hold no licence."""
    templates = templates or TEMPLATES
    rng = random.Random(seed)
    families = [*templates, NONE]
    texts, labels = [], []
    for k, notices in enumerate(templates.values()):
        made = [v for n in notices for v in variants(n, rng, VARIANTS)]
        texts += made
        labels += [k] * len(made)
    plain = [t for t in negatives if not _CUE.search(t)] + ["Note that", "See the file for details.", "This is a work.", "Version 2.0", "Use of this", "the source code"]
    # Short and unfamiliar paragraphs hold no licence either.
    plain += [" ".join(t.split()[:2]) for t in plain[::3]] + [""] * 100
    texts += plain
    labels += [len(templates)] * len(plain)
    rows = [grams(tokens(t)) for t in texts]
    # Word pairs of the notices, and the words of both sides that are common enough.
    found = Counter(g for row, k in zip(rows, labels, strict=True) if k < len(templates) for g in set(row))
    other = Counter(g for row, k in zip(rows, labels, strict=True) if k == len(templates) for g in set(row) if " " not in g)
    chosen = {g for g, n in found.items() if n >= 3} | {g for g, _ in other.most_common(500)}
    features = {g: i for i, g in enumerate(sorted(chosen))}
    x, y = _matrix(rows, features), np.array(labels)
    weight = 1 / np.bincount(y, minlength=len(families))[y] * np.where(y == len(templates), len(templates), 1)
    weights = fit_softmax(x, y, len(families), weight)

    # How sure a model gets about families that it never saw, against how sure it is about those it knows.
    strange, known = [], []
    for fold in range(4):
        out = np.isin(y, np.arange(fold, len(templates), 4))
        part = fit_softmax(x[~out], y[~out], len(families), weight[~out], steps=80)
        p = softmax(np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1) @ part)[:, :-1].max(axis=1)
        strange.append(p[out])
        known.append(p[~out & (y < len(templates))])
    sure = min(float(np.quantile(np.concatenate(strange), 0.9)), float(np.quantile(np.concatenate(known), 0.05)))
    pairs = {f: [frozenset(zip(w, w[1:], strict=False)) for n in notices if len(w := tokens(n.replace("{year}", "").replace("{holder}", ""))) > 1]
             for f, notices in templates.items()}
    return Model(families, features, weights, sure, pairs)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Model:
    """Model whose `none` paragraphs are ``sample_lines`` whole lines at most of ``sample_docs`` documents drawn by hash of the key."""
    order = F.xxhash64(F.lit("licence"), F.col(key).cast("string"))
    ids = docs.select(key).where(F.col(key).isNotNull()).orderBy(order, key).limit(sample_docs)
    lines = docs.select(key, F.explode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line")).join(F.broadcast(ids), key)
    drawn = lines.where("trim(line) <> ''").select("line").orderBy(F.xxhash64("line"), "line").limit(sample_lines)
    return fit([r[0] for r in drawn.collect()])


def resemblance(words: list[str], templates: list[frozenset]) -> float:
    """Largest share of a template's word pairs that stand in the paragraph."""
    mine = set(zip(words, words[1:], strict=False))
    return max((len(t & mine) / len(t) for t in templates), default=0.0)


def matched(words: list[str], templates: list[frozenset]) -> tuple[int, int]:
    """First and last word of the shortest part with all pairs that the paragraph shares with the template it resembles most."""
    pairs = list(zip(words, words[1:], strict=False))
    mine = set(pairs)
    shared = max(templates, key=lambda t: len(t & mine) / len(t)) & mine
    last: dict[tuple[str, str], int] = {}
    parts = []
    for i, pair in enumerate(pairs):
        if pair in shared:
            last[pair] = i
            if len(last) == len(shared):
                parts.append((min(last.values()), i + 1))
    return min(parts, key=lambda part: part[1] - part[0])


class Scanner:
    """Scores paragraphs; those that cannot reach half a chance of any licence are told apart by a sum of gains.

    ``span`` is the most words that a notice may have: those of the longest template, when it is ``SIMILAR`` at least.
    """

    def __init__(self, model: Model):
        self.model = model
        margin = model.weights[:, :-1] - model.weights[:, -1:]
        gain = np.maximum(margin.max(axis=1), 0)
        self.gain = {g: (float(gain[i]), i) for g, i in model.features.items()}
        self.floor = -math.log(len(model.families) - 1) - float(margin[-1].max())
        self.span = math.ceil((1 + max((len(t) for p in model.pairs.values() for t in p), default=0)) / SIMILAR)

    def __call__(self, paragraph: str) -> tuple[str, float, float] | None:
        """(family or `unknown`, probability, resemblance), or None for a paragraph without licence."""
        hit = self.judge(tokens(paragraph))
        return hit and hit[:3]

    def reach(self, words: list[str]) -> float:
        """Sum of the gains of the words and word pairs, each once."""
        return sum(self.gain[g][0] for g in {g for g in grams(words) if g in self.gain})

    def judge(self, words: list[str]) -> tuple[str, float, float, int, int] | None:
        """The same for a paragraph's words, and the first and last word of the notice (`unknown`: of the paragraph)."""
        found = {g: self.gain[g] for g in grams(words) if g in self.gain}
        if sum(v[0] for v in found.values()) <= self.floor:
            return None
        z = self.model.weights[[i for _, i in found.values()]].sum(axis=0) + self.model.weights[-1]
        p = softmax(z[None, :])[0]
        if p[-1] >= 0.5:
            return None
        best = int(p[:-1].argmax())
        family = self.model.families[best]
        likeness = resemblance(words, self.model.pairs[family])
        if p[best] < self.model.sure or likeness < SIMILAR:
            return UNKNOWN, float(p[best]), likeness, 0, len(words) - 1
        return family, float(p[best]), likeness, *matched(words, self.model.pairs[family])

    def across(self, words: list[str], head: int, tail: int) -> tuple[str, float, float, int, int] | None:
        """The same for a run of lines: a known notice begins in the first ``head`` words and ends in the last ``tail``; the
        words around it are left out where they hide it."""
        hit = self.judge(words)
        whole = [hit] if hit and hit[0] != UNKNOWN else []
        for family, templates in () if whole else self.model.pairs.items():
            if resemblance(words, templates) >= SIMILAR:
                lo, hi = matched(words, templates)
                if (part := self.judge(words[lo:hi + 1])) and part[0] == family:
                    whole.append((*part[:3], lo + part[3], lo + part[4]))
        whole = [h for h in whole if h[3] < head and h[4] >= len(words) - tail]
        return max(whole, key=lambda h: (h[2], h[1])) if whole else hit if hit and hit[0] == UNKNOWN else None

    def notices(self, text: str) -> list[tuple[int, str, float, float]]:
        """(line where it begins, family or `unknown`, probability, resemblance) of every notice, in order.

        Every line is judged alone, and joined with the lines behind it while those between the first and the last hold fewer
        words than ``span``; a line without words ends a paragraph. The first and the last line of such a run count with the
        ``span`` words next to the line break. Of findings that share words the one of a known family, of the largest
        resemblance (an `unknown` has none), of the fewest lines stands.
        """
        lines = [tokens(line) for line in text.split("\n")]
        gains = [self.reach(words) for words in lines]
        starts = np.cumsum([0] + [len(words) for words in lines]).tolist()
        hits = []
        for i, words in enumerate(lines):
            if gains[i] > self.floor and (hit := self.judge(words)):
                hits.append((i, i, starts[i], hit))
            most = gains[i]
            for j in range(i + 1, len(lines)):
                if not lines[j - 1] or not lines[j] or starts[j] - starts[i + 1] >= self.span:
                    break
                # No more than the lines and the pairs across their breaks can gain.
                most += gains[j] + self.gain.get(f"{lines[j - 1][-1]} {lines[j][0]}", (0.0,))[0]
                if most <= self.floor:
                    continue
                head, tail = words[-self.span:], lines[j][:self.span]
                if hit := self.across(head + [w for line in lines[i + 1:j] for w in line] + tail, len(head), len(tail)):
                    hits.append((i, j, starts[i + 1] - len(head), hit))
        hits.sort(key=lambda h: (h[3][0] == UNKNOWN, 0 if h[3][0] == UNKNOWN else -h[3][2], h[1] - h[0], -h[3][1], h[0]))
        taken = bytearray(starts[-1])
        out = []
        for i, _, at, (family, probability, likeness, first, last) in hits:
            if taken.find(1, at + first, at + last + 1) < 0:
                taken[at + first:at + last + 1] = b"\1" * (last + 1 - first)
                out.append((bisect_right(starts, at + first) - 1 if family != UNKNOWN else i, family, probability, likeness))
        return sorted(out)


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, paragraph, family, probability, resemblance) of every notice; its paragraph is the line, from 0, where it begins.

    Null and empty texts and blank lines hold none; a notice may be wrapped into several lines. Repeated rows give repeated
    findings, an empty table none; other columns are not read. Lines are read whole, however long.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            rows = []
            for i, body in enumerate(batch.column("text").to_pylist()):
                rows.extend((i, *notice) for notice in (scanner.notices(body) if body else ()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.float64())],
                names=["key", "paragraph", "family", "probability", "resemblance"])

    narrow = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return narrow.mapInArrow(task, "key bigint, paragraph bigint, family string, probability double, resemblance double").withColumnRenamed("key", key)
