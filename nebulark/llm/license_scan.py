"""License scans: a trained paragraph classifier with an unknown class and a template check.

Paragraphs become sparse word n-grams; a multinomial logistic regression over them names a
licence family or ``unknown``.  It is trained here on cut and noised templates of the families and
on a bounded sample of the corpus' own paragraphs as ``unknown``; a temperature and a threshold fitted
on templates and paragraphs that its model was not taught calibrate it.  A prediction stands only if a template of the family shares
enough of its words in order with the paragraph.  A paragraph is the stretch of a text, over line
ends and inside long lines, in which a template's word pairs lie close together, with a few words
around it; a line without such a stretch is one paragraph.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulark.llm._common import mapped, text_of

#: Documents whose paragraphs teach the unknown class, and paragraphs taken from them, at most.
UNKNOWN_DOCS = 500
UNKNOWN_PARAGRAPHS = 4000
#: Lines are cut into pieces of so many characters there.
PIECE = 400
#: Noised copies of each template.
COPIES = 60
#: Share of a template's word pairs that must be in the paragraph.
CONFIRM = 0.6
#: A notice may be so many times longer than its template; the classifier also sees so many words on each side.
REACH = 2
CONTEXT = 4
UNKNOWN = "unknown"

# Usual notices of public licences, by family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GNU GPL v2 or later.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the 3-clause BSD License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "SPDX-License-Identifier: ISC",
    ),
    "EPL": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License", "SPDX-License-Identifier: EPL-2.0"),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ),
    "WTFPL": ("Licensed under the Do What The Fuck You Want To Public License, Version 2.", "SPDX-License-Identifier: WTFPL"),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY 3.0.",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY-SA 3.0.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released into the public domain under CC0 1.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "proprietary": ("All rights reserved. No part of this work may be reproduced without written permission.", "Copyright (c) 2020 Example Inc. All rights reserved.", "This document is proprietary and confidential."),
}
_TOKEN = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")


def tokens(paragraph: str) -> list[str]:
    return _TOKEN.findall(paragraph.lower())


def ngrams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


@dataclass
class Model:
    families: list[str]  # the last is UNKNOWN
    place: dict[str, int]
    weights: np.ndarray  # features x families
    bias: np.ndarray
    temperature: float
    threshold: float

    def known(self, words: list[str]) -> list[int]:
        """Places of the model's n-grams in the words; none if no pair of words is known."""
        place = self.place
        pairs = [p for g in map(" ".join, zip(words, words[1:], strict=False)) if (p := place.get(g)) is not None]
        return pairs and list(dict.fromkeys(pairs + [p for w in words if (p := place.get(w)) is not None]))

    def logits(self, words: list[str], features: list[int]) -> np.ndarray:
        """The features' mean weight: long paragraphs around a notice dilute it slowly."""
        return self.bias + self.weights[features].sum(axis=0) / np.sqrt(max(1.0, len(words) / 8))

    def judge(self, paragraph: str) -> tuple[str, float, bool]:
        """Family, calibrated probability and whether a template confirms it.

        A paragraph without any word pair of the templates is unknown: it has no evidence for a family.
        """
        return self.judge_words(tokens(paragraph))

    def judge_words(self, words: list[str]) -> tuple[str, float, bool]:
        features = self.known(words)
        if not features:
            return UNKNOWN, 1.0, False
        z = self.logits(words, features) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p[:-1].argmax())
        if p[best] < self.threshold:
            return UNKNOWN, float(p[-1]), False
        return self.families[best], float(p[best]), confirmed(words, self.families[best])


_PAIRS = {f: [set(zip(w, w[1:], strict=False)) for w in map(tokens, ts)] for f, ts in TEMPLATES.items()}


_WANTED = [t for ts in _PAIRS.values() for t in ts if t]
#: The templates (places in _WANTED) of each word pair.
_OWNERS = {p: [k for k, t in enumerate(_WANTED) if p in t] for t in _WANTED for p in t}


def confirmed(words: list[str], family: str) -> bool:
    have = set(zip(words, words[1:], strict=False))
    return any(len(have & t) >= CONFIRM * len(t) for t in _PAIRS[family] if t)


def spans(hits: list[tuple[int, tuple[str, str]]]) -> list[tuple[int, int, int]]:
    """(pairs found, start, end) of the stretches of words that hold enough of a template, from its pairs' places; best first."""
    places: dict[int, list[tuple[int, tuple[str, str]]]] = {}
    for hit in hits:
        for k in _OWNERS[hit[1]]:
            places.setdefault(k, []).append(hit)
    out = []
    for k, seen in places.items():
        size = len(_WANTED[k])
        if len(seen) < CONFIRM * size:
            continue
        left, held = 0, {}
        for i, pair in seen:
            held[pair] = held.get(pair, 0) + 1
            while i - seen[left][0] >= REACH * (size + 1) or held[seen[left][1]] > 1:
                gone = seen[left][1]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                left += 1
            if len(held) >= CONFIRM * size:
                out.append((len(held), seen[left][0], i + 2))
    return sorted(out, key=lambda x: (-x[0], x[2] - x[1], x[1]))


def notices(m: Model, lines: list[str]) -> list[tuple[float, str]]:
    """(score, family) of each notice in the lines of a text."""
    words, ends = [], []
    for line in lines:
        words += tokens(line)
        ends.append(len(words))
    hits = [(i, g) for i, g in enumerate(zip(words, words[1:], strict=False)) if g in _OWNERS]
    if not hits:
        return []
    found, stretches = [], spans(hits)
    likely, taken = bytearray(len(words)), bytearray(len(words))  # words of the best stretches; of notices
    for _, a, b in stretches:
        if likely.find(1, a, b) < 0:
            likely[a:b] = b"\1" * (b - a)
    for _, a, b in stretches:
        if taken.find(1, a, b) >= 0:
            continue
        # The words around, up to the next likely notice, tell kin apart and cannot outweigh this one.
        low, high = max(likely.rfind(1, 0, a) + 1, a - CONTEXT), likely.find(1, b, b + CONTEXT)
        family, score, ok = m.judge_words(words[low : high if high >= 0 else b + CONTEXT])
        if ok:
            found.append((score, family))
            taken[a:b] = b"\1" * (b - a)
    at = 0
    for start, end in zip([0, *ends], ends, strict=False):
        while at < len(hits) and hits[at][0] < start:
            at += 1
        if at < len(hits) and hits[at][0] < end - 1 and taken.find(1, start, end) < 0:
            family, score, ok = m.judge_words(words[start:end])
            if ok:
                found.append((score, family))
    return found


def _noised(r: np.random.Generator, template: str, filler: list[str]) -> list[str]:
    """A template with a few words lost, changed or added, cut at an end, or set among other words."""
    words = tokens(template)
    if len(words) > 8 and r.random() < 0.4:
        words = words[: r.integers(len(words) * 2 // 3, len(words) + 1)]
    words = [filler[r.integers(len(filler))] if filler and r.random() < 0.03 else w for w in words if r.random() > 0.04]
    if filler and r.random() < 0.4:
        around = [filler[i] for i in r.integers(0, len(filler), r.integers(1, 12))]
        cut = r.integers(0, len(around) + 1)
        words = around[:cut] + words + around[cut:]
    return words


def train(docs: DataFrame, text_col: str = "text", seed: int = 3, steps: int = 250) -> Model:
    """Fit on noised templates and on paragraphs of a bounded, hashed sample of ``docs``."""
    text = text_of(text_col)
    rows = docs.select(F.xxhash64(text, F.lit(seed)).alias("h"), text.alias("whole"))
    edge = rows.select("h").orderBy("h").limit(UNKNOWN_DOCS).agg(F.max("h")).first()[0]  # hashes alone are sorted
    rows = rows.where(F.col("h") <= F.lit(edge if edge is not None else 0)).dropDuplicates(["h"])
    lines = rows.select(F.explode(F.split("whole", "\n")).alias("line")).where("trim(line) <> ''")
    pieces = lines.select(F.explode(F.expr(f"transform(sequence(1, length(line), {PIECE}), i -> substring(line, i, {PIECE}))")).alias("line")).where("trim(line) <> ''")
    lines = pieces.orderBy(F.xxhash64("line"), "line").limit(UNKNOWN_PARAGRAPHS)
    corpus = [tokens(x["line"]) for x in lines.collect()]  # UNKNOWN_PARAGRAPHS pieces of PIECE characters at most
    strong = [set(p) for ts in _PAIRS.values() for p in ts]
    corpus = [w for w in corpus if w and not any(len(set(zip(w, w[1:], strict=False)) & t) >= 0.5 * len(t) for t in strong if t)]
    filler = sorted({w for line in corpus[:500] for w in line})
    r = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN]
    x, y, fold = [], [], []  # fold: 0 or 1 by template; -1 (a family's only template) is always taught
    for k, f in enumerate(families[:-1]):
        for i, template in enumerate(TEMPLATES[f]):
            x += [tokens(template), *(_noised(r, template, filler) for _ in range(COPIES))]
            y += [k] * (COPIES + 1)
            fold += [i % 2 if len(TEMPLATES[f]) > 1 else -1] * (COPIES + 1)
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in ngrams(tokens(t))})
    words = sorted({w for ts in TEMPLATES.values() for t in ts for w in tokens(t)})
    decoys = [[words[i] for i in r.integers(0, len(words), r.integers(3, 15))] for _ in range(1500)]  # the same words in no order
    others = corpus + decoys
    fold = np.array(fold + [i % 2 for i in range(len(others))])
    x, y = x + others, np.array(y + [len(families) - 1] * len(others))
    place = {g: i for i, g in enumerate(vocabulary)}

    def fitted(rows: np.ndarray) -> Model:
        model = Model(families, place, np.zeros((len(place), len(families))), np.zeros(len(families)), 1.0, 0.5)
        _fit(model, [x[i] for i in rows], y[rows], steps)
        return model

    # Calibration sees templates that its model was not taught: each half is judged by the model of the other half.
    z = np.zeros((len(x), len(families)))
    for half in (0, 1):
        model, unseen = fitted(np.flatnonzero(fold != half)), np.flatnonzero(fold == half)
        for i in unseen:
            z[i] = model.logits(x[i], model.known(x[i]) or [])
    model, judged = fitted(np.arange(len(x))), fold >= 0
    _calibrate(model, z[judged], y[judged])
    return model


def _fit(model: Model, x: list[list[str]], y: np.ndarray, steps: int) -> None:
    features = [model.known(w) or [] for w in x]
    row = np.repeat(np.arange(len(x)), [len(f) for f in features])
    col = np.array([i for f in features for i in f], np.int64)
    scale = 1 / np.sqrt(np.maximum(1.0, np.array([len(w) for w in x]) / 8))
    dense = np.zeros((len(x), len(model.place)), np.float32)
    dense[row, col] = scale[row]
    onehot = np.eye(len(model.families), dtype=np.float32)[y]
    weights, bias = model.weights.astype(np.float32), model.bias.astype(np.float32)
    for _ in range(steps):
        z = dense @ weights + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        e = (p / p.sum(axis=1, keepdims=True) - onehot) / np.float32(len(x))
        weights -= np.float32(20.0) * (dense.T @ e + np.float32(1e-5) * weights)
        bias -= np.float32(2.0) * e.sum(axis=0)
    model.weights, model.bias = weights.astype(np.float64), bias.astype(np.float64)


def _calibrate(model: Model, z: np.ndarray, y: np.ndarray) -> None:
    """The temperature with the best likelihood of the unseen rows; the lowest threshold with few false families."""

    def soft(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    model.temperature = min(np.geomspace(0.25, 4, 33), key=lambda t: -np.log(soft(t)[np.arange(len(y)), y] + 1e-12).mean())
    top = soft(model.temperature)[y == len(model.families) - 1, :-1].max(axis=1)
    model.threshold = float(np.clip(np.quantile(top, 0.999) if len(top) else 0.5, 0.5, 0.95))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, family, score, n_paragraphs, n_licences, families.

    ``family`` is that of the confirmed paragraph with the highest score, ``unknown`` (score 0) if there
    is none; ``families`` lists all confirmed families in order.  ``n_paragraphs`` counts lines that are
    not blank, ``n_licences`` notices, each once.  Null and empty texts have no paragraphs.  Ids may be null or repeated; empty input gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 500 n-grams
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            out = []
            for i, text in zip(b["doc_id"], b["text"], strict=True):
                lines = [x for x in text.split("\n") if x and not x.isspace()]
                found = notices(m, lines)
                best = max(found, default=(0.0, UNKNOWN))
                out.append((i, best[1], best[0], len(lines), len(found), sorted({f for _, f in found})))
            yield pd.DataFrame(out, columns=["doc_id", "family", "score", "n_paragraphs", "n_licences", "families"])

    return mapped(rows, run, "family string, score double, n_paragraphs long, n_licences long, families array<string>")
