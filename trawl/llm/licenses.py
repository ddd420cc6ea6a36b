"""Licence scans by a trained paragraph classifier.

A multinomial logistic regression over the word uni- and bigrams of a sentence
names a licence family or none. It is trained here from template sentences,
cut and varied by a seeded generator, and from a bounded sample of the corpus'
own sentences. Scores are calibrated by a temperature fitted on held-out
variants; a sentence that is probably a licence, but of no family probable
enough, is unknown. Every named sentence is then compared with the family's
templates: it is confirmed when it holds some of a template's word pairs, or
they of its own, fewer than would tell families apart or a licence from prose
without the classifier. Neighbouring sentences of one family are one span.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.common import in_batches

# Usual wordings of licence grants and notices, by family.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution license.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright (c) 2020 Example Corporation. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is confidential and proprietary; unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}
# What names a family in its templates, names of other licences, and usual wordings of other licences.
NAMES = (
    "GNU Lesser General Public", "GNU General Public", "GPL-3.0-or-later", "LGPL-2.1-only", "Mozilla Public", "MPL-2.0", "MPL", "Apache-2.0", "Apache", "BSD 3-Clause",
    "BSD-3-Clause", "BSD-style", "MIT", "Creative Commons Attribution-ShareAlike 4.0 International", "Creative Commons Attribution-NonCommercial 4.0 International",
    "Creative Commons Attribution 4.0 International", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution", "CC BY-SA 4.0", "CC BY-NC 4.0", "CC BY 4.0",
    "CC0 1.0 Universal",
)
OTHER_NAMES = (
    "Academic Free", "Artistic", "Boost Software", "Common Development and Distribution", "Eclipse Public", "Microsoft Public", "Open Software", "PostgreSQL", "Python Software Foundation",
    "Q Public", "Ruby", "SIL Open Font", "Sleepycat", "University of Illinois", "W3C Software Notice", "Zope Public",
)
OTHERS = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "This is free and unencumbered software released into the public domain.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.",
    "This package is distributed under the same terms as the language itself.",
    "Licensed under the Open Software License version 3.0.",
    "The fonts and derivatives, however, cannot be released under any other type of license.",
)
#: Sentences about rights, copies and conditions that are no licences.
PROSE = (
    "He was free to use the library and to copy any page without charge.", "The conditions of the sale were subject to the law of the land.",
    "You should have received the letter along with the parcel last week.", "The author has agreed to read from this work in public.",
    "All rights of way across the farm were closed.", "No part of the journey may be repeated this year.",
    "The software is used by a person in every office of the company.", "Any person may obtain a copy of the report from the county.",
    "The public licence of the inn was lost under its first owner.", "She had a license to drive and permission to use the car.",
    "The terms of the treaty are provided in the second part of this book.", "The distribution of wealth and the use of land were debated in any form.",
    "Copyright was the subject of the talk, with or without the author.", "The following conditions are met by a good teacher.",
    "The warranty of the machine is limited to one year.", "The company may modify its plans at any later time.",
    "This work is hard and this file is long.", "The foundation published a free version of its general report.",
)
NONE, UNKNOWN = "none", "unknown"
BLANK = "____"
#: Sentences of the corpus that teach what is no licence, at most, and characters of each; variants of each template.
NEGATIVES, NEGATIVE_CHARS, VARIANTS = 2000, 2000, 16
#: Least calibrated probability of a family, and least share of word pairs in common with one of its templates.
LEAST_P, LEAST_SHARED = 0.6, 0.2
#: Share of word pairs in common with a template that a sentence of the corpus must not have to teach what is no licence.
TOO_MUCH_SHARED = 0.5
SENTENCE = re.compile(r"\S.*?(?:[.!?]+(?=\s)|\Z)")
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")

FOUND = T.StructType().add("n_paragraphs", "long").add("licenses", "string").add("n_licenses", "long").add("n_unknown", "long").add("license_spans", "string")


def features(text: str) -> list[str]:
    """Lower-cased words and adjacent pairs of them."""
    found = WORD.findall(text.lower())
    return found + [f"{a} {b}" for a, b in zip(found, found[1:], strict=False)]


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences of each line, without white space around them."""
    at = 0
    for line in text.split("\n"):
        for m in SENTENCE.finditer(line):
            yield at + m.start(), at + m.start() + len(m.group().rstrip())
        at += len(line) + 1


def pairs(text: str) -> set[str]:
    """The word pairs of a text."""
    return {f for f in features(text) if " " in f}


def unnamed(text: str) -> str | None:
    """A template with the name of its family left open, or None where none is named."""
    for name in NAMES:
        if name in text:
            return text.replace(name, BLANK)
    return None


def overlap(mine: set[str], template: set[str]) -> float:
    """Pairs in common over the template's, or over the paragraph's own when there are at least three."""
    n = len(mine & template)
    return max(n / max(1, len(template)), n / len(mine) if n >= 3 else 0.0)


class Model:
    """Weights by feature, one column a class; ``classes[0]`` is none."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, bias: np.ndarray, classes: list[str], temperature: float):
        self.vocabulary, self.weights, self.bias, self.classes, self.temperature = vocabulary, weights, bias, classes, temperature
        self.pairs = {c: [pairs(t) for t in TEMPLATES[c]] for c in classes if c in TEMPLATES}
        self.telling = {p for ts in TEMPLATES.values() for t in ts for p in pairs(t)}

    def probabilities(self, found: list[str]) -> np.ndarray:
        z = (self.logits(found)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def logits(self, found: list[str]) -> np.ndarray:
        known = [i for i in map(self.vocabulary.get, found) if i is not None]
        return self.bias + self.weights[known].sum(0) / math.sqrt(max(1, len(found)))

    def shared(self, found: list[str], family: str) -> float:
        """Share of word pairs in common with a template: of the template's, or of the paragraph's when three are."""
        mine = {p for p in found if " " in p}
        return max((overlap(mine, t) for t in self.pairs[family]), default=0.0)

    def classify(self, text: str) -> str | None:
        """A confirmed family, ``unknown`` for what reads like a licence but is not confirmed, or None."""
        found = features(text)
        # Without a word pair of any template nothing could be confirmed.
        if self.telling.isdisjoint(found):
            return None
        p = self.probabilities(found)
        best = int(p.argmax())
        if best == 0:
            return None
        family = self.classes[best]
        if family != UNKNOWN and p[best] >= LEAST_P and self.shared(found, family) >= LEAST_SHARED:
            return family
        # Two word pairs of licences at least, so that no single turn of phrase makes prose a licence.
        return UNKNOWN if p[0] < 1 - LEAST_P and len(self.telling.intersection(found)) > 1 else None


def train(negatives: list[str], seed: int = 42, rounds: int = 200) -> Model:
    """Fit by gradient descent with L2 on varied templates and the corpus' sentences; every fourth variant calibrates.

    The unknown class learns from wordings of other licences and from the
    templates under other names.
    """
    rng = np.random.default_rng(seed)
    classes = [NONE, *sorted(TEMPLATES), UNKNOWN]
    every = [pairs(t) for ts in TEMPLATES.values() for t in ts]
    rows: list[tuple[list[str], int]] = []
    for text in negatives:
        # The corpus may hold licences itself.
        if (mine := pairs(text)) and max(overlap(mine, t) for t in every) < TOO_MUCH_SHARED:
            rows.append((features(text), 0))
    plain = [w for f, _ in rows for w in f if " " not in w] or ["text"]
    opened = [t for t in (unnamed(t) for ts in TEMPLATES.values() for t in ts) if t]
    taught = [(text, classes.index(family)) for family in sorted(TEMPLATES) for text in TEMPLATES[family]]
    taught += [(text, 0) for text in PROSE]
    taught += [(text, len(classes) - 1) for text in (*OTHERS, *(t.replace(BLANK, OTHER_NAMES[(3 * i + j) % len(OTHER_NAMES)]) for i, t in enumerate(opened) for j in range(2)))]
    for text, kind in taught:
        source = text.split()
        for k in range(VARIANTS):
            lost = (0, 0.08, 0.2, 0.35)[k % 4]
            words = [w for w in source if rng.random() >= lost] or source
            if k > 7:
                cut = sorted(rng.integers(0, len(words) + 1, 2))
                words = words[cut[0] : cut[1]] if cut[1] - cut[0] >= min(6, len(words)) else words
                words = words + [plain[i] for i in rng.integers(0, len(plain), rng.integers(0, 6))]
            rows.append((features(" ".join(words)), kind))
    vocabulary = {f: i for i, f in enumerate(sorted({f for text, _ in taught for f in features(text)}))}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    y = np.array([c for _, c in rows])
    for i, (found, _) in enumerate(rows):
        for f in found:
            if f in vocabulary:
                x[i, vocabulary[f]] += 1 / math.sqrt(len(found))
    held = np.arange(len(rows)) % 4 == 3
    weights, bias = np.zeros((len(vocabulary), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    xt, target = x[~held], np.eye(len(classes), dtype=np.float32)[y[~held]]
    balance = (1 / np.bincount(y[~held], minlength=len(classes)).clip(1))[y[~held]][:, None]
    balance = (balance / balance.mean()).astype(np.float32)
    for _ in range(rounds):
        z = xt @ weights + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - target) * balance / len(xt)
        weights -= 20 * (xt.T @ error + 1e-5 * weights)
        bias -= 5 * error.sum(0)
    z = x[held] @ weights + bias

    def loss(t: float) -> float:
        q = z / t - (z / t).max(1, keepdims=True)
        return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(q)), y[held]]).mean())

    temperature = min((0.25 * 1.25**i for i in range(16)), key=loss)
    return Model(vocabulary, weights, bias, classes, temperature)


def negatives(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 42) -> list[str]:
    """At most ``NEGATIVES`` sentences, one of each of the first documents in a seeded hash order.

    A bound on the hash leaves about four times as many documents before any
    text is read; each gives one sentence of its whole text where it lies, and
    of these the first go to the driver, cut to ``NEGATIVE_CHARS`` characters.
    """
    share = min(1.0, 4 * NEGATIVES / max(1, df.count()))
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    few = df.where(F.length(text_col) > 0).select(F.col(text_col).alias("t"), order.alias("h"))
    few = few.where(F.pmod("h", F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, h in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = t.as_py()
                if spans := list(paragraphs(text)):
                    a, b = spans[(h >> 30) % len(spans)]
                    out.append((h, text[a : min(b, a + NEGATIVE_CHARS)]))
            h, t = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(t, pa.string())], ["h", "t"])

    rows = in_batches(few, run, "h bigint, t string").orderBy("h", "t").limit(NEGATIVES).collect()
    return [r.t for r in rows]


def scan(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` without its text and with the licences of each whole text.

    ``licenses``: the confirmed families, sorted, comma-joined; ``license_spans``:
    family:start:end in order, ends exclusive, code points, unknown ones
    included; sentences of one family with nothing but white space between them
    are one. ``n_paragraphs`` counts sentences. Null texts count as empty, very
    long ones are whole. Repeated rows each get a row, and the family of equal
    probabilities that comes first by name wins; columns named like the new ones
    are replaced. An empty table gives no rows.
    """
    taken = {f.name for f in FOUND.fields}
    others = [c for c in df.columns if c != text_col and c.lower() not in taken]
    schema = T.StructType([*df.select(*others).schema.fields, *FOUND.fields])

    def one(text: str) -> tuple:
        n, spans = 0, []  # (family, start, end)
        for a, b in paragraphs(text):
            n += 1
            if family := model.classify(text[a:b]):
                if spans and spans[-1][0] == family and not text[spans[-1][2] : a].strip():
                    spans[-1] = (family, spans[-1][1], b)
                else:
                    spans.append((family, a, b))
        named = [f for f, _, _ in spans if f != UNKNOWN]
        return n, ",".join(sorted(set(named))), len(named), len(spans) - len(named), ",".join(f"{f}:{a}:{b}" for f, a, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t.as_py() or "") for t in batch.column(text_col)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            found = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], schema.fieldNames())

    return in_batches(df.select(*others, text_col), run, schema)
