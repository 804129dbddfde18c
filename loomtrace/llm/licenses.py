"""License scans: a trained paragraph classifier, confirmed by templates.

A text is scanned by paragraph: a line, or pieces of ``PIECE`` words (each half
covered by the next) of a longer line. A softmax regression over sparse word
n-grams (one to three words) names a licence family or ``unknown``. It is
learned here from the templates below, cropped, worn and set among other words,
against paragraphs of the corpus itself and sentences that only sound alike;
both sides weigh the same. A temperature fitted on examples held out calibrates
its probabilities. A family named with at least ``bar`` probability is confirmed
if the paragraph shares enough telling word pairs with one of the family's
templates (a pair is telling unless both its words are among the commonest);
a family without is reported as not confirmed. The words that confirm a family
are then taken out and the rest of the paragraph is judged again, so a paragraph
may name several.

Every paragraph is judged by the classifier. It has weights for n-grams of
templates only, so a bound on what a paragraph can reach for any family (the sum
of the largest gains of the n-grams it shares with them) settles most of them
without the full score; that loses nothing. The scan is one pass without a
shuffle, and the model that tasks receive has a bounded size. What training sees of the
corpus is bounded: ``lines`` lines, of at most ``LINE_BYTES`` bytes each, of
``background`` documents, those of the smallest hashes.

Defined results: null or empty texts have no paragraphs and no licence; a line
reports each family once, at its best, and a family that is not confirmed only
if no other is; very long texts and lines are scanned whole, in pieces; repeated
rows scan alike; extra columns are ignored; an empty corpus trains on templates
alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mapped
from .toxicity import PLAIN

PIECE = 64
BACKGROUND = 500
LINES = 10_000
LINE_BYTES = 2048
UNKNOWN = "unknown"
#: Stands where a word was taken out.
GAP = b""
SCHEMA = "doc_id bigint, n_paragraphs int, hits array<struct<line:int,family:string,probability:double,similarity:double,confirmed:boolean>>"

#: Notices of public licences by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is distributed under the terms of the Apache 2.0 license.",
    ),
    "MIT": (
        "The MIT License (MIT)",
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Licensed under the MIT license. See the LICENSE file in the project root for details.",
        "SPDX-License-Identifier: MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "BSD": (
        "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL": (
        "GNU General Public License v3.0",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GNU GPL version 2 or later.",
    ),
    "LGPL": (
        "GNU Lesser General Public License v2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Released under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL": (
        "GNU Affero General Public License v3.0",
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "MPL-2.0": (
        "Mozilla Public License 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0 Universal.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright (c) by the author. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced or transmitted in any form without prior written permission.",
        "This file is proprietary and confidential. Unauthorized copying is strictly prohibited.",
    ),
}
#: Sentences that use the same words and name no licence.
LOOKALIKES = (
    "The driver was asked to show a license at the border.",
    "The general public was free to see the work in the hall.",
    "Version 2.0 of the report was released under a new title.",
    "The terms of the contract are subject to change without notice.",
    "She holds a license to fish in the river and the lake.",
    "The library is open to the public from nine to five.",
    "Use of the software is described in the following list.",
    "A copy of the letter was obtained from the national archive.",
    "All seats were reserved and the rights to the film were sold.",
    "The university offers a general course on public domain law.",
)
#: Words too common to tell anything.
COMMON = frozenset(b"a an and are as at be by can for from has have in is it its may no not of on one or that the their there these this to was were which with you your".split())


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def telling(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return {(a, b) for a, b in zip(words, words[1:]) if a not in COMMON or b not in COMMON}


def grams(words: list[bytes]) -> Iterator[tuple[bytes, ...]]:
    """Runs of one, two and three words."""
    return chain(zip(words), zip(words, words[1:]), zip(words, words[1:], words[2:]))


def shares(own: set, template: set) -> float:
    """How much of the lesser set is in both; 0 if that is fewer than three pairs, or not all of a template of two."""
    both = len(own & template)
    return both / min(len(own), len(template)) if both >= min(3, len(template)) else 0.0


@dataclass
class Scanner:
    families: list[str]
    rows: dict[tuple[bytes, ...], int]  # of the n-grams that templates have
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bar: float
    near: float

    def __post_init__(self) -> None:
        self.pairs = {f: [telling(words_of(t.encode())) for t in TEMPLATES[f]] for f in self.families[1:]}
        # What an n-gram can add to a family's lead over unknown at most, by first word; and the lead that ``bar`` asks for.
        gain = np.maximum((self.weights[:, 1:] - self.weights[:, :1]).max(axis=1), 0).astype(np.float64)
        self.begins: dict[bytes, dict[tuple[bytes, ...], float]] = {}
        for g, row in self.rows.items():
            self.begins.setdefault(g[0], {})[g[1:]] = float(gain[row])
        self.asked = self.temperature * np.log(self.bar / (1 - self.bar)) - float((self.bias[1:] - self.bias[0]).max())

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        at = list({self.rows[g] for g in grams(words) if g in self.rows})
        z = (self.bias + self.weights[at].sum(axis=0)) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def hopeful(self, words: list[bytes]) -> bool:
        """Whether the words could reach ``bar``: what their n-grams can add at most is enough."""
        reach = 0.0
        for i in [i for i, w in enumerate(words) if w in self.begins]:
            add = self.begins[words[i]]
            reach += add.get((), 0.0) + add.get((*words[i + 1 : i + 2],), 0.0) * (i + 1 < len(words)) + add.get((*words[i + 1 : i + 3],), 0.0) * (i + 2 < len(words))
        return reach >= self.asked - 1e-6

    def judge(self, words: list[bytes]) -> list[tuple[str, float, float, bool]]:
        """(family, probability, similarity, confirmed) for the families that a piece names, one after another."""
        out, words = [], list(words)
        while len(out) < len(self.families):
            p = self.probabilities(words)
            k = int(np.argmax(p[1:])) + 1
            if p[k] < self.bar:
                break
            family, own = self.families[k], telling(words)
            like = [shares(own, t) for t in self.pairs[family]]
            out.append((family, float(p[k]), max(like), max(like) >= self.near))
            used = set().union(*(t for t, x in zip(self.pairs[family], like, strict=True) if x >= self.near))
            hit = [pair in used for pair in zip(words, words[1:])]
            goes = {i + d for i, pair in enumerate(zip(hit, hit[1:])) if all(pair) for d in (0, 1, 2)}
            if not goes:
                break
            for i in goes:
                words[i] = GAP
        return out

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str, float, float, bool]]]:
        """The number of paragraphs, and (line, family, probability, similarity, confirmed) for those named."""
        n, best = 0, {}
        for line, raw in enumerate(text.split(b"\n")):
            words = words_of(raw)
            if not words:
                continue
            starts = range(0, max(1, len(words) - PIECE // 2), PIECE // 2)
            n += len(starts)
            if not self.hopeful(words):  # then none of its pieces is
                continue
            for s in starts:
                piece = words[s : s + PIECE]
                for named in self.judge(piece) if len(starts) == 1 or self.hopeful(piece) else ():
                    got, key = (line, *named), (line, named[0])
                    best[key] = max(best.get(key, got), got, key=lambda x: (x[4], x[2]))
        sure = {line for line, _, _, _, confirmed in best.values() if confirmed}
        return n, sorted(x for x in best.values() if x[4] or x[0] not in sure)


def examples(background: list[bytes], seed: int = 0) -> list[tuple[list[bytes], int]]:
    """(words, class): class 0 is unknown, the others are the families in order."""
    r = Random(seed)
    plain = [w for t in background if (w := words_of(t))]
    known = [telling(words_of(t.encode())) for ts in TEMPLATES.values() for t in ts]
    plain = [w for w in plain if not any(shares(telling(w), t) >= 0.5 for t in known)]
    loose = [w for p in plain for w in p] or [b"lorem", b"ipsum"]
    out = [(w, 0) for w in plain]
    for text in LOOKALIKES:
        w = words_of(text.encode())
        out += [(w, 0)] * 10
    for c, ts in enumerate(TEMPLATES.values(), 1):
        for text in ts:
            whole = words_of(text.encode())
            out += [(whole, c)] * 4
            for _ in range(30):
                keep = max(min(4, len(whole)), int(len(whole) * r.uniform(0.6, 1.0)))
                s = r.randrange(len(whole) - keep + 1)
                w = [x for x in whole[s : s + keep] if r.random() > 0.05]
                around = r.randrange(12)
                out.append(([*r.choices(loose, k=around), *w, *r.choices(loose, k=r.randrange(12) if around else 0)], c))
    r.shuffle(out)
    return out


def learn(background: list[bytes], bar: float = 0.5, near: float = 0.5, epochs: int = 8, rate: float = 0.5, decay: float = 1e-5) -> Scanner:
    """Softmax regression with a step size per weight, then a temperature on every fifth example."""
    families = [UNKNOWN, *TEMPLATES]
    made = examples(background)
    known = {g: row for row, g in enumerate(sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(words_of(t.encode()))}))}
    rows = [(np.array(sorted({known[g] for g in grams(w) if g in known}), np.int64), c) for w, c in made]
    share = [sum(c > 0 for _, c in rows) / max(1, sum(c == 0 for _, c in rows)), 1.0]
    held, kept = rows[::5], [x for i, x in enumerate(rows) if i % 5]
    w, b = np.zeros((len(known), len(families))), np.zeros(len(families))
    gw, gb = np.full_like(w, 1e-2), np.full_like(b, 1e-2)
    r = Random(1)
    for _ in range(epochs):
        r.shuffle(kept)
        for at, c in kept:
            z = b + w[at].sum(axis=0)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[c] -= 1.0
            p *= share[c > 0]
            g = p + decay * w[at]
            gw[at] += g * g
            gb += p * p
            w[at] -= rate * g / np.sqrt(gw[at])
            b -= rate * p / np.sqrt(gb)
    z = np.array([b + w[at].sum(axis=0) for at, _ in held])
    y = np.array([c for _, c in held])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return Scanner(families, known, w, b, min(np.geomspace(0.25, 8, 41), key=loss), bar, near)


def train(docs: DataFrame, background: int = BACKGROUND, lines: int = LINES, **settings) -> Scanner:
    """Learn with lines of the corpus as the unknown class: at most ``lines``, of at most ``background`` documents."""
    few = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(background)
    each = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).where(F.octet_length("line") <= LINE_BYTES)
    got = each.join(F.broadcast(few), "doc_id").select("line").distinct().orderBy(F.xxhash64("line"), "line").limit(lines).collect()
    return learn(sorted(r.line.encode() for r in got), **settings)


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """(doc_id, n_paragraphs, hits) for every document; hits: line, family, probability, similarity, confirmed."""
    sent = docs.sparkSession.sparkContext.broadcast(scanner)
    fields = [("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]
    kind = pa.list_(pa.struct(fields))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            got = [sent.value.scan(t) for t in b["text"].to_pylist()]
            hits = [[dict(zip([n for n, _ in fields], h, strict=True)) for h in x] for _, x in got]
            yield {"doc_id": b["doc_id"].cast(pa.int64()), "n_paragraphs": pa.array([n for n, _ in got], pa.int32()), "hits": pa.array(hits, kind)}

    return mapped(docs.select("doc_id", as_bytes()), SCHEMA, run)
