"""Licence scan: a trained paragraph classifier over sparse word n-grams; scanning uses DataFrame functions only.

A paragraph (a line of text, or lines that follow each other) is reduced to the words of the model's vocabulary, any run of
others being one blank; its n-grams are the features of a multinomial logistic regression over licence families and
``unknown``.  Training rows state licences in many frames, mention them without granting anything, and state licences
that the module doesn't know.  Scores are scaled on held-back rows, and a family counts as unknown below the probability that
hardly any held-back unknown row reaches; among these are licences that no training row names.

Each prediction is then compared with the family's templates: a name of the family in its order, or enough of the ordered
three-word sequences of one of its notices, confirms it, unless another family has more.  A paragraph without any
anchor, a vocabulary word that ordinary text hardly has, is unknown by the model's definition and needs no scoring.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "unknown"
#: Documents whose text serves as ordinary text in training, and windows of words of all of them together: the one bounded sample.
TRAIN_DOCS = 300
TRAIN_WINDOWS = 2400
#: Words of a window of a long paragraph, and between the starts of two.
WINDOW, STRIDE = 80, 40
#: Words of a window of ordinary text.
TRAIN_WORDS = 40
MAX_GRAM = 3
#: Features of a model at most, so that their weights may be broadcast.
MAX_FEATURES = 8192
#: The share of held-back unknown rows that may pass for a family.
FALSE_SHARE = 0.01
#: The share of a notice's word sequences that confirms its family.
CONFIRM = 0.6
BLANK = "*"
_NOT_WORD = "[^a-z0-9.+-]+"
_EDGE = "^[.+-]+|[.+-]+$"

# How each family is called, in words that stand together.
NAMES: dict[str, list[str]] = {
    "agpl-3.0": ["GNU Affero General Public License", "Affero GPL", "AGPL", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 license", "Apache-2.0", "Apache Software License 2.0", "Apache Licence, Version 2.0", "ASL 2.0", "Apache 2 license"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "BSD-style license", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD license", "2-clause BSD license", "New BSD License", "Modified BSD License", "Simplified BSD License", "BSD licence"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "CC-BY 4.0", "CC BY 2.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0", "Creative Commons Attribution License", "Creative Commons Attribution 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC-4.0", "CC-BY-NC 4.0", "CC BY-NC 2.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "CC-BY-SA 4.0", "CC BY-SA 2.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution-ShareAlike License"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL v2", "GPL version 2"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL v3", "GPL version 3"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL", "LGPL", "LGPLv3", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-or-later", "GNU Library General Public License"],
    "mit": ["MIT License", "MIT licence", "MIT-style license", "Expat license", "X11/MIT license", "License: MIT", "SPDX-License-Identifier: MIT", "MIT/X11 license", "licensed MIT", "under MIT"],
    "mpl-2.0": ["Mozilla Public License", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "MPL v2"],
    "proprietary": ["all rights reserved", "proprietary and confidential", "confidential and proprietary", "unauthorized copying", "may not be reproduced", "strictly prohibited"],
    "public-domain": ["CC0 1.0 Universal", "CC0 1.0", "CC0", "CC0-1.0", "Creative Commons Zero", "into the public domain", "dedicated to the public domain", "The Unlicense", "Public Domain Dedication"],
}
# Notices of each family, as their texts word them.
TEMPLATES: dict[str, list[str]] = {
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
    ],
    "gpl-3.0": [
        "You should have received a copy of the GNU General Public License, version 3, along with this program.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or any later version.",
    ],
    "mit": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "proprietary": [
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
}
# Licences that the module doesn't tell from others; those of the second list only ever set the threshold.
OTHERS = ["Eclipse Public License 2.0", "Boost Software License 1.0", "Artistic License 2.0", "Common Development and Distribution License", "European Union Public Licence", "zlib License", "CC BY-ND 4.0", "SIL Open Font License", "Python Software Foundation License", "Creative Commons Attribution-NoDerivatives 4.0 International License", "Open Software License 3.0", "PostgreSQL License"]
UNSEEN = ["ISC License", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Microsoft Public License", "Academic Free License v3.0", "Do What The F Public License", "CeCILL license", "IBM Public License", "Ruby license", "PHP License, version 3.01", "Open Database License"]
NAMES_AND_OTHERS = [n for names in NAMES.values() for n in names] + OTHERS
# Sentences that state a licence, and some that only mention one.
FRAMES = [
    "Licensed under the {}", "Licensed under {}", "Released under the {}", "Released under {}", "This work is licensed under the {}", "This work is licensed under a {}", "Distributed under the terms of the {}", "This software is available under the {}",
    "The code is made available under {}", "You may use this file under the terms of the {}", "This project is licensed under the {}; see the LICENSE file for details", "Published under the {}", "SPDX-License-Identifier: {}", "License: {}", "This file is part of a project that is covered by the {}",
    "{}", "Except where noted, content on this site is licensed under {}", "Use of this source is governed by the {}", "This program is free software under the {}", "Subject to the terms of the {}", "The documentation is provided under {}", "Lizenziert unter {}", "Publié sous licence {}", "Publicado bajo la licencia {}",
    "Veröffentlicht unter der {}", "Distribué sous les termes de la {}", "Distribuido bajo los términos de la {}", "The text and images are shared under the {}",
]
MENTIONS = ["Many projects have chosen the {} in recent years", "A talk about the history of the {}", "The {} was compared with others in a survey", "She wrote an article on the {} and its critics", "Lawyers often discuss the {} at length", "He asked what the {} means for libraries", "Unlike the {} this one is rarely used"]
# Sentences that use the same words but state no licence.
ORDINARY = [
    "The driver must show a valid license at the border.",
    "This version of the work was released in the spring.",
    "The general public was free to use the library.",
    "Permission to enter is granted at the gate.",
    "The software license fee rises every year.",
    "A copy of the file is in the folder.",
    "Copyright law differs between countries.",
    "MIT is a university in Cambridge.",
    "The source of the river is under the hill.",
    "Creative work needs time and attribution of credit.",
    "Her driving licence was issued in 2019.",
    "The terms of the contract were published by the foundation.",
    "All seats in the hall are reserved for guests.",
    "The fishing license costs ten dollars.",
    "He studied at MIT before he moved to Apache County.",
    "Human rights are discussed in all chapters.",
]


def _clean(text: str) -> list[str]:
    """The words of a paragraph; the same rule as `_words` has in Spark."""
    return [w for w in (re.sub(_EDGE, "", w) for w in re.split(_NOT_WORD, text.lower())) if w]


def _words(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(text), _NOT_WORD), lambda w: F.regexp_replace(w, _EDGE, "")), lambda w: w != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _reduced(words: list[str], vocabulary: set[str]) -> list[str]:
    """The words, any run of those outside the vocabulary being one blank."""
    marked = [w if w in vocabulary else BLANK for w in words]
    return [w for i, w in enumerate(marked) if w != BLANK or not i or marked[i - 1] != BLANK]


def _runs(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def _grams(words: list[str]) -> list[str]:
    return [g for n in range(1, MAX_GRAM + 1) for g in _runs(words, n)]


def windows(words: list[str]) -> list[list[str]]:
    """What is judged of a paragraph: all of it, or, where that is long, overlapping windows that cover it."""
    return [words] if len(words) <= WINDOW else [words[i : i + WINDOW] for i in range(0, len(words) - WINDOW + STRIDE, STRIDE)]


@lru_cache(maxsize=1)
def evidence() -> list[tuple[str, list[str]]]:
    """(family, ordered word sequences): a name is one sequence of all its words, a notice its sequences of three."""
    out = [(f, [" ".join(_clean(n))]) for f, names in NAMES.items() for n in names]
    return out + [(f, list(dict.fromkeys(_runs(_clean(t), 3)))) for f, texts in TEMPLATES.items() for t in texts]


_SIZES = sorted({len(g.split(" ")) for _, grams in evidence() for g in grams})


def similarities(words: list[str]) -> dict[str, float]:
    """The largest share of a name or notice of each family that the words have."""
    have = {g for n in _SIZES for g in _runs(words, n)}
    out = dict.fromkeys(TEMPLATES, 0.0)
    for family, grams in evidence():
        out[family] = max(out[family], sum(g in have for g in grams) / len(grams))
    return out


@dataclass(frozen=True)
class Judged:
    family: str
    probability: float
    similarity: float
    confirmed: bool


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last is UNKNOWN
    vocabulary: tuple[str, ...]
    anchors: tuple[str, ...]  # a paragraph with none of these words states no licence
    weights: dict[str, np.ndarray]  # of each n-gram, a number for each family
    bias: np.ndarray
    scale: float
    least: float

    def _probabilities(self, words: list[str]) -> np.ndarray:
        grams = set(_grams(_reduced(words, set(self.vocabulary))))
        z = self.scale * (self.bias + sum((self.weights[g] for g in sorted(grams) if g in self.weights), np.zeros(len(self.families))))
        p = np.exp(z - z.max())
        return p / p.sum()

    def judge(self, words: list[str]) -> Judged | None:
        """The best window's family: a confirmed one first, then the likelier, then the first; None if all are unknown."""
        best = None
        for own in windows(words):
            if not set(self.anchors) & set(own):
                continue
            p = self._probabilities(own)
            k = int(np.argmax(p[:-1]))
            if p[k] < self.least:
                continue
            family, near = self.families[k], similarities(own)
            sure = near[family] >= CONFIRM and near[family] >= max(near.values())
            found = Judged(family, float(p[k]), near[family], sure)
            if best is None or (found.confirmed, found.probability) > (best.confirmed, best.probability):
                best = found
        return best

    def predict(self, text: str) -> tuple[str, float]:
        found = self.judge(_clean(text))
        return (found.family, found.probability) if found else (UNKNOWN, 1.0)


def labelled(ordinary: list[str], seed: int = 5, copies: int = 24) -> list[tuple[str, str]]:
    """Training rows: names in frames and notices with words lost, both among ordinary words; mentions, other licences, ordinary text."""
    rng = np.random.default_rng(seed)
    filler = np.array([w for t in ordinary for w in t.split()] or ["text"], object)

    def among(text: str) -> str:
        before, after = (filler[rng.integers(0, len(filler), rng.integers(0, 7))].tolist() for _ in range(2))
        return " ".join([*before, text, *after])

    rows = []
    for family, names in NAMES.items():
        for name in names:
            rows += [(among(frame.format(name)), family) for frame in FRAMES]
            if family != "proprietary":  # to say that rights are reserved reserves them
                rows += [(among(frame.format(name)), UNKNOWN) for frame in MENTIONS]
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = text.split()
            for k in range(copies):
                lost = [w for w in words if rng.random() > 0.08] or words
                at = int(rng.integers(0, max(1, len(words) // 2)))
                part = words if k % 3 == 0 else lost if k % 3 == 1 else words[at : at + max(10, len(words) // 2)]
                rows.append((among(" ".join(part)), family))
    rows += [(among(frame.format(name)), UNKNOWN) for name in OTHERS for frame in (*FRAMES, *MENTIONS)]
    rows += [(among(t), UNKNOWN) for t in ORDINARY for _ in range(copies // 4)] + [(t, UNKNOWN) for t in ordinary]
    return [rows[k] for k in rng.permutation(len(rows))]


def fit(rows: list[tuple[str, str]], rounds: int = 300) -> Model:
    """Logistic regression by gradient descent; every fourth row is held back for scaling and, with the unseen licences, for the threshold."""
    unseen = [(frame.format(name), UNKNOWN) for name in UNSEEN for frame in (*FRAMES, *MENTIONS)]
    back = np.concatenate([np.arange(len(rows)) % 4 == 3, np.ones(len(unseen), bool)])
    rows = rows + unseen
    families = (*sorted({f for _, f in rows} - {UNKNOWN}), UNKNOWN)
    words = [_clean(t) for t, _ in rows]
    sizes, seen, plain = dict.fromkeys(families, 0), {}, []
    made = [*ORDINARY, *NAMES_AND_OTHERS]
    for w, (text, family), out in zip(words, rows, back, strict=True):
        if not out:
            sizes[family] += 1
            if family != UNKNOWN:
                for x in set(w):
                    seen[family, x] = seen.get((family, x), 0) + 1
            elif not any(t in text for t in made):
                plain.append(set(w))
    vocabulary = {w for (family, w), n in seen.items() if n >= 0.02 * sizes[family]}
    told = {w for _, grams in evidence() for g in grams for w in g.split(" ")}
    # how usual a word is in ordinary text, not in rows that are made to name a licence or to use its words
    usual: dict[str, int] = {}
    for x in plain:
        for w in x & vocabulary:
            usual[w] = usual.get(w, 0) + 1
    anchors = {w for w in vocabulary & told if usual.get(w, 0) <= 0.01 * len(plain)}
    features = [set(_grams(_reduced(w, vocabulary))) for w in words]
    often: dict[str, int] = {}
    for f, out in zip(features, back, strict=True):
        if not out:
            for g in f:
                often[g] = often.get(g, 0) + 1
    grams = sorted(sorted((g for g in often if often[g] >= 6 and g != BLANK), key=lambda g: (-often[g], g))[:MAX_FEATURES])
    slot = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(rows), len(grams)), np.float32)
    for k, f in enumerate(features):
        x[k, [slot[g] for g in f if g in slot]] = 1
    y = np.array([families.index(f) for _, f in rows])
    goal = np.eye(len(families), dtype=np.float32)[y]
    share = np.bincount(y[~back], minlength=len(families)) / (~back).sum()
    pull_of = (1 / (len(families) * np.maximum(share, 1e-9)))[y[~back], None].astype(np.float32) ** 0.5
    w, b = np.zeros((len(grams), len(families)), np.float32), np.zeros(len(families), np.float32)
    xt, gt = x[~back], goal[~back]
    speed, drift = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        z = xt @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        pull = (p / p.sum(axis=1, keepdims=True) - gt) * pull_of / len(xt)
        speed = 0.9 * speed - 0.5 * (xt.T @ pull + 1e-5 * w)
        drift = 0.9 * drift - 0.5 * pull.sum(axis=0)
        w, b = w + speed, b + drift
    z, truth = x[back] @ w + b, y[back]

    def probabilities(scale: float) -> np.ndarray:
        p = np.exp(scale * (z - z.max(axis=1, keepdims=True)))
        return p / p.sum(axis=1, keepdims=True)

    scale = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda s: float(-np.log(probabilities(s)[np.arange(len(truth)), truth] + 1e-12).mean()))
    others = np.sort(probabilities(scale)[truth == len(families) - 1, :-1].max(axis=1))
    passing = others[min(len(others) - 1, int((1 - FALSE_SHARE) * len(others)))]
    least = min(0.95, max(0.5, float(passing) + 1e-6))
    return Model(families, tuple(sorted(vocabulary)), tuple(sorted(anchors)), {g: w[i].astype(float) for g, i in slot.items()}, b.astype(float), scale, least)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = TRAIN_DOCS, sample_windows: int = TRAIN_WINDOWS) -> Model:
    """A model whose ordinary text is ``sample_windows`` windows of TRAIN_WORDS words at most, from about ``sample_docs`` documents.

    The documents with the smallest id hashes are taken whole and cut into windows, of which those with the smallest hashes serve.
    """
    usable = docs.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    # by bounds on hashes, not by sorting, for which every task would send its own smallest to the driver
    part = lambda c: F.pmod(c, F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = usable.filter(part(F.col("h")) < sample_docs / max(1, usable.count())).select("h", F.split("text", "\\s+").alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 1), F.lit(TRAIN_WORDS))
    cut = near.select("h", "w", F.explode(starts).alias("at")).select("h", "at", F.array_join(F.transform(F.slice("w", F.col("at") + 1, TRAIN_WORDS), lambda w: F.substring(w, 1, 64)), " ").alias("t"))
    share = sample_windows / max(1, cut.count())
    rows = cut.select(F.xxhash64("h", "at").alias("k"), "t").filter(part(F.col("k")) < share).limit(2 * sample_windows).collect()
    texts = [r.t for r in sorted(rows, key=lambda r: (r.k, r.t))[:sample_windows]]
    # windows that name a licence are left out, as they may state it
    return fit(labelled([t for t in texts if max(similarities(_clean(t)).values()) < CONFIRM]))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed of every paragraph found to state a licence.

    Paragraphs are the lines of the text, numbered from 0; then each run of two or more lines that have words and
    aren't confirmed alone is judged whole, and where that is confirmed, it has the number of its first line and takes the
    place of its lines.  Very long paragraphs are judged by overlapping windows that cover them, and have the best one's family.
    Null and empty texts have none; null and repeated ids keep their rows, and equal rows give equal results.  Extra
    columns are ignored; an empty table gives no rows.
    """
    vocabulary, k = list(model.vocabulary), len(model.families)
    anchors = F.array(*map(F.lit, model.anchors)).cast("array<string>")
    none = F.array().cast("array<string>")
    # n-grams are looked up in place, in a constant of at most MAX_FEATURES entries; nothing is grouped
    table = json.dumps({g: [float(v) for v in w] for g, w in model.weights.items()})
    weights = F.from_json(F.lit(table), "map<string,array<double>>")
    start = F.array(*[F.lit(float(v)) for v in model.bias])
    zero = F.array(*[F.lit(0.0)] * k)
    proof = F.from_json(F.lit(json.dumps([{"family": f, "grams": g} for f, g in evidence()])), "array<struct<family:string,grams:array<string>>>")
    result = T.StructType([T.StructField("confirmed", T.BooleanType()), T.StructField("probability", T.DoubleType()), T.StructField("order", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("similarity", T.DoubleType())])
    nothing = F.lit(None).cast(result)

    def runs_of(own: Column, n: int) -> Column:
        last = F.size(own) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(own, i, n), " "))).otherwise(none)

    def softmax(z: Column) -> Column:
        powers = _let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(F.lit(model.scale) * (v - top))))
        return _let(powers, lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda v: v / total)))

    def best(p: Column) -> Column:
        return F.greatest(*[F.struct(p[i].alias("probability"), F.lit(-i).alias("i"), F.lit(f).alias("family")) for i, f in enumerate(model.families[:-1])])

    def judged_window(words: Column, order: Column) -> Column:
        """What a window states, or null."""

        def near(have: Column) -> Column:
            return F.transform(proof, lambda e: F.struct(e["family"].alias("family"), (F.size(F.array_intersect(e["grams"], have)) / F.size(e["grams"])).alias("share")))

        def compared(top: Column, shares: Column) -> Column:
            own = F.array_max(F.transform(F.filter(shares, lambda e: e["family"] == top["family"]), lambda e: e["share"]))
            most = F.array_max(F.transform(shares, lambda e: e["share"]))
            return _let(own, lambda s: F.struct(((s >= CONFIRM) & (s >= most)).alias("confirmed"), top["probability"].alias("probability"), order.alias("order"), top["family"].alias("family"), s.alias("similarity")).cast(result))

        def told(top: Column) -> Column:
            have = F.concat(*[runs_of(words, n) for n in _SIZES])
            return F.when(top["probability"] >= model.least, _let(have, lambda h: _let(near(h), lambda shares: compared(top, shares))))

        marked = F.transform(words, lambda w: F.when(w.isin(vocabulary) if vocabulary else F.lit(False), w).otherwise(BLANK))
        reduced = lambda m: F.filter(m, lambda w, i: (w != BLANK) | (i == 0) | (F.get(m, i - 1) != BLANK))
        grams = lambda own: F.array_distinct(F.concat(*[runs_of(own, n) for n in range(1, MAX_GRAM + 1)]))
        z = lambda g: F.aggregate(g, start, lambda z, g: F.zip_with(z, F.coalesce(F.try_element_at(weights, g), zero), lambda a, b: a + b))
        found = _let(marked, lambda m: _let(reduced(m), lambda own: _let(grams(own), lambda g: _let(z(g), lambda v: _let(softmax(v), lambda p: _let(best(p), told))))))
        return F.when(F.arrays_overlap(words, anchors), found).otherwise(nothing)

    def judged(words: Column) -> Column:
        """What a paragraph of these words states: its best window, or null."""
        starts = F.when(F.size(words) <= WINDOW, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(words) - WINDOW + STRIDE - 1, F.lit(STRIDE)))
        each = F.transform(starts, lambda i: _let(F.slice(words, i + 1, WINDOW), lambda own: judged_window(own, -i)))
        return F.array_max(F.filter(each, lambda v: v.isNotNull()))

    def row(at: Column, size: Column, v: Column) -> Column:
        return F.struct(at.alias("at"), size.alias("size"), v.alias("v"))

    def once(df: DataFrame, value: Column, name: str) -> DataFrame:
        # exploding keeps the optimizer from computing it twice
        return df.select("*", F.explode(F.array(value)).alias(name))

    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.split(F.col(text_col).cast("string"), "\n").alias("lines"))
    words = once(lines, F.transform("lines", _words), "words").drop("lines")
    words = words.filter(F.exists("words", lambda w: F.arrays_overlap(w, anchors)))
    each = once(words, F.transform("words", lambda w: F.when(F.arrays_overlap(w, anchors), judged(w)).otherwise(nothing)), "judged")
    sure = lambda v: F.coalesce(v["confirmed"], F.lit(False))
    ends = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (F.size(F.get("words", i)) == 0) | sure(F.get("judged", i)))
    each = once(each, F.concat(F.array(F.lit(-1)), ends, F.array(F.size("words"))), "ends")
    runs = F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda j: F.struct((F.get("ends", j - 1) + 1).alias("at"), (F.get("ends", j) - F.get("ends", j - 1) - 1).alias("size")))
    whole = F.transform(F.filter(runs, lambda r: r["size"] > 1), lambda r: row(r["at"], r["size"], _let(F.flatten(F.slice("words", r["at"] + 1, r["size"])), judged)))
    each = once(each, F.filter(whole, lambda r: sure(r["v"])), "runs")
    alone = F.filter(F.transform("judged", lambda v, i: row(i, F.lit(1), v)), lambda r: r["v"].isNotNull() & ~F.exists("runs", lambda x: (x["at"] <= r["at"]) & (r["at"] < x["at"] + x["size"])))
    found = each.select("doc_id", F.explode(F.concat(alone, "runs")).alias("r"))
    return found.select("doc_id", F.col("r.at").alias("paragraph"), "r.v.family", "r.v.probability", "r.v.similarity", "r.v.confirmed")
