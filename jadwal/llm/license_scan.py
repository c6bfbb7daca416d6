"""License scan: a trained paragraph classifier, applied in DataFrame functions only.

A text is cut into paragraphs: at blank lines, and after lines that end a sentence, so that wrapped notices are joined.
Paragraphs are read in windows of at most ``WINDOW`` words that overlap by half, and a softmax regression over
word n-grams with sparse weights scores every window. Its unknown class is trained on ordinary paragraphs, on
notices of licences outside the families, and on templates whose distinguishing words were replaced; the least
probability for naming a family is set so that held-out ones stay unknown. A named family is confirmed by comparing
the window with the family's templates.

The sum of the weights that a window could hold bounds its probability. ``LicenseModel.needed`` gives words of which every
window that could be reported holds one; the n-grams of the other windows are not looked up, which changes no result.

Training is small and runs on the driver: the notices below, and a bounded sample of windows.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jadwal.llm.common import let, table, written

GRAMS = 3
WINDOW = 300  # words; a notice of half of that lies whole in one window
LONGEST_WORD = 64  # characters; longer words are no features
SAMPLE_WINDOWS = 1500  # the bound on the ordinary windows that training sees
FALSE_ALARMS = 0.005
REPORT = 0.1  # windows with a smaller probability of every family have no row
CONFIRM = 0.6
UNKNOWN = "unknown"

# Customary notices of the licence families.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This software is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Released under the GNU GPL version 2 or later license.",
        "GPLv3 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.",
        "Confidential and proprietary. All rights reserved.",
    ],
}

# Customary notices of other licences, and other sentences with the same words.
OTHERS = [
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "Licensed under the Microsoft Public License.",
    "Licensed under the European Union Public Licence, version 1.2 or later.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
    "license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
    "third-parties to whom the Software is furnished to do so, all subject to the following:",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This is free and unencumbered software released into the public domain.",
    "This software is provided as-is, without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" basis, without warranties or conditions of any kind.",
    "Licensed under the Artistic License 2.0.",
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "Dedicated to the public domain under CC0 1.0 Universal.",
    "Licensed under the Open Software License version 3.0.",
    "Use of this file is governed by the terms of your agreement with the vendor.",
    "A driver must carry a licence and show it on demand.",
    "Apache is the name of a people, of a county and of a web server.",
    "He taught at MIT before the common era of open networks.",
    "The hotel has two reserved seats and the general public may use this entrance.",
    "They have the right to redistribute the seats under these conditions.",
    "Copyright law grants authors rights to their works in all countries.",
    "The version of this program is listed in the file, see above for the conditions.",
]
#: Short notices, as training rows only: every pattern with some names of every family, and with names of other licences for the unknown class.
PATTERNS = [
    "Licensed under {}", "Licensed under the {}.", "Released under {}.", "Released under the terms of the {}.", "Distributed under the {} license.", "Distributed under {}", "License: {}", "Licence: {}",
    "{} License", "{} licence", "Everything in this repository is {} licensed.", "All code here is {}-licensed unless stated otherwise", "Published under a {} license", "Available under the {} license, see the file",
    "You may use this under the {} license", "Made available under the terms of the {}", "Provided under {} terms", "The package is covered by the {}.", "Publié sous licence {}", "Logiciel distribué sous la licence {}",
    "Lizenziert unter der {} Lizenz", "Steht unter der {}-Lizenz", "Veröffentlicht unter {}", "Distribuido bajo la licencia {}", "Con licencia {}", "License ({}) applies", "open source under {}", "dual use allowed by the {}",
]
NAMES = {
    "apache-2.0": ["Apache 2.0", "Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache Licence 2", "Apache Software License 2.0"],
    "mit": ["MIT", "MIT License", "MIT/Expat", "MIT (Expat)", "MIT licence"],
    "gpl": ["GPL", "GPLv2", "GPLv3", "GPL-3.0", "GPL 2.0 or later", "GNU GPL", "GNU GPL v3", "GNU General Public License", "GNU General Public License version 2", "GNU General Public License v3.0 or later"],
    "bsd": ["BSD", "BSD-3-Clause", "BSD 2-Clause", "three-clause BSD", "new BSD", "simplified BSD", "BSD-style", "modified BSD"],
    "cc-by": ["CC BY 4.0", "CC-BY 3.0", "CC BY-SA 4.0", "CC-BY-SA", "Creative Commons Attribution 4.0", "Creative Commons Attribution-ShareAlike 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC", "CC BY-NC-SA 3.0", "CC BY-NC-ND", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons NonCommercial"],
    UNKNOWN: [
        "LGPL", "LGPL-2.1", "LGPLv3", "GNU LGPL", "GNU Lesser General Public License", "GNU Lesser General Public License version 2.1", "GNU Library General Public License", "AGPL", "AGPL-3.0", "AGPLv3",
        "GNU AGPL", "GNU Affero General Public License", "GNU Affero General Public License version 3", "GNU Free Documentation License", "Mozilla Public License 2.0", "MPL 2.0", "zlib", "ISC", "Unlicense",
        "Eclipse Public License", "EPL 2.0", "Boost Software License", "Artistic License", "CC0", "CC BY-ND 4.0", "Creative Commons NoDerivatives", "Microsoft Public License", "European Union Public Licence",
        "PostgreSQL License", "Python Software Foundation License", "SIL Open Font License", "vendor", "standard terms", "usual",
    ],
}
NAMES_A_PATTERN = {UNKNOWN: 14}  # of every family 6
FAMILIES = [*TEMPLATES, UNKNOWN]
SPLIT = r"[^\p{L}\p{N}]+"
#: Blank lines (with comment signs only), or the end of a line that ends a sentence.
BREAK = r"\n(?:[\s*#/;-]*\n|(?<=[.!?:;][\"')\]]{0,2}[ \t\r]{0,4}\n))"


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def _windows(words: list[str], window: int = WINDOW) -> list[list[str]]:
    starts = [0, *range(window // 2, max(len(words) - window // 2, 1), window // 2)]
    return [words[i : i + window] for i in starts]


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}


def _share(words: set[str], template: str) -> float:
    """How much of the template's words are among ``words``."""
    own = set(_words(template))
    return len(own & words) / len(own)


@dataclass
class LicenseModel:
    """Sparse weights by n-gram and class, the least probability for naming a family, and words common in ordinary text."""

    weights: dict[str, list[float]]
    bias: list[float]
    least: float
    common: frozenset[str] = frozenset()

    def probabilities(self, words: list[str]) -> np.ndarray:
        """Of one window."""
        z = np.array(self.bias)
        for g in _grams(words):
            z = z + np.array(self.weights.get(g, np.zeros(len(self.bias))))
        e = np.exp(z - z.max())
        return e / e.sum()

    def needed(self, report: float = REPORT) -> list[str] | None:
        """Words such that a window without any of them has every family's probability below ``report``.

        A family's probability is at most that against the unknown class alone, and that is bounded by the sum of all weights
        in favour of the family. The words are chosen greedily, common ones last, until the n-grams without them cannot reach it. None if a window
        without any n-gram reaches ``report``.
        """
        gain = {g: [max(0.0, v - w[-1]) for v in w[:-1]] for g, w in self.weights.items()}
        gain = {g: np.array(v) for g, v in gain.items() if max(v) > 0}
        room = math.log(report / (1 - report)) - (np.array(self.bias[:-1]) - self.bias[-1]) - 1e-3
        if (room <= 0).any():
            return None
        chosen: set[str] = set()
        while True:
            over = sum(gain.values(), np.zeros(len(room))) - room
            if not gain or (over < 0).all():
                return sorted(chosen)
            by_word: dict[str, float] = {}
            for g, v in gain.items():
                for w in set(g.split(" ")):
                    by_word[w] = by_word.get(w, 0.0) + float(np.minimum(v, 3.0)[over >= 0].sum())
            best = min(by_word, key=lambda w: (w in self.common, -by_word[w], w))
            chosen.add(best)
            gain = {g: v for g, v in gain.items() if best not in g.split(" ")}


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _training_texts(ordinary: list[list[str]], copies: int, rng: np.random.Generator) -> tuple[list[list[str]], list[int]]:
    """Word lists and their classes."""
    around = [w for ws in ordinary for w in ws] or ["text"]

    def placed(ws: list[str], c: int) -> list[str]:
        most = 0 if c < 3 else (6, 40, WINDOW // 2)[c % 3]
        before, after = ([around[i] for i in rng.integers(0, len(around), rng.integers(0, most + 1))] for _ in range(2))
        return [*before, *ws, *after][: 2 * WINDOW]

    texts, labels = [], []
    in_families = {f: {w for t in ts for w in _words(t)} for f, ts in TEMPLATES.items()}
    unknown = len(FAMILIES) - 1
    for k, (family, templates) in enumerate(TEMPLATES.items()):
        own = in_families[family] - set().union(*[ws for f, ws in in_families.items() if f != family])
        for template in templates:
            ws = _words(template)
            for c in range(copies):
                texts.append(placed([w for w in ws if c < 4 or len(ws) < 4 or rng.random() > 0.08], c))
                labels.append(k)
                telling = sorted(own & set(ws))
                if c % 2 and telling:  # the same notice without most of the words that tell the family
                    lost = set(rng.permutation(telling)[: max(len(telling) - len(telling) // 4, 1)].tolist())
                    texts.append(placed([around[rng.integers(0, len(around))] if w in lost else w for w in ws], c))
                    labels.append(unknown)
    for at, pattern in enumerate(PATTERNS):
        for family, names in NAMES.items():
            for c in range(NAMES_A_PATTERN.get(family, 6)):
                texts.append(placed(_words(pattern.format(names[(at * 5 + c) % len(names)])), (c + at) % 3))
                labels.append(FAMILIES.index(family))
    for other in OTHERS:
        texts += [placed([w for w in _words(other) if c < 4 or rng.random() > 0.08], c) for c in range(copies)]
        labels += [unknown] * copies
    return texts + ordinary, labels + [unknown] * len(ordinary)


def fit(ordinary: list[list[str]], copies: int = 16, rounds: int = 250, l1: float = 2e-4, seed: int = 9) -> LicenseModel:
    """Templates with words dropped and ordinary words around them against everything else."""
    rng = np.random.default_rng(seed)
    ordinary = [ws for ws in ordinary if ws and all(_share(set(ws), t) < CONFIRM for ts in TEMPLATES.values() for t in ts)]
    texts, labels = _training_texts(ordinary, copies, rng)
    y = np.array(labels)
    grams = [_grams(ws) for ws in texts]
    short = {f: [_words(p.format(n)) for p in PATTERNS for n in names] for f, names in NAMES.items()}
    known = set().union(*[_grams(_words(t)) for t in [*OTHERS, *sum(TEMPLATES.values(), [])]], *[_grams(ws) for rows in short.values() for ws in rows])
    seen: dict[str, int] = {}
    for gs in grams[len(texts) - len(ordinary) :]:
        for g in gs:
            seen[g] = seen.get(g, 0) + 1
    in_templates = set().union(*[_grams(_words(t)) for ts in TEMPLATES.values() for t in ts], *[_grams(ws) for f, rows in short.items() if f != UNKNOWN for ws in rows])
    common = {g for g, n in seen.items() if n * 100 >= len(ordinary) and g.count(" ") < 2}  # grams of ordinary text
    vocabulary = {g: i for i, g in enumerate(sorted(known | common))}
    silent = np.array([g in common or g not in in_templates for g in vocabulary])  # these speak for no family
    x = np.zeros((len(texts), len(vocabulary)), "f4")
    for i, gs in enumerate(grams):
        x[i, [vocabulary[g] for g in gs if g in vocabulary]] = 1
    held = rng.random(len(texts)) < 0.25
    target = np.eye(len(FAMILIES), dtype="f4")[y]
    w, b = np.zeros((x.shape[1], len(FAMILIES)), "f4"), np.zeros(len(FAMILIES), "f4")
    weight = (len(y) / np.bincount(y, minlength=len(FAMILIES)).clip(1))[y][~held].astype("f4")
    weight *= np.where(y[~held] == len(FAMILIES) - 1, len(FAMILIES) - 1, 1)
    weight /= weight.sum()
    xt, momentum = x[~held], np.zeros_like(w)
    for _ in range(rounds):
        d = (_softmax(xt @ w + b) - target[~held]) * weight[:, None]
        momentum = 0.9 * momentum + xt.T @ d
        w -= 0.3 * momentum
        w = np.sign(w) * np.maximum(np.abs(w) - 0.3 * l1, 0)
        w[silent, :-1], w[silent, -1] = 0, w[silent, -1].clip(0)
        b -= 0.3 * d.sum(0)
        b[-1] = max(b[-1], b[:-1].max() + math.log(2 / REPORT))  # a text without any known n-gram is ordinary
    p = _softmax(x[held] @ w + b)
    alarm = np.sort(p[y[held] == len(FAMILIES) - 1, :-1].max(1)) if (y[held] == len(FAMILIES) - 1).any() else np.zeros(1)
    least = max(0.5, float(alarm[min(len(alarm) - 1, int(np.ceil(len(alarm) * (1 - FALSE_ALARMS))))]) + 1e-6)
    used = np.flatnonzero(np.abs(w).sum(1))
    inverse = list(vocabulary)
    weights = {inverse[i]: [round(float(v), 6) for v in w[i]] for i in used}
    return LicenseModel(weights, [round(float(v), 6) for v in b], round(least, 6), frozenset(g for g in common if " " not in g))


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, paragraph (number from 0), part (window of the paragraph, from 0), w (words) of every text."""
    half = window // 2

    def cut(w: Column) -> Column:
        parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(w) - half - 1) / half).cast("int")))
        return F.when(F.size(w) <= window, F.array(w)).otherwise(F.transform(parts, lambda i: F.slice(w, i * half + 1, window)))

    body = docs.select("doc_id", F.posexplode(F.split("text", BREAK)).alias("paragraph", "body"))
    words = F.array_remove(F.split(F.lower("body"), SPLIT), "")
    return body.select("doc_id", "paragraph", F.posexplode(let(words, cut)).alias("part", "w")).where(F.size("w") > 0)


def train(docs: DataFrame, n: int = SAMPLE_WINDOWS) -> LicenseModel:
    """A model whose unknown class also sees at most ``n`` windows of about 4 * ``n`` different texts, drawn by a hash."""
    texts = docs.where("length(text) > 0")
    share = min(1.0, 4 * n / max(1, texts.count()))
    h = F.xxhash64(F.lit("texts"), "text")
    drawn = texts.where(F.shiftrightunsigned(h, 33) <= int(share * (2**31 - 1))).groupBy(h.alias("doc_id")).agg(F.first("text").alias("text"))
    plain = windows(drawn).select(F.filter("w", lambda x: F.length(x) <= LONGEST_WORD).alias("w")).where(F.size("w") > 0)
    rows = written(plain.select("w", F.xxhash64(F.lit("ordinary"), "w").alias("h")).orderBy("h", "w").limit(n), "ordinary").collect()
    return fit([list(r["w"]) for r in sorted(rows, key=lambda r: (r["h"], r["w"]))])


def _runs(w: Column, n: int) -> Column:
    """All runs of ``n`` words."""
    places = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(w, i, n), " "))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of literals."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def scan(docs: DataFrame, model: LicenseModel, confirm: float = CONFIRM, report: float = REPORT) -> DataFrame:
    """doc_id, paragraph, family, probability, overlap, confirmed: one row per paragraph that could be a notice.

    A paragraph has the result of its window with the greatest probability of a family (the first of equals), and no row
    if that is below ``report``. Of families with equal probability the first in ``TEMPLATES`` counts. ``family`` is
    ``unknown`` below the model's least probability. ``overlap`` is the largest share of a template of the family
    whose words the window holds; ``confirmed`` means at least ``confirm``. Null and empty texts have no
    rows; repeated rows give repeated rows, each with its own result; other columns are ignored. Long lines and
    paragraphs are read in windows, to their end.
    """
    spark = docs.sparkSession
    needed = model.needed(report)
    possible = F.lit(True) if needed is None else F.arrays_overlap("w", F.array(*[F.lit(w) for w in needed]).cast("array<string>"))
    named = docs.select("doc_id", F.col("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    cut = windows(named.select(F.struct("doc_id", "row").alias("doc_id"), "text"))
    found = written(cut.where(possible).select("doc_id.*", "paragraph", "part", "w"), "windows")
    grams = F.flatten(F.array(*[_runs(F.col("w"), n) for n in range(1, GRAMS + 1)]))
    weights = _table(spark, [{"gram": g, "v": v} for g, v in model.weights.items()], "gram string, v array<double>")
    key = ["row", "paragraph", "part"]
    hits = found.select(*key, F.explode(F.array_distinct(grams)).alias("gram")).join(F.broadcast(weights), "gram")
    sums = hits.groupBy(*key).agg(*[F.sum(F.col("v")[k]).alias(f"z{k}") for k in range(len(FAMILIES))])
    z = [F.coalesce(f"z{k}", F.lit(0.0)) + model.bias[k] for k in range(len(FAMILIES))]
    top = F.array_max("z")
    share = F.transform("z", lambda v: F.exp(v - top) / F.aggregate("z", F.lit(0.0), lambda a, q: a + F.exp(q - top)))
    scored = found.join(sums, key, "left").withColumn("z", F.array(*z)).withColumn("p", F.slice(share, 1, len(FAMILIES) - 1))
    scored = scored.withColumn("best", F.array_max("p")).where(F.col("best") >= report)
    name = F.element_at(F.array(*[F.lit(f) for f in TEMPLATES]), F.array_position("p", F.col("best")).cast("int"))
    scored = scored.withColumn("family", F.when(F.col("best") >= model.least, name).otherwise(UNKNOWN))
    templates = _table(spark, [{"family": f, "t": sorted(set(_words(t)))} for f, ts in TEMPLATES.items() for t in ts], "family string, t array<string>")
    templates = templates.groupBy("family").agg(F.collect_list("t").alias("ts"))
    overlap = F.array_max(F.transform("ts", lambda t: F.size(F.array_intersect(t, F.col("w"))) / F.size(t)))
    compared = scored.join(F.broadcast(templates), "family", "left").withColumn("overlap", F.round(F.coalesce(overlap, F.lit(0.0)), 6))
    one = F.struct(F.first("doc_id").alias("doc_id"), F.max_by(F.struct("family", "best", "overlap"), F.struct("best", -F.col("part"))).alias("top"))
    rows = compared.groupBy("row", "paragraph").agg(one.alias("one")).select("one.doc_id", "paragraph", "one.top.*")
    confirmed = (F.col("family") != UNKNOWN) & (F.col("overlap") >= confirm)
    return rows.select("doc_id", "paragraph", "family", F.round("best", 6).alias("probability"), "overlap", confirmed.alias("confirmed"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
