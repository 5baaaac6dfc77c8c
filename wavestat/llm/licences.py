"""Licence scan: a trained paragraph classifier confirmed by templates.

Paragraphs are the lines of a text, long lines cut at sentence ends; a line is
also read with the lines that follow it without a blank one, up to ``JOIN_WORDS``
words, and that counts if it confirms a notice that no single line does.  A sparse
multinomial logistic regression over word 1- to 3-grams is fitted on the
templates below (whole, cut and embedded in corpus words) against ``unknown``:
paragraphs that speak of licences without granting one, and a bounded sample of
corpus lines (``MAX_LINES``).  A temperature fitted on held-out paragraphs
calibrates the probabilities.  A prediction is confirmed if enough of the best
template of the family stands in the paragraph in order.

Null or blank text has no paragraphs; every document gets one row.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrays, column, strings
from .decontaminate import common_words

MAX_LINES, MAX_LINE_WORDS, ACCEPT, CONFIRM, JOIN_WORDS = 2000, 60, 0.5, 0.6, 40
#: Usual short notices of licence families.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
               "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "This software is distributed under the terms of the MIT License."],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GPL, version 2 or later.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
            "Licensed under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL.", "SPDX-License-Identifier: LGPL-2.1"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL.", "SPDX-License-Identifier: AGPL-3.0"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.",
            "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released into the public domain under the Unlicense."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without permission."],
}
UNKNOWN = "unknown"
OTHERS = ["You need a driving license to rent a car.", "The license fee is due each year.", "He was licensed to sell food in the city.",
          "General public transport is free of charge.", "The public domain of the web was released in version 2.",
          "Students of the institute worked under the apache helicopter.", "The terms of the contract are subject to permission.",
          "Version 3 of the work was released.", "This work is under way.", "This file is in use.", "The software is free."]
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+(?=[A-Z(\"'])")


def tokens(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(ws: list[str]) -> list[str]:
    return [" ".join(ws[i:i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


class Model:
    def __init__(self, lines: list[str]):
        """``lines``: ordinary corpus lines, without a licence for all the model knows."""
        self.families = [UNKNOWN, *TEMPLATES]
        self.words = {f: [tokens(t) for t in ts] for f, ts in TEMPLATES.items()}
        plain = [tokens(x)[:MAX_LINE_WORDS] for x in [*OTHERS, *lines]]
        plain = [w for w in plain if w]
        rows = [(w, 0) for w in plain]
        for k, (f, ts) in enumerate(self.words.items(), 1):
            for j, w in enumerate(ts):
                side = plain[zlib.crc32(f"{f}{j}".encode()) % len(plain)]
                rows += [(w, k)] * 4 + [(side[:6] + w, k), (w + side[:6], k), (side[:4] + w + side[-4:], k)]
                if len(w) > 8:
                    rows += [(w[: 2 * len(w) // 3], k), (w[len(w) // 3:], k)]
        self.vocabulary = {g: i for i, g in enumerate(sorted({g for w, k in rows if k for g in grams(w)}))}
        known = {g for g in self.vocabulary if " " not in g}
        self.known = known
        x = np.zeros((len(rows), len(self.vocabulary) + 1), np.float32)
        for r, (w, _) in enumerate(rows):
            x[r, self.places(w)] = 1
        x[:, -1] = 1
        x[:, :-1] /= np.sqrt(np.maximum(x[:, :-1].sum(1, keepdims=True), 1))
        y = np.array([k for _, k in rows])
        test = np.arange(len(rows)) % 7 == 3
        size = np.where(y == 0, 0.5, 1.0)
        one = np.eye(len(self.families), dtype=np.float32)[y]

        def fit(use):
            w = np.zeros((x.shape[1], len(self.families)), np.float32)
            speed = np.zeros_like(w)
            for _ in range(150):
                p = self._soft(x[use] @ w)
                speed = 0.9 * speed - 2.0 * (x[use].T @ ((p - one[use]) * size[use, None]) / use.sum() + 1e-5 * w)
                w += speed
            return w

        held = fit(~test)
        heats = np.array([0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0])
        loss = [-(np.log(self._soft(x[test] @ held / h)[np.arange(test.sum()), y[test]] + 1e-9) * size[test]).sum() for h in heats]
        self.heat = float(heats[int(np.argmin(loss))])
        self.weights = fit(np.ones(len(rows), bool))

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def places(self, ws: list[str]) -> list[int]:
        """Places of the 1- to 3-grams in the vocabulary, which holds every shorter gram of a gram."""
        known, vocabulary = self.known, self.vocabulary
        at = [i for i, w in enumerate(ws) if w in known]
        pairs = {i: vocabulary[g] for i, j in zip(at, at[1:]) if j == i + 1 and (g := f"{ws[i]} {ws[j]}") in vocabulary}
        triples = [vocabulary[g] for i in pairs if i + 1 in pairs and (g := " ".join(ws[i:i + 3])) in vocabulary]
        return list({*(vocabulary[ws[i]] for i in at), *pairs.values(), *triples})

    def judged(self, paragraphs: list[list[str]]) -> list[tuple[str, float]]:
        """(family, calibrated probability) of each paragraph."""
        if not paragraphs:
            return []
        z = np.empty((len(paragraphs), len(self.families)))
        for r, ws in enumerate(paragraphs):
            at = self.places(ws)
            z[r] = self.weights[-1] + (self.weights[at].sum(0) / np.sqrt(len(at)) if at else 0)
        p = self._soft(z / self.heat)
        best = p.argmax(1)
        return [(self.families[k], x) for k, x in zip(best.tolist(), p[np.arange(len(p)), best].tolist())]

    def __call__(self, ws: list[str]) -> tuple[str, float, float]:
        """(family, calibrated probability, share of the family's best template found in order)"""
        family, p = self.judged([ws])[0]
        return family, p, 0.0 if family == UNKNOWN else self.share(family, ws)

    def share(self, family: str, ws: list[str]) -> float:
        return max(common_words(t, ws) / len(t) for t in self.words[family])

    @staticmethod
    def lines(text: str) -> list[list[list[str]]]:
        """The words of every line, by sentence for a long line."""
        return [[tokens(part) for part in (_SENTENCE.split(line) if len(line) > 200 else (line,))] for line in text.split("\n")]

    def paragraphs(self, lines: list[list[list[str]]]) -> list[tuple[int, list[str]]]:
        """(line, words) of those that could be a licence: two or more words of the vocabulary."""
        return [(i, ws) for i, parts in enumerate(lines) for ws in parts if sum(map(self.known.__contains__, ws)) >= 2]

    def wrapped(self, lines: list[list[list[str]]]) -> list[tuple[int, int, list[str], list[str]]]:
        """(line, line after the last, words of the line's end, words of the lines that follow) of the lines read with others."""
        words = [[w for ws in parts for w in ws] for parts in lines]
        out = []
        for i in range(len(words) - 1):
            ws = lines[i][-1]
            if not words[i + 1] or self.known.isdisjoint(ws):
                continue
            end, rest = i + 1, []
            while end < len(words) and words[end] and len(ws) + len(rest) < JOIN_WORDS:
                rest += words[end]
                end += 1
            if rest:
                out.append((i, end, ws, rest[:JOIN_WORDS]))
        return out

    def found(self, text: str) -> list[tuple[bool, float, float, str, int]]:
        """(confirmed, share, probability, family, line) of the paragraphs that hold a licence."""
        lines = self.lines(text)
        single = self.paragraphs(lines)
        hits = []
        for (i, ws), (family, p) in zip(single, self.judged([ws for _, ws in single])):
            if family != UNKNOWN and p >= ACCEPT:
                share = self.share(family, ws)
                hits.append((share >= CONFIRM, share, p, family, i))
        sure = {h[4] for h in hits if h[0]}
        joined = [x for x in self.wrapped(lines) if sure.isdisjoint(range(x[0], x[1]))]
        until: dict[str, int] = {}  # the line after the last joined notice of each family
        for (i, end, ws, rest), (family, p) in zip(joined, self.judged([ws + rest for _, _, ws, rest in joined])):
            if family == UNKNOWN or p < ACCEPT or i < until.get(family, 0):
                continue
            share = self.share(family, ws + rest)
            if share < CONFIRM or self.share(family, rest) >= share:
                continue
            until[family] = end
            hits = [h for h in hits if h[0] or not i <= h[4] < end] + [(True, share, p, family, i)]
        return hits


def trained(docs: DataFrame, max_lines: int = MAX_LINES) -> Model:
    """Fit with a bounded sample of corpus lines (first line of the documents of smallest id hash)."""
    line = F.substring(F.substring_index("text", "\n", 1), 1, 400)  # cut before the sort, so that no whole text leaves a task
    rows = (docs.where("text is not null").select("doc_id", line.alias("line"))
            .orderBy(F.xxhash64("doc_id"), "doc_id", "line").limit(max_lines).select("line").collect())
    marks = re.compile(r"licen[sc]e|copyright|gpl|public domain|all rights", re.I)
    return Model(sorted({r.line for r in rows if not marks.search(r.line)}))


def scanned(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: its licence families and the paragraph that decides (best similarity, then probability)."""
    def run(batches):
        for b in batches:
            rows = []
            for text in strings(b, "text"):
                hits = model.found(text or "")
                best = max(hits, default=None)
                confirmed = sorted({h[3] for h in hits if h[0]})
                rows.append((best[3] if best else UNKNOWN, ("confirmed" if best[0] else "unconfirmed") if best else "none",
                             best[2] if best else None, best[1] if best else None, best[4] if best else None, confirmed, len(hits)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.string()), pa.int64()]
            yield arrays(["doc_id", "family", "verdict", "probability", "similarity", "line", "families", "n_paragraphs"],
                         [column(b, "doc_id"), *(pa.array([*c], t) for c, t in zip(cols, types, strict=True))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, family string, verdict string, probability double, "
                                                    "similarity double, line long, families array<string>, n_paragraphs long")
