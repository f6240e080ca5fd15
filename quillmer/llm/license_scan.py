"""Licence scan: a paragraph classifier over sparse word n-grams, confirmed by templates. DataFrame functions only.

A paragraph is a run of lines without a blank one between (one without a letter or digit, so that an empty comment line is
blank). A notice may be one line of it or wrapped over several, with or without comment marks, so lines are judged alone, then
runs of up to JOINED lines. Features are the words and word pairs of the templates below that have at least one word which
isn't a function word. A softmax regression over them, with a class "unknown", is fitted on generated paragraphs; its
temperature and the probability from which a family is predicted are calibrated on others, among them cut notices, notices of
families that aren't known, and prose that uses their words. A predicted family stands if the lines hold enough of the word
pairs of one of its templates, so words must come in their order; short templates must stand as they are. A notice that is
denied ("not covered by the ...") doesn't stand. Of the runs that hold a notice the one that ends first is taken, and the
shortest of those, then the next one after it.

Lines without any feature have the bias alone, which means unknown (checked when fitting); so only paragraphs that hold a
feature word are looked at, with the same result as for all.

Defined results: a null or empty text has no paragraphs; repeated rows each get their row; a family found twice in a paragraph
or document is listed once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from random import Random

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, let

UNKNOWN = "unknown"

# Identifiers of each family in the list of licences in use.
IDENTIFIERS = {
    "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "apache": ["Apache-2.0"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "cc-by": ["CC-BY-3.0", "CC-BY-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc-by-sa": ["CC-BY-SA-3.0", "CC-BY-SA-4.0"], "cc0": ["CC0-1.0"],
    "gpl": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"], "isc": ["ISC"], "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"], "mit": ["MIT"], "mpl": ["MPL-2.0"], "unlicense": ["Unlicense"],
}
# Notices of each family, in the wording in use.
TEMPLATES = {
    "agpl": ["GNU Affero General Public License", "licensed under the GNU Affero General Public License version 3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "released under the Apache 2.0 license"],
    "bsd": ["BSD 3-Clause License", "released under the BSD license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["CC0 1.0 Universal Public Domain Dedication", "dedicated to the public domain under CC0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "licensed under the GPL version 2", "GNU General Public License"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "released under the ISC license"],
    "lgpl": ["GNU Lesser General Public License", "licensed under the GNU Lesser General Public License version 2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under the MIT license"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited", "Copyright 2024 the authors. All rights reserved"],
    "reserved": ["All rights reserved"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "released under the Unlicense"],
}
for _family, _names in IDENTIFIERS.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {_name}" for _name in _names]
#: the family of the bare reservation: a notice, but none that licenses or names terms
RESERVED = "reserved"
# Words of which the lines must hold one, where a family's notices are those of another one with a word more.
MARKS = {"agpl": ["affero", "agpl"], "lgpl": ["lesser", "lgpl"], "cc-by-nc": ["nc", "noncommercial"], "cc-by-sa": ["sa", "sharealike"]}
#: a denied notice, in lower-case words with a space between
DENIED = r"(?:^| )(?:not|never|no longer|isn t|aren t|wasn t|nor)(?: [a-z]+){0,3}? (?:covered|licensed|released|distributed|available|governed|under|subject)(?: |$)"
# Sentences that share words with notices and license nothing.
CONFUSERS = [
    "the driver lost the license after the test", "a public work of art stands in the general assembly", "the new version of the software is free to use this year", "people with a fishing license may obtain a copy at the office",
    "the apache tribe lived in the south", "permission to enter was granted by the foundation", "the conditions in the mine were strictly controlled", "he holds rights to the source of the river",
    "mozilla and gnu are names of projects", "the university mit is in massachusetts", "attribution of the painting is unknown", "file a copy of the form with the public library", "commons and lords met in international session", "a binary form of the word",
    "the author was granted a license to print the work in the public domain of the state",
]
# Notices of families without a template, and sentences, to calibrate with.
STRANGERS = [
    "made available under the terms of the Eclipse Public License 2.0", "licensed under the Artistic License 2.0", "distributed under the Boost Software License, Version 1.0", "licensed under the European Union Public Licence 1.2", "released under the zlib license",
    "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Zlib", "licensed under the Open Software License version 3.0", "subject to the terms of the Common Development and Distribution License", "SPDX-License-Identifier: BSL-1.0",
    "she renewed the license of the boat in version two of the form", "the terms of the public contract are subject to conditions", "the free copy of the file may be obtained at the source", "the software foundation published a general notice", "this work was reproduced in part by the authors", "rights to the work are held by the people",
]
FUNCTION_WORDS = frozenset("a an and any are as at be by can except following for from hereby in into is it its may met no nor not of on or part part: provided that the this to under use used was with without work you your he she they were stands new year people after fee purpose only later".split())

WORD_RE = "[^a-z0-9]+"
ROUNDS, PENALTY, SEED, TRAINING = 300, 1e-4, 11, 2400
#: precision of confirmed families that the calibrated probability threshold keeps
PRECISION = 0.99
#: share of a template's word pairs (of those with a word that isn't a function word) that the lines must hold
MIN_COVER = 0.6
#: lines over which a notice may be wrapped
JOINED = 8
#: templates of fewer words must stand as they are, since a share of them is common in prose
MIN_SHARED = 4


def words(text: str) -> list[str]:
    return [w for w in re.split(WORD_RE, text.lower()) if w]


def telling(pair: str) -> bool:
    return any(w not in FUNCTION_WORDS for w in pair.split())


def grams(ws: list[str]) -> set[str]:
    return set(filter(telling, (*ws, *map(" ".join, zip(ws, ws[1:])))))


def pairs(text: str) -> list[str]:
    ws = words(text)
    return sorted(set(filter(telling, map(" ".join, zip(ws, ws[1:])))))


def cover_of(ws: list[str], family: str) -> float:
    """Largest share of a template of the family that stands in the words, as the scan computes it."""
    if family in MARKS and not set(ws) & set(MARKS[family]):
        return 0.0
    have, whole = set(map(" ".join, zip(ws, ws[1:]))), f" {' '.join(ws)} "
    share = lambda t: float(f" {' '.join(words(t))} " in whole) if len(set(words(t))) < MIN_SHARED else len(have & set(pairs(t))) / len(pairs(t))
    return max(map(share, TEMPLATES[family]))


_SYLLABLES = (["an", "er", "st", "on", "the", "le", "ou", "in", "de", "ra"], ["ma", "ti", "or", "es", "un", "ve", "al", "ch", "no", "di"])


def training_paragraphs(part: int, n: int = TRAINING, seed: int = SEED) -> list[tuple[list[str], str]]:
    """Words and family of generated paragraphs: templates with dropped words and filler around, and other sentences.

    Part 0 is to learn from. Part 1, to calibrate, has other filler, notices that are cut off, of which those with less than
    half the words count as unknown, and the notices and sentences of STRANGERS."""
    r = Random(seed + part)
    filler = lambda k: ["".join(r.choice(_SYLLABLES[part]) for _ in range(r.randint(1, 4))) for _ in range(k)]
    families = [*TEMPLATES, *[UNKNOWN] * 5]
    common = [w for ts in TEMPLATES.values() for t in ts for w in words(t)]
    out = []
    for i in range(n):
        family = families[i % len(families)]
        if family == UNKNOWN:
            ws = words(r.choice(CONFUSERS if part == 0 else STRANGERS)) if r.random() < 0.6 else filler(r.randint(1, 25))
            for _ in range(r.randint(0, 2)):
                ws.insert(r.randint(0, len(ws)), r.choice(common))
        else:
            whole = words(r.choice(TEMPLATES[family]))
            ws = [w for w in whole if r.random() > 0.04]
            if part and len(whole) > 9 and r.random() < 0.3:
                ws = ws[: r.randint(2, len(ws))] if r.random() < 0.5 else ws[-r.randint(2, len(ws)) :]
                family = family if 2 * len(ws) >= len(whole) else UNKNOWN
            ws = filler(r.choice([0, 0, 0, 2, 6])) + ws + filler(r.choice([0, 0, 0, 3, 8]))
        out.append((ws, family))
    return out


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    vocabulary: tuple[str, ...]
    weights: np.ndarray  # a row per n-gram, the bias last
    temperature: float
    threshold: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


_fitted: list[Model] = []


def fit() -> Model:
    """Softmax regression by accelerated gradient descent; then temperature and threshold on the other part."""
    if _fitted:
        return _fitted[0]
    families = (*TEMPLATES, UNKNOWN)
    vocabulary = tuple(sorted(set().union(*(grams(words(t)) for ts in TEMPLATES.values() for t in ts))))
    index = {g: i for i, g in enumerate(vocabulary)}
    rows = [*training_paragraphs(0), *training_paragraphs(1, TRAINING // 2)]
    x = np.zeros((len(rows), len(vocabulary) + 1))
    x[:, -1] = 1
    for i, (ws, _) in enumerate(rows):
        x[i, [index[g] for g in grams(ws) if g in index]] = 1
    y = np.array([families.index(f) for _, f in rows])
    learn = np.arange(len(rows)) < TRAINING
    xl, target = x[learn], np.eye(len(families))[y[learn]]
    w = np.zeros((x.shape[1], len(families)))
    ahead, step = w.copy(), 4.0 / (xl**2).sum(1).max()
    for k in range(ROUNDS):
        grad = xl.T @ (_softmax(xl @ ahead) - target) * 8 / len(xl) + PENALTY * ahead
        new = ahead - step * grad
        ahead = new + k / (k + 3) * (new - w)
        w = new
    z, yt = x[~learn] @ w, y[~learn]
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(yt)), yt] + 1e-12).mean())
    p = _softmax(z / temperature)
    top, sure = p.argmax(1), p.max(1)
    threshold, tried = 0.5, [ws for ws, _ in rows[TRAINING:]]
    confirmed = np.array([families[k] != UNKNOWN and cover_of(ws, families[k]) >= MIN_COVER for ws, k in zip(tried, top)])
    for cut in np.arange(0.3, 1.0, 0.01):
        said = confirmed & (sure >= cut)
        threshold = float(cut)
        if said.any() and (top[said] == yt[said]).mean() >= PRECISION:
            break
    assert w[-1].argmax() == len(families) - 1, "a paragraph without features must be unknown"
    _fitted.append(Model(families, vocabulary, np.round(w, 6), temperature, threshold))
    return _fitted[0]


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


#: buckets of the table of weights
BUCKETS = 1024


def _weights(m: Model) -> Column:
    """The rows of weights in buckets by the hash of their n-gram, as one constant."""
    buckets: list[list] = [[] for _ in range(BUCKETS)]
    for g, row in zip(m.vocabulary, m.weights):
        buckets[xxhash.xxh64_intdigest(g.encode(), 42) % BUCKETS].append({"g": g, "w": row.tolist()})
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<g:string,w:array<double>>>>")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_paragraphs and found, an array of structs of paragraph (number among the
    text's paragraphs, from 0), family, probability and cover."""
    m = model or fit()
    bias, vocabulary, buckets = [float(b) for b in m.weights[-1]], list(m.vocabulary), _weights(m)
    single = sorted({w for g in m.vocabulary for w in g.split() if w not in FUNCTION_WORDS})
    names = _strings(m.families)

    def weigh(g: Column) -> Column:  # pmod of the signed hash by a power of two is that of the unsigned one
        return F.filter(F.get(buckets, F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")), lambda x: x["g"] == g)[0]["w"]

    def scored(text: Column, k: Column) -> Column:
        def decide(w: Column) -> Column:
            two = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
            return let(two, lambda p: let(F.array_distinct(F.filter(F.concat(w, p), lambda g: g.isin(vocabulary))), lambda feats: judged(w, p, feats)))

        def judged(w: Column, p: Column, feats: Column) -> Column:
            z = F.aggregate(feats, F.array(*[F.lit(b) for b in bias]), lambda a, g: F.zip_with(a, weigh(g), lambda u, v: u + v))
            exps = let(z, lambda zz: let(F.array_max(zz), lambda top: F.transform(zz, lambda v: F.exp((v - top) / m.temperature))))
            probs = let(exps, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(e, lambda v: v / s)))

            def name(pr: Column) -> Column:
                best = F.array_max(pr)
                family = F.get(names, (F.array_position(pr, best) - 1).cast("int"))
                denied = F.concat_ws(" ", w).rlike(DENIED)
                return F.struct(k.alias("paragraph"), F.when((best >= m.threshold) & ~denied, family).otherwise(UNKNOWN).alias("family"), best.alias("probability"), cover(w, p, family).alias("cover"))

            return let(probs, name)

        return let(F.array_remove(F.split(F.lower(text), WORD_RE), ""), decide)

    def cover(w: Column, p: Column, family: Column) -> Column:
        def share(text: str) -> Column:
            if len(set(words(text))) < MIN_SHARED:
                return F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")).contains(f" {' '.join(words(text))} ").cast("double")
            return F.size(F.array_distinct(F.filter(p, lambda x: x.isin(pairs(text))))) / len(pairs(text))

        marked = lambda f: F.exists(w, lambda x: x.isin(MARKS[f])) if f in MARKS else F.lit(True)
        return F.coalesce(*[F.when((family == f) & marked(f), F.greatest(F.lit(0.0), *[share(x) for x in ts])) for f, ts in TEMPLATES.items()], F.lit(0.0))

    holds = lambda p: F.exists(F.split(F.lower(p), WORD_RE), lambda w: w.isin(single))
    none = F.array().cast("array<struct<paragraph:int,family:string,probability:double,cover:double>>")
    stands = lambda r: (r["family"] != UNKNOWN) & (r["cover"] >= MIN_COVER)

    def searched(block: Column) -> Column:
        """The notices of a paragraph: of lines alone, then of the runs between them."""
        number, lines = block["k"], F.split(block["p"], "\n")
        return let(lines, lambda ls: let(F.transform(F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), x.alias("p"))), lambda x: holds(x["p"])), lambda x: let(scored(x["p"], number), lambda r: F.struct(x["i"].alias("i"), stands(r).alias("ok"), r.alias("r")))), lambda marked: both(ls, marked, number)))

    def runs(marked: Column) -> Column:
        """Structs of i and last: lines from one that holds a feature to another, none of which stands alone."""

        def after(x: Column, at: Column) -> Column:
            ahead = F.slice(marked, at + 2, F.lit(JOINED - 1))
            free = lambda y, j: ~x["ok"] & (y["i"] - x["i"] < JOINED) & ~F.exists(F.slice(ahead, F.lit(1), j + 1), lambda o: o["ok"])
            return F.transform(F.filter(ahead, free), lambda y: F.struct(x["i"].alias("i"), y["i"].alias("last")))

        return F.flatten(F.transform(marked, after))

    def apart(hits: Column) -> Column:
        zero = F.struct(F.lit(-1).alias("last"), none.alias("out"))
        step = lambda a, h: F.when(h["i"] > a["last"], F.struct(h["last"].alias("last"), F.concat(a["out"], F.array(h["r"])).alias("out"))).otherwise(a)
        return F.aggregate(F.sort_array(hits), zero, step)["out"]

    def both(ls: Column, marked: Column, number: Column) -> Column:
        alone = F.transform(F.filter(marked, lambda x: x["ok"]), lambda x: x["r"])
        text = lambda run: F.array_join(F.slice(ls, run["i"] + 1, run["last"] - run["i"] + 1), " ")
        joined = lambda run: F.struct(run["last"].alias("last"), (run["last"] - run["i"]).alias("more"), run["i"].alias("i"), scored(text(run), number).alias("r"))
        wrapped = let(runs(marked), lambda rs: F.when(F.size(rs) > 0, apart(F.filter(F.transform(rs, joined), lambda h: stands(h["r"])))).otherwise(none))
        return F.sort_array(F.concat(alone, wrapped))

    t, blocks = F.col("t"), F.col("blocks")
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("t"))
    cut = F.filter(F.split(t, r"\n(?:[^\p{L}\p{N}\n]*+\n)++", -1), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    split = rows.select("doc_id", cut.alias("blocks"))
    some = F.filter(F.transform(blocks, lambda p, k: F.struct(k.alias("k"), p.alias("p"))), lambda b: holds(b["p"]))
    return split.select("doc_id", F.size(blocks).cast("long").alias("n_paragraphs"), F.flatten(F.transform(some, searched)).alias("found"))


def report(docs: DataFrame, **columns) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_paragraphs, n_licensed and n_reserved (paragraphs with a notice, of families but
    reserved and of reserved), licenses (families, sorted, comma-joined), paragraphs (number:family, comma-joined)."""
    f = F.col("found")
    number = lambda ok: F.size(F.array_distinct(F.transform(F.filter(f, ok), lambda x: x["paragraph"]))).cast("long")
    names = F.array_sort(F.array_distinct(F.transform(f, lambda x: x["family"])))
    return scan(docs, **columns).select(
        "doc_id", "n_paragraphs", number(lambda x: x["family"] != RESERVED).alias("n_licensed"), number(lambda x: x["family"] == RESERVED).alias("n_reserved"), F.array_join(names, ",").alias("licenses"),
        F.array_join(F.array_distinct(F.transform(f, lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"]))), ",").alias("paragraphs"),
    )
