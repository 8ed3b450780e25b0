"""License scan: a trained paragraph classifier on word n-grams, in DataFrame operations only.

Sparse multinomial logistic regression on all word n-grams (1 to 3) of a candidate paragraph tells licence families
apart; an unknown class and a least probability keep doubtful paragraphs `unknown`. Probabilities are calibrated by a
temperature, and the least one is chosen, on templates that the judging model hasn't seen (FOLDS of whole templates);
below it a prediction stands only if it is confirmed.
A prediction is confirmed if one template of the family has a share CONFIRM of the telling n-grams, of the template's own or
of the paragraph's, whichever are fewer, and no other family has as many n-grams of its own in the paragraph. Telling are
n-grams with a licence word (STEMS) that templates of at most FEW_FAMILIES families hold, and in a paragraph also those
that none holds: what all notices say confirms nothing. Other licences (OTHERS) teach the unknown class. The model learns from the templates below, variants of
them and lines of prose, on the driver, and never sees the corpus; its vocabulary is bounded by the templates, so it is
broadcast; n-grams that it doesn't hold have no weight.

A paragraph ends at a blank line and at a line's end; but a line break inside an unfinished sentence, before a small
letter or after WRAPPED characters, is a space. Paragraphs are numbered from 0, blank lines included. Candidates are
those with a licence word, or with MIT or ISC in capitals; each of them gives a row, at least as unknown.

Handling of special cases: null and empty texts give no rows; ties go to the family first in alphabetical order; rows
repeated with the same doc_id and text count once; null keys are kept; very long texts are scanned whole, and so are
very long lines; columns of other names are not read.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import read_table

UNKNOWN = "unknown"
CONFIRM, LIKELY = 0.6, 0.35  # share of n-grams; probability that a confirmed prediction needs
MOST_WORDS = 3
FEW_FAMILIES = 4

# Stems of legal words, and short notices of well-known licences.
STEMS = ("licen", "copyright", "warrant", "redistribut", "permission", "permit", "creative commons", "cc by", "cc0", "public domain", "rights reserved", "spdx", "gnu", "apache", "mozilla", "bsd", " gpl", " lgpl", " agpl", " mpl", "sharealike", "noncommercial", "noderiv", "attribution non", "attribution share", "attribution no ")
NAMES = (" mit ", " isc ")  # licence words of a candidate; alone they make one only in capitals
ACRONYMS = r"(?<![A-Za-z0-9])(?:MIT|ISC)(?![A-Za-z0-9])"
WRAPPED = 40
COMMENT = r"[ \t]*(?:(?:#+|//+|\*)[ \t]+)?"
BREAK = rf"(?<=[^\s.!?:;])[ \t]*\r?\n{COMMENT}(?=[a-z0-9(])|(?<=[^\n]{{{WRAPPED - 1}}}[^\s.!?:;])[ \t]*\r?\n{COMMENT}(?=[^\s#*/])"
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0", "This project is released under the Apache 2.0 license."],
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.", "Released under the GNU AGPL version 3 license.", "SPDX-License-Identifier: AGPL-3.0-or-later", "You should have received a copy of the GNU Affero General Public License along with this program.", "Released under AGPLv3.", "Distributed under AGPL-3.0"],
    "bsd-3-clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Released under the 3-clause BSD License.", "Licensed under the BSD license.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "This text is available under the Creative Commons Attribution License."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Available under CC BY-NC-SA for noncommercial use."],
    "cc-by-nd": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0.", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0", "This text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and placed this work in the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "Released under the GNU GPL version 2 license.", "SPDX-License-Identifier: GPL-3.0-or-later", "You should have received a copy of the GNU General Public License along with this program.", "Released under GPLv3.", "Released under GPLv2.", "Distributed under GPL-3.0", "Distributed under GPL-2.0"],
    "isc": ["Released under the ISC License.", "Licensed under the ISC license.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "lgpl": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the GNU LGPL version 3 license.", "SPDX-License-Identifier: LGPL-2.1-or-later", "You should have received a copy of the GNU Lesser General Public License along with this library.", "Released under LGPLv3.", "Distributed under LGPL-2.1"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)", "Released under the MIT terms."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, you can obtain one at the Mozilla site; this license applies.", "SPDX-License-Identifier: MPL-2.0", "Released under the Mozilla Public License 2.0.", "MPL 2.0", "Released under MPL 2.0."],
    UNKNOWN: ["All rights reserved.", "Copyright by the authors. All rights reserved.", "The driver lost the licence after the accident.", "A fishing license costs ten dollars and is valid for one year.", "Please ask for permission before you enter the room.", "The city council permitted the construction of the bridge.", "The warranty covers parts and labour for two years.", "He studied at the MIT laboratory before the war.", "The apache helicopter landed near the village.", "The gnu crossed the river with the herd.", "Copyright law protects authors for seventy years.", "Police had a warrant for the house.", "The song entered the public domain last year, the museum said.", "A licence fee pays for the programme.", "License plate numbers were written down.", "The license was renewed.", "Licensed under a contract.", "It is licensed under other terms.", "Licensed under seal.", "Released under licence.", "Available under license.", "See the license for details.", "A license is needed here.", "The author holds the copyright.", "You may read the license agreement.", "With permission of the author.", "Reproduction without written permission is forbidden.", "This document is distributed under a license agreement between the parties."],
}
# Notices of licences of other families, which are unknown here.
OTHERS = """
SPDX-License-Identifier: {}
Licensed under the {}.
Released under the {} license.
"""
OTHER_NAMES = ["EPL-2.0", "EUPL, Version 1.2", "EUPL-1.2", "Zlib", "MIT-0", "BSD-2-Clause", "2-clause BSD", "0BSD", "CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0", "Unlicense", "Artistic-2.0", "MS-PL", "Microsoft Public License", "ODbL-1.0", "Open Database License", "GFDL-1.3", "GNU Free Documentation License, Version 1.3", "OFL-1.1", "BSL-1.0", "Boost Software License", "WTFPL", "CDDL-1.0", "Eclipse Public License, Version 2.0", "European Union Public Licence", "Python-2.0", "PostgreSQL"]
TEMPLATES[UNKNOWN] += [OTHERS.strip().split("\n")[i % 3].format(name) for i, name in enumerate(OTHER_NAMES)]
FAMILIES = sorted(TEMPLATES)
PROSE = "the of and to a in is that it was for on as with he be at by this had not are but from have they which you were all an there been one who their more if no out so said what up its about into than them can only other new some time could these two may then do first any my now such like our over me even most made after also did many before must through years where much your way well down should because each just those people how too little state good very make world still own see men work long here get both between life being under never day same another know".split()


def tokens(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def ngrams(words: list[str]) -> list[str]:
    """Distinct n-grams, as the scan makes them."""
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in range(1, MOST_WORDS + 1) for i in range(len(words) - n + 1)))


def is_legal(gram: str) -> bool:
    """Whether a licence word occurs."""
    return any(s in f" {gram} " for s in STEMS + NAMES)


def _variants(text: str, rng: np.random.Generator) -> list[str]:
    """The notice, parts of it, and it among other words, a few or many."""
    words = text.split()
    out = [text]
    for _ in range(6):
        a, z = sorted(rng.choice(len(words) + 1, 2, replace=False)) if len(words) > 4 else (0, len(words))
        part = words[a:z] if is_legal(" ".join(tokens(" ".join(words[a:z])))) else words
        out.append(" ".join([*["text"] * int(rng.integers(0, 3)), *[w for w in part if rng.random() > 0.1], *["more"] * int(rng.integers(0, 3))]))
    for n in (15, 40, 80):
        plain = [str(w) for w in rng.choice(PROSE, n)]
        cut = int(rng.integers(0, n + 1))
        out.append(" ".join([*plain[:cut], *words, *plain[cut:]]))
    return out


LINES = [(f, t) for f in FAMILIES for t in TEMPLATES[f]]  # templates by number
KNOWN = [(f, t) for f, t in LINES if f != UNKNOWN]  # those that confirm
FOLDS = 4


@lru_cache
def telling() -> dict[str, int]:
    """The n-grams with a licence word that templates of few families hold: the family's number, or -1 if there are several."""
    found: dict[str, set[int]] = {}
    for f, t in KNOWN:
        for g in ngrams(tokens(t)):
            found.setdefault(g, set()).add(FAMILIES.index(f))
    return {g: min(k) if len(k) == 1 else -1 for g, k in found.items() if len(k) <= FEW_FAMILIES and is_legal(g)}


@lru_cache
def model() -> tuple[dict[str, tuple[list[float], list[int]]], list[float], float, float]:
    """For each n-gram of the vocabulary its weights and whether each template has it; biases; the temperature; the least
    probability."""
    rng = np.random.default_rng(17)
    made = [(ngrams(tokens(v)), FAMILIES.index(f), i % FOLDS) for i, (f, t) in enumerate(LINES) for v in _variants(t, rng)]
    made += [(ngrams([str(w) for w in rng.choice(PROSE, int(rng.integers(5, 40)))]), FAMILIES.index(UNKNOWN), i % FOLDS) for i in range(60)]
    vocabulary = sorted({g for _, t in LINES for g in ngrams(tokens(t))} | set(PROSE))
    at = {g: i for i, g in enumerate(vocabulary)}
    rows = [(own, k, fold) for gs, k, fold in made if (own := [g for g in gs if g in at])]
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (gs, _, _) in enumerate(rows):
        x[i, [at[g] for g in gs]] = 1 / math.sqrt(len(gs))
    y, fold = np.array([k for _, k, _ in rows]), np.array([f for _, _, f in rows])
    judged = np.zeros((len(rows), len(FAMILIES)))
    for f in range(FOLDS):
        w, b = _fit(x[fold != f], y[fold != f], rounds=150)
        judged[fold == f] = x[fold == f] @ w + b
    temperature = min(np.exp(np.linspace(-3, 2, 101)), key=lambda t: -np.log(np.maximum(_softmax(judged / t)[np.arange(len(y)), y], 1e-12)).mean())
    p = _softmax(judged / temperature)
    right, best = p.argmax(1) == y, p.max(1)
    # the least probability above which nine of ten predictions on unseen templates are right
    least = next((t for t in np.arange(0.2, 0.95, 0.05) if right[best >= t].mean() >= 0.9), 0.95)
    w, b = _fit(x, y)
    own = [telling().keys() & set(ngrams(tokens(t))) for _, t in KNOWN]
    return {g: ([round(float(v), 6) for v in w[i]], [int(g in o) for o in own]) for g, i in at.items()}, [round(float(v), 6) for v in b], round(float(temperature), 4), round(float(least), 2)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, l1: float = 2e-4, rounds: int = 600, rate: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Proximal gradient descent: log loss with an L1 penalty, which leaves a sparse table."""
    w, b = np.zeros((x.shape[1], len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    for _ in range(rounds):
        d = (_softmax(x @ w + b) - target) / len(x)
        w -= rate * x.T @ d
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        b -= rate * d.sum(0)
    return w, b


def has_stem(text: Column) -> Column:
    """Whether a licence word may occur: a plain search, which is all that most texts and lines cost."""
    low = F.lower(text)
    return _any([*(low.contains(s) for s in dict.fromkeys(s.strip().split(" ")[0] for s in STEMS if s not in (" lgpl", " agpl", " mpl"))), text.rlike(ACRONYMS + r"|(?<![A-Za-z0-9])[Mm][Pp][Ll]")])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of doc_id, paragraph (its number from 0), family, probability, template_share and confirmed."""
    spark = docs.sparkSession
    table, bias, temperature, least = model()
    tells = telling()
    vocabulary = spark.createDataFrame([(g, w, t, tells.get(g, -1), g in tells) for g, (w, t) in sorted(table.items())], "gram string, w array<double>, t array<int>, tells int, few boolean")
    lines = docs.filter(has_stem(F.col(text))).select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.regexp_replace(text, BREAK, " "), "\n")).alias("paragraph", "line")).filter(has_stem(F.col("line"))).dropDuplicates(["doc_id", "paragraph", "line"])
    plain = F.trim(F.regexp_replace(F.lower("line"), "[^a-z0-9]+", " "))
    padded = F.concat(F.lit(" "), plain, F.lit(" "))
    rows = lines.filter(_any([*(padded.contains(s) for s in STEMS), F.col("line").rlike(ACRONYMS)])).select("doc_id", "paragraph", F.xxhash64("line").alias("line"), F.split(plain, " ").alias("words"))
    rest = lambda n: F.slice("words", n, 1 << 30)
    after = lambda g, w: F.when(g.isNotNull() & w.isNotNull(), F.concat(g, F.lit(" "), w))
    two = F.zip_with("words", rest(2), after)
    grams = [F.col("words"), two, F.zip_with(two, rest(3), after)]  # no lambda refers to the words, which would make them again for each gram
    legal = lambda g: _any([F.concat(F.lit(" "), g, F.lit(" ")).contains(s) for s in STEMS + NAMES])
    featured = rows.select("doc_id", "paragraph", "line", F.explode(F.array_distinct(F.filter(F.concat(*grams), lambda g: g.isNotNull()))).alias("gram")).withColumn("legal", legal(F.col("gram")).cast("int"))
    met = featured.join(F.broadcast(vocabulary), "gram", "left")
    k = len(FAMILIES)
    known = F.col("w").isNotNull().cast("int")
    sums = met.groupBy("doc_id", "paragraph", "line").agg(F.greatest(F.lit(1), F.sum(known)).alias("n"), F.greatest(F.lit(1), F.sum(F.when(F.col("w").isNull() | F.col("few"), F.col("legal")).otherwise(0))).alias("m"), *(F.sum((F.col("tells") == i).cast("int")).alias(f"f{i}") for i in range(k)), *(F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"w{i}") for i in range(k)), *(F.coalesce(F.sum(F.col("t")[i] * F.col("legal")), F.lit(0)).alias(f"t{i}") for i in range(len(KNOWN))))
    sizes = [max(1, len(tells.keys() & set(ngrams(tokens(t))))) for _, t in KNOWN]
    share = lambda f: F.greatest(F.lit(0.0), F.lit(-1.0), *(F.col(f"t{j}") / F.least(F.col("m"), F.lit(sizes[j])) for j, (g, _) in enumerate(KNOWN) if g == f))
    logits = sums.select("doc_id", "paragraph", F.array(*(F.struct(((F.col(f"w{i}") / F.sqrt("n") + bias[i]) / temperature).alias("z"), F.lit(-i).alias("k"), F.lit(f).alias("family"), F.when(_leads(i, k), share(f)).otherwise(0.0).alias("share")) for i, f in enumerate(FAMILIES))).alias("z"))
    best = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x["z"] - best["z"]))
    scored = logits.select("doc_id", "paragraph", best.alias("best"), (1 / total).alias("p"))
    sure = (F.col("best.family") != UNKNOWN) & ((F.col("p") >= least) | (F.col("p") >= LIKELY) & (F.col("best.share") >= CONFIRM))
    agreed = F.when(sure, F.col("best.share")).otherwise(0.0)
    return scored.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.when(sure, F.col("best.family")).otherwise(UNKNOWN).alias("family"), F.round("p", 6).alias("probability"), F.round(agreed, 6).alias("template_share"), (agreed >= CONFIRM).alias("confirmed"))


def _leads(i: int, k: int) -> Column:
    """Whether no other family has as many n-grams of its own in the paragraph as family i."""
    count = lambda j: F.coalesce(F.col(f"f{j}"), F.lit(0))
    most = F.greatest(F.lit(0), F.lit(0), *(count(j) for j in range(k) if j != i))
    return (most == 0) | (count(i) > most)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of every whole text of documents."""
    return scan(read_table(spark, sf_dir, "documents"))
