"""Licence notices in texts: a trained paragraph classifier, in DataFrame functions and Spark's own learning library.

Paragraphs are bags of words and word pairs. A sparse multinomial logistic regression is fitted on notices and paragraphs
of each family, on some of other licences, and on a bounded sample of the corpus's own paragraphs as the class without a
licence. Its probabilities are calibrated by a temperature on rows held out of the fit, and so is the level from which a
paragraph states a licence. The family counts where it is the likelier part of that probability and where ordered words of
the paragraph confirm it; else the licence is unknown.

Every paragraph is judged, but only some are scored: what the model can give at most to a paragraph without certain words
is known from its weights, and where that cannot reach the level nothing needs to be computed.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, materialize, read

#: Paragraphs and notices of public licences, by family.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "The MIT License (MIT)",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.", "Distributed under the Apache 2.0 license.", "Apache License Version 2.0, January 2004", "Released under the terms of the Apache Software License.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GPL version 2 or later.", "Licensed under GPL-3.0.", "Distributed under the GNU GPL v3.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the LGPL version 2.1.", "This library is licensed under the GNU Lesser General Public License.", "Released under LGPL-3.0.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
        "Licensed under the BSD 3-Clause License.", "BSD 2-Clause License", "Released under a BSD-style license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License.", "Released under the MPL 2.0.", "Distributed under the terms of the Mozilla Public License Version 2.0.",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Released under a CC-BY 3.0 license."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Released under a CC BY-NC-SA license, for noncommercial use only."),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0.", "Released under CC0 1.0 Universal.",
    ),
    "proprietary": (
        "All rights reserved.", "Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}
#: Licences of no family above, which the model learns as one more class.
OTHERS = (
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph appear in all copies.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the European Union Public Licence (EUPL).", "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License.", "Distributed under the Boost Software License, Version 1.0.", "Licensed under the zlib license.", "Distributed under the terms of the WTFPL.",
    "Released under the Academic Free License.", "This code is available under the Microsoft Public License.", "Licensed under the terms of the Open Software License.",
)
#: Ordered words that name a family; one of them, or enough of its paragraphs' word triples, confirms it.
NAMES = {
    "mit": ("mit license", "mit licence", "license mit"),
    "apache-2.0": ("apache license", "apache licence", "apache 2 0", "apache software license"),
    "gpl": ("gnu general public", "gnu gpl", "the gpl", "gpl version", "gpl v2", "gpl v3", "gplv2", "gplv3", "gpl 2", "gpl 3"),
    "lgpl": ("lesser general public", "the lgpl", "lgpl version", "lgpl v2", "lgpl v3", "lgplv2", "lgplv3", "lgpl 2", "lgpl 3"),
    "bsd": ("bsd license", "bsd licence", "bsd 2 clause", "bsd 3 clause", "bsd style license", "clause bsd"),
    "mpl": ("mozilla public license", "mozilla public licence", "mpl 2 0", "the mpl"),
    "cc-by": ("cc by 4", "cc by 3", "cc by 2", "cc by license", "commons attribution 4", "commons attribution 3", "commons attribution license", "commons attribution international"),
    "cc-by-sa": ("cc by sa", "attribution sharealike", "attribution share alike"),
    "cc-by-nc": ("cc by nc", "attribution noncommercial", "attribution non commercial"),
    "cc0": ("cc0 1", "under cc0", "creative commons zero"),
    "proprietary": ("all rights reserved", "proprietary and confidential"),
}
FAMILIES = ("none", *TEMPLATES, "other")
#: Features at most: those of the notices, and what so many sampled paragraphs hold; documents that are sampled on average;
#: their paragraphs that the fit sees at most, and as many held out.
FEATURES, COMMON, SAMPLE_DOCS, SAMPLE = 2**13, 20, 4000, 6000
#: Share of held-out paragraphs that may pass, bounds of the level, share of a licence's probability that a family needs,
#: and share of a paragraph's word triples that its paragraphs hold.
FALSE, LEVELS, CERTAIN, CONFIRM = 0.0005, (0.5, 0.95), 0.5, 0.6
#: Lengths and steps, in words, of the windows of long paragraphs that the fit sees, and of those held out.
WINDOWS, HELD_WINDOWS = ((12, 6), (24, 12)), ((9, 5), (17, 11))
TEMPERATURES = (0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0)
#: A line goes on in the next one where that starts with a small letter and this one does not end a sentence.
BREAK = r"[ \t\r]*\n(?![a-z])\s*|(?<=[.!?:;])[ \t\r]*\n\s*"


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text: its lines, wrapped ones put together, blank ones left out; none for a null."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    wrapped = F.exists(lines, lambda x: (x >= "a") & (x < "{"))
    return F.filter(F.when(wrapped, F.split(text, BREAK)).otherwise(lines), lambda x: F.translate(x, SPACE_CHARS, "") != "")


def _tokens(line: Column) -> Column:
    """Words of a paragraph; there may be empty ones at its ends."""
    return F.split(F.lower(line), "[^a-z0-9]+")


def _plain(line: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in line.lower()).split()


def _grams(words: list[str], n: int) -> list[str]:
    """Word n-grams; all words as one where there are fewer."""
    return [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def _bags(df: DataFrame) -> DataFrame:
    """Adds words and grams to df (line); rows without a word are dropped.

    Arrays that several expressions use come through a generator, which computes them once.
    """
    w = df.withColumn("words", F.explode(F.array(F.filter(_tokens(F.col("line")), lambda x: x != "")))).where("size(words) > 0")
    pairs = F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.concat_ws(" ", a, b))
    return w.withColumn("grams", F.concat("words", pairs))


def _confirmed(family: str) -> Column:
    """Whether the words of a paragraph confirm a family."""
    triples = {f: {t for x in TEMPLATES[f] for t in _grams(_plain(x), 3)} for f in TEMPLATES}
    others = {t for f in TEMPLATES if f != family for t in triples[f]} | {t for x in OTHERS for t in _grams(_plain(x), 3)}
    has = lambda some: F.split(F.lit("|".join(sorted(some))), "[|]")
    own = F.arrays_overlap("triples", has(triples[family] - others)) & (F.size(F.array_intersect("triples", has(triples[family]))) >= F.size(F.array_distinct("triples")) * CONFIRM)
    named = F.lit(False)
    for name in NAMES[family]:
        named = named | F.contains("joined", F.lit(f" {name} "))
    return named | own


def _positives(windows) -> list[tuple[str, float]]:
    """Notices and paragraphs of all classes with a licence, and windows of the long ones: words, label."""
    out = []
    for label, texts in enumerate((*TEMPLATES.values(), OTHERS), 1):
        for words in map(_plain, texts):
            if windows is WINDOWS:
                out += [" ".join((*a, *words, *z)) for a, z in (((), ()), (("notice",), ()), (("all", "files", "here", "are"), ()), ((), ("see", "the", "file")))]
            for size, step in windows:
                out += [" ".join(words[i : i + size]) for i in range(0, max(0, len(words) - size // 2), step)] if len(words) > size else [" ".join(words)]
        out = [x if isinstance(x, tuple) else (x, float(label)) for x in out]
    return sorted(set(out))


class Licenses:
    """The fitted classifier: features, weights, temperature, level, and the words without one of which nothing passes."""

    def __init__(self, features: CountVectorizerModel, model: LogisticRegressionModel, temperature: float, level: float, triggers: list[str]):
        self.features, self.model, self.temperature, self.level, self.triggers = features, model, temperature, level, triggers

    def scored(self, df: DataFrame) -> DataFrame:
        """df (line) with words, margins by class (in the order of FAMILIES) and the calibrated probability of any licence."""
        bags = self.features.transform(_bags(df))
        # Through a generator, margins are computed once, whatever is made of them.
        raw = self.model.transform(bags).select(*df.columns, "words", F.explode(F.array(vector_to_array("rawPrediction"))).alias("margins"))
        return raw.withColumn("probability", 1 - _share(0, self.temperature))


def _total(temperature: float) -> Column:
    return sum((F.exp(F.get("margins", F.lit(k)) / temperature) for k in range(1, len(FAMILIES))), F.exp(F.get("margins", F.lit(0)) / temperature))


def _share(i: int, temperature: float) -> Column:
    """Calibrated probability of a class, from margins."""
    return F.exp(F.get("margins", F.lit(i)) / temperature) / _total(temperature)


def _triggers(vocabulary: list[str], model: LogisticRegressionModel, temperature: float, level: float, frequency: dict[str, int]) -> list[str]:
    """Words of which a paragraph has one at least if it passes the level.

    Its odds need a class whose weights add up to `least` beyond those of none. Each feature's largest gain is put down
    to its rarest word. The words left out are those whose gains all together stay below that, the commonest first.
    """
    weights, bias = model.coefficientMatrix.toArray().tolist(), list(model.interceptVector)
    least = temperature * math.log(level / (1 - level) / (len(bias) - 1)) - max(b - bias[0] for b in bias[1:])
    gains: dict[str, float] = {}
    for i, gram in enumerate(vocabulary):
        if (gain := max(w[i] - weights[0][i] for w in weights[1:])) > 0:
            word = min(gram.split(" "), key=lambda w: (frequency.get(w, 0), w))
            gains[word] = gains.get(word, 0.0) + gain
    out, left = [], least - 1e-6
    for word in sorted(gains, key=lambda w: (gains[w] / (frequency.get(w, 0) + 0.01), w)):
        if gains[word] < left:
            left -= gains[word]
        else:
            out.append(word)
    # Where the bias alone reaches the level, no word is needed.
    return sorted(out) if least > 0 else []


def fit(docs: DataFrame) -> Licenses:
    """The classifier from paragraphs of docs (doc_id, text): of about SAMPLE_DOCS documents by hash, 2 * SAMPLE at most.

    The sample, its split, the features and the order of rows follow from what the rows hold, and the fit runs in one
    partition of bounded size, so the model is the same however docs is partitioned.
    """
    spark = docs.sparkSession
    share = min(1.0, SAMPLE_DOCS / max(docs.count(), 1))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(2**20)) < math.ceil(share * 2**20))
    lines = some.select(F.explode(paragraphs(F.col("text"))).alias("line")).distinct()
    lines = lines.orderBy(F.xxhash64("line", F.lit(3)), "line").limit(2 * SAMPLE)
    # What the comparison with templates knows is no paragraph without a licence.
    known = F.lit(False)
    for f in TEMPLATES:
        known = known | _confirmed(f)
    bags = _with_triples(_bags(lines)).where(~known).select("line", (F.pmod(F.xxhash64("line"), F.lit(2)) == 0).alias("held"))
    negative = materialize(bags.coalesce(1), "lines")
    around = [" ".join(_plain(r["line"])[:8]) for r in negative.where("not held").orderBy(F.xxhash64("line", F.lit(4)), "line").limit(500).collect()]
    plain = _positives(WINDOWS)
    # Words of the corpus around the notices keep them from deciding.
    mixed = [(f"{around[i % len(around)]} {t}" if i % 2 else f"{t} {around[i % len(around)]}", y) for i, (t, y) in enumerate(plain)] if around else []
    rows = spark.createDataFrame([(*x, True) for x in plain] + [(*x, False) for x in mixed], "line string, label double, own boolean").withColumn("weight", F.lit(5.0))
    rows = rows.unionByName(negative.where("not held").select("line", F.lit(0.0).alias("label"), F.lit(False).alias("own"), F.lit(1.0).alias("weight")))
    rows = materialize(_bags(rows).orderBy("label", "line").coalesce(1), "fit")
    counts = rows.select("label", "own", F.explode(F.array_distinct("grams")).alias("g")).groupBy("g").agg(F.count_if(F.col("label") == 0).alias("free"), F.max(F.col("own") & (F.col("label") > 0)).alias("own"))
    chosen = counts.where(F.col("own") | (F.col("free") >= COMMON)).orderBy(F.desc("own"), F.desc("free"), "g").limit(FEATURES).collect()
    vocabulary = [r["g"] for r in chosen]
    features = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True)
    sparse = features.transform(rows.coalesce(1)).select("features", "label", "weight")
    model = LogisticRegression(maxIter=25, regParam=3e-4, elasticNetParam=0.3, weightCol="weight", family="multinomial", labelCol="label").fit(sparse)

    held = negative.where("held").select("line", F.lit(0).alias("label"))
    held = held.unionByName(spark.createDataFrame(_positives(HELD_WINDOWS), "line string, label double").select("line", F.col("label").cast("int").alias("label")))
    raw = materialize(model.transform(features.transform(_bags(held))).select("label", vector_to_array("rawPrediction").alias("margins")), "held")
    loss = lambda t: F.avg(F.log(_total(t)) - F.get("margins", F.col("label")) / t)
    losses = raw.agg(*(loss(t).alias(f"l{i}") for i, t in enumerate(TEMPERATURES))).first()
    temperature = min(zip(losses, TEMPERATURES))[1]
    level = raw.where("label = 0").agg(F.percentile(1 - _share(0, temperature), 1 - FALSE)).first()[0]
    level = min(max(LEVELS[0], level or 0.0), LEVELS[1])
    return Licenses(features, model, temperature, level, _triggers(vocabulary, model, temperature, level, {r["g"]: r["free"] for r in chosen}))


def _with_triples(df: DataFrame) -> DataFrame:
    """Adds triples and joined, the words between blanks, to df (words)."""
    n = F.greatest(F.size("words") - 2, F.lit(1))
    triples = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("words", i, F.lit(3)), " "))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    made = df.select(*df.columns, F.explode(F.array(F.struct(triples.alias("triples"), joined.alias("joined")))).alias("_x"))
    return made.select(*df.columns, "_x.*")


def license_paragraphs(docs: DataFrame, fitted: Licenses | None = None) -> DataFrame:
    """Paragraphs of docs (doc_id, text) that state a licence: doc_id, text_hash, paragraph_no (from 0), line, family,
    probability.

    text_hash is a 64-bit hash of the whole text; rows equal in doc_id and text give equal rows. family is unknown where the
    model is not certain of one or the words do not confirm it. Null and empty texts have no paragraphs; an empty table
    gives no rows. Every paragraph of every text takes part, in the stage that scans it.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    fitted = fitted or fit(docs)
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(paragraphs(F.col("text"))).alias("paragraph_no", "line"))
    if fitted.triggers:
        lines = lines.where(F.arrays_overlap(_tokens(F.col("line")), F.split(F.lit("|".join(fitted.triggers)), "[|]")))
    hits = _with_triples(fitted.scored(lines).where(F.col("probability") >= fitted.level))
    family = F.lit("unknown")
    for i, f in enumerate(FAMILIES[1:-1], 1):
        likely = (_share(i, fitted.temperature) >= F.col("probability") * CERTAIN) & _confirmed(f)
        family = F.when(likely, f).otherwise(family)
    return hits.select("doc_id", "text_hash", "paragraph_no", "line", family.alias("family"), "probability")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: its paragraphs, those that state a licence, and the families, in alphabetical order."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_paragraphs(docs).select("doc_id", "text_hash", "paragraph_no", "family").distinct()
    found = found.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.count("*").alias("n_license"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"))
    out = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"))
    out = out.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_license", F.lit(0).cast("long")).alias("n_license"), F.coalesce("families", F.lit("")).alias("families"))
