import math
import re

import pytest
from pyspark.sql import functions as F

from rillflow.llm import licenses
from rillflow.llm.licenses import FAMILIES, OTHERS, TEMPLATES, fit, license_paragraphs, paragraphs

#: Wordings that the fit has not seen, and licences of no family.
HELD_OUT = [
    ("mit", "This file is distributed under the terms of the MIT license, see LICENSE."), ("mit", "The source is released under the MIT License by its authors."), ("mit", "Copyright 2019 by the authors, licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal\nin the Software without restriction."),
    ("apache-2.0", "This product is made available under the Apache License 2.0"), ("apache-2.0", "You may use this library under the Apache License, Version 2.0 only."), ("apache-2.0", "Contributions are licensed under the Apache License."),
    ("gpl", "You may redistribute this under the terms of the GNU General Public License v3."), ("gpl", "This software is free software under the GNU General Public License."), ("gpl", "It is licensed under the GPL version 3."),
    ("lgpl", "This module is distributed under the terms of the GNU Lesser General Public License."), ("lgpl", "The library is free software, licensed under the LGPL version 3."),
    ("bsd", "Redistribution and use in source and binary forms are permitted\nprovided that the following conditions are met."), ("bsd", "The code is licensed under the BSD 3-clause license."), ("bsd", "Released under the terms of the BSD license."),
    ("mpl", "This file is subject to the Mozilla Public License, version 2.0."), ("mpl", "The program is licensed under the terms of the Mozilla Public License."),
    ("cc-by", "This article is licensed under CC BY 3.0."), ("cc-by-sa", "The pictures are licensed under CC BY-SA 3.0."), ("cc-by-nc", "This text is licensed under CC BY-NC 3.0."), ("cc-by-sa", "Licensed under a Creative Commons Attribution-ShareAlike 3.0 License."),
    ("cc0", "The author dedicated this work to the public domain under CC0 1.0."), ("proprietary", "Copyright by the publisher. All rights reserved."),
    ("unknown", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unknown", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."), ("unknown", "Distributed under the terms of the Python Software Foundation License."), ("unknown", "The contents of this file are subject to the Common Public Attribution License."),
]


@pytest.fixture(scope="module")
def plain(spark, small):
    """The corpus without the documents that state a licence."""
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("text not rlike '(?i)licen|rights reserved'")


@pytest.fixture(scope="module")
def fitted(plain):
    return fit(plain)


def test_held_out_wordings(spark, fitted, prose):
    docs = [(i, f"{prose(30, i)}.\n{t[:1].upper() + t[1:]}\n{prose(30, i + 99).capitalize()}.") for i, (_, t) in enumerate(HELD_OUT)]
    got = {r["doc_id"]: r["family"] for r in license_paragraphs(spark.createDataFrame(docs, "doc_id long, text string"), fitted).collect()}
    wrong = [(t, got.get(i)) for i, (f, t) in enumerate(HELD_OUT) if got.get(i) != f]
    assert len(wrong) <= 0.1 * len(HELD_OUT), wrong


def test_own_templates(spark, fitted):
    own = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [("unknown", t) for t in OTHERS]
    got = {r["doc_id"]: r["family"] for r in license_paragraphs(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(own)], "doc_id long, text string"), fitted).collect()}
    assert sum(got.get(i) == f for i, (f, _) in enumerate(own)) >= 0.9 * len(own)


def test_plain_text_states_none(plain, fitted):
    assert license_paragraphs(plain, fitted).count() == 0


def test_no_hit_without_a_trigger(spark, plain, fitted):
    """Brute force: scores of all paragraphs, by the weights themselves, without leaving any out."""
    texts = [r["line"] for r in plain.limit(60).select(F.explode(paragraphs(F.col("text"))).alias("line")).collect()] + [t for _, t in HELD_OUT]
    weights, bias, place = fitted.model.coefficientMatrix.toArray(), list(fitted.model.interceptVector), {g: i for i, g in enumerate(fitted.features.vocabulary)}
    want = {}
    for i, t in enumerate(texts):
        words = re.sub("[^a-z0-9]+", " ", t.lower()).split()
        grams = {place[g] for g in [*words, *map(" ".join, zip(words, words[1:]))] if g in place}
        margins = [(b + sum(w[j] for j in grams)) / fitted.temperature for b, w in zip(bias, weights)]
        p = 1 - math.exp(margins[0]) / sum(map(math.exp, margins))
        if words and p >= fitted.level:
            want[i] = p
    got = {r["doc_id"]: r["probability"] for r in license_paragraphs(spark.createDataFrame([(i, t.replace("\n", " ")) for i, t in enumerate(texts)], "doc_id long, text string"), fitted).collect()}
    assert set(got) == set(want) and len(want) >= 20 and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_model_does_not_depend_on_partitions(spark, prose):
    docs = spark.createDataFrame([(i, prose(40, i) + ".") for i in range(120)], "doc_id long, text string")
    models = [fit(docs.repartition(n)) for n in (1, 7)]
    assert models[0].features.vocabulary == models[1].features.vocabulary and models[0].triggers == models[1].triggers
    assert (models[0].model.coefficientMatrix.toArray() == models[1].model.coefficientMatrix.toArray()).all() and models[0].level == models[1].level


def test_paragraphs(spark):
    cases = {"": [], " \n\t\n": [], "a b\nc d.\nE": ["a b\nc d.", "E"], "A\nB": ["A", "B"], "One\n\ntwo": ["One", "two"], "x y:\nz": ["x y:", "z"]}
    got = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", paragraphs(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == list(cases.values())


def test_odd_rows(spark, odd_docs, no_docs, fitted):
    assert license_paragraphs(odd_docs, fitted).count() == 0
    assert license_paragraphs(no_docs, fitted).count() == 0
    twice = spark.createDataFrame([(1, "Released under the MIT License.")] * 2 + [(1, "All rights reserved."), (None, "All rights reserved."), (2, None)], "doc_id long, text string").withColumn("line", F.lit("own"))
    assert sorted((r["doc_id"] or 0, r["family"]) for r in license_paragraphs(twice, fitted).collect()) == [(0, "proprietary"), (1, "mit"), (1, "mit"), (1, "proprietary")]


def test_query_keeps_rows(spark, tmp_path, prose):
    rows = [(100 + i, ".\n".join(prose(30, 50 * i + j) for j in range(8))) for i in range(40)] + [(1, "Released under the MIT License.\n" + prose(12, 7) + ".")] * 2 + [(1, "All rights reserved."), (None, "All rights reserved."), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"] or 0, r["n_paragraphs"], r["n_license"], r["families"]) for r in licenses.op3_license_scan(spark, str(tmp_path)).collect() if (r["doc_id"] or 0) < 100)
    assert got == [(0, 1, 1, "proprietary"), (1, 1, 1, "proprietary"), (1, 2, 1, "mit"), (1, 2, 1, "mit"), (3, 0, 0, ""), (4, 0, 0, "")]


def test_empty_table(spark, no_docs):
    assert fit(no_docs).level >= 0.5 and len(FAMILIES) == len(TEMPLATES) + 2
