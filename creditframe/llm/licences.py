"""Licence scan: a trained paragraph classifier, confirmed by templates.

* Every line with a key term of licence notices is judged alone and, where
  that does not stand, with its paragraph (lines joined up to a blank line).
  Lines without a key term are of class ``unknown`` by definition.
* The classifier is multinomial logistic regression over sparse word 1- and
  2-grams (those of the templates).  It is trained on the labelled templates,
  alone and amid lines of the corpus, on sentences that only mention licences,
  and on plain lines; ``SAMPLE`` bounds the corpus lines used (the smallest
  hashes, so the sample does not depend on partitioning).
* Its scores are calibrated by a temperature fitted on a held-out fifth; below
  probability ``SURE`` a paragraph is ``unknown``.
* A prediction stands if the paragraph holds at least 0.8 of the five-word
  shingles of one of the family's templates (shorter templates: whole), or is one of its titles.

The scan is one narrow projection of built-in functions; the weights (at most
the n-grams of the templates) are a constant of the plan.  Training reads the
corpus once more for its sample.  No Python runs in the executors.

Edge cases: null and blank texts have no paragraphs; repeated rows are scanned
one by one; an empty table trains on the templates alone and returns nothing;
ties between classes go to the first in ``FAMILIES``.
"""

from __future__ import annotations

import json
from math import exp

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Short notices in common use, by licence family.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "This project is licensed under the Apache License 2.0.",
                   "Released under the Apache License, Version 2.0.", "Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License."),
    "MIT": ("The MIT License.", "Released under the MIT License.", "Licensed under the MIT License.",
            "This software is distributed under the terms of the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
            "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    "BSD": ("Licensed under the BSD 3-Clause License.", "Released under the BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted",
            "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.",
            "Released under the GNU General Public License, version 2.",
            "This program is free software: you can redistribute it under the terms of the GNU General Public License",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
            "as published by the Free Software Foundation",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License",
            "Licensed under the GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0",
            "SPDX-License-Identifier: GPL-2.0"),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is licensed under the GNU Lesser General Public License, version 3.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
             "License as published by the Free Software Foundation",
             "SPDX-License-Identifier: LGPL-2.1", "SPDX-License-Identifier: LGPL-3.0"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 License.",
              "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License."),
    "CC0": ("Released into the public domain under CC0 1.0.", "This work is dedicated to the public domain under CC0."),
    "Proprietary": ("All rights reserved.", "Copyright, all rights reserved.", "All rights reserved. No part may be reproduced without permission."),
}
#: Titles: the line holds nothing else.
TITLES = {
    "Apache-2.0": ("Apache License", "Apache License Version 2.0", "Apache License 2.0"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "BSD": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD License"),
    "GPL": ("GNU GENERAL PUBLIC LICENSE",),
    "LGPL": ("GNU LESSER GENERAL PUBLIC LICENSE",),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License, v. 2.0"),
}
#: Sentences that mention licences and grant none.
MENTIONS = (
    "You need a driving licence to rent a car.", "The fishing license costs ten euros a year.",
    "Ask for permission before you take photographs.", "The warranty lasts two years.",
    "The copyright office opened its doors.", "She lost her pilot license last summer.",
    "Public records are kept in the town hall.", "The council may license the shop to sell wine.",
    "A licence fee pays for the broadcaster.", "They discussed which license to choose.",
    "The road is licensed for heavy trucks under the old rules.", "The general public was not invited.",
)
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *TEMPLATES)
#: Key terms: a paragraph without any is unknown.
TERMS = ("licen", "copyright", "permission", "permitted", "rights reserved", "public domain", "creative commons")
SAMPLE = 400
SURE = 0.5
SIMILAR = 0.8
SHINGLE = 5


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _runs(words: Column, k: int) -> Column:
    """All runs of ``k`` words, space-joined; empty for fewer words."""
    return F.when(F.size(words) >= k, F.transform(
        F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.concat_ws(" ", F.slice(words, i, k))
    )).otherwise(F.array().cast("array<string>"))


def _ngrams(words: Column) -> Column:
    return F.concat(words, _runs(words, 2))


def _shingles(words: Column) -> Column:
    return F.when(F.size(words) > SHINGLE, _runs(words, SHINGLE)).otherwise(F.array(F.concat_ws(" ", words)))


def _lines(docs: DataFrame, text: str) -> Column:
    return F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "\n")


def _has_term(line: Column) -> Column:
    low = F.lower(line)
    out = F.lit(False)
    for t in TERMS:
        out = out | F.contains(low, F.lit(t))
    return out


def _constants(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("family"), F.lit(b).alias("notice")) for a, b in rows])))


def labelled(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Training rows (label, words): at most ``sample`` corpus lines enter."""
    spark = docs.sparkSession
    lines = docs.select(F.explode(_lines(docs, text)).alias("line")).filter(
        (F.length(F.trim("line")) > 0) & ~_has_term(F.col("line")))
    plain = written(lines.select(F.xxhash64("line").alias("h"), F.substring("line", 1, 200).alias("line"))
                    .distinct().orderBy("h", "line").limit(sample), "licence-lines")
    notices = _constants(spark, [(k, v) for known in (TEMPLATES, TITLES) for k, vs in known.items() for v in vs]
                         + [(UNKNOWN, m) for m in MENTIONS])
    # every notice alone, and before and behind lines of the corpus
    dealt = plain.select("line", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    numbered = written(notices.withColumn("slot", F.pmod(F.xxhash64("notice"), F.lit(8))), "licence-notices")
    amid = dealt.withColumn("slot", F.pmod(F.xxhash64("line", "i"), F.lit(8))).join(numbered, "slot").select(
        "family", F.when(F.col("i") % 2 == 0, F.concat_ws(" ", "line", "notice"))
        .otherwise(F.concat_ws(" ", "notice", "line")).alias("t"))
    rows = (notices.select("family", F.col("notice").alias("t")).unionByName(amid)
            .unionByName(plain.select(F.lit(UNKNOWN).alias("family"), F.col("line").alias("t"))))
    number = F.lit(0)
    for i, f in enumerate(FAMILIES):
        number = F.when(F.col("family") == f, i).otherwise(number)
    return rows.select(number.cast("double").alias("label"), _ngrams(_words(F.col("t"))).alias("grams"),
                       (F.pmod(F.xxhash64("t"), F.lit(5)) == 0).alias("held"))


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict:
    """Weights per n-gram and class, biases, and the fitted temperature."""
    spark = docs.sparkSession
    rows = written(labelled(docs, text, sample), "licence-training")
    grams = _constants(spark, [("", t) for known in (TEMPLATES, TITLES) for v in known.values() for t in v] + [("", m) for m in MENTIONS]).select(
        _ngrams(_words(F.col("notice"))).alias("grams"))
    counter = CountVectorizer(inputCol="grams", outputCol="x", binary=True).fit(grams)
    learner = LogisticRegression(featuresCol="x", family="multinomial", maxIter=60, regParam=0.002, standardization=False)
    model = learner.fit(counter.transform(rows.filter("not held")))
    n = model.numClasses
    weights = model.coefficientMatrix.toArray()
    book = {g: [round(float(weights[k][i]), 6) for k in range(n)] for i, g in enumerate(counter.vocabulary)}
    out = {"weights": book, "bias": [round(float(b), 6) for b in model.interceptVector.toArray()], "temperature": 1.0}
    # the temperature with the least loss on the held-out rows
    grid = [exp(0.1 * i) for i in range(-10, 21)]
    scored = rows.filter("held").select("label", _logits(F.array_distinct("grams"), out).alias("z"))

    def loss(t: float) -> Column:
        z = F.transform("z", lambda x: x / t)
        top = F.array_max(z)
        total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return F.sum(F.log(total) + top - F.get(z, F.col("label").cast("int")))

    losses = scored.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(grid)]).first()
    if losses[0] is not None:
        out["temperature"] = grid[min(range(len(grid)), key=lambda i: losses[i])]
    return out


def _logits(grams: Column, model: dict) -> Column:
    n = len(model["bias"])
    known = F.from_json(F.lit(json.dumps(model["weights"])), "map<string,array<double>>")
    each = F.filter(F.transform(grams, lambda g: F.try_element_at(known, g)), lambda w: w.isNotNull())
    return F.aggregate(each, F.array(*[F.lit(b) for b in model["bias"]]),
                       lambda a, w: F.zip_with(a, w, lambda x, y: x + y)) if n else F.array()


def scan(docs: DataFrame, model: dict, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(row struct of ``keys``, line, notice, predicted, p, similarity, family)
    per paragraph with a key term; ``family`` is what stands in the end."""
    lines = _lines(docs, text)
    # line numbers of blank lines, and one before the first and behind the last
    blank = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(F.regexp_replace(x, r"\s", "")) == "", i)), lambda i: i.isNotNull())
    gaps = F.concat(F.array(F.lit(-1)), blank, F.array(F.size(lines)))
    split = docs.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("row"), lines.alias("all"), gaps.alias("gaps"))
    paragraphs = F.transform(F.sequence(F.lit(0), F.size("gaps") - 2), lambda k: F.struct(
        (F.get("gaps", k) + 1).alias("first"),
        F.slice("all", F.get("gaps", k) + 2, F.get("gaps", k + 1) - F.get("gaps", k) - 1).alias("lines")))
    found = split.filter(F.exists("all", _has_term)).select("row", F.inline(F.filter(
        paragraphs, lambda x: F.exists(x["lines"], _has_term))))
    whole = _judged(found.withColumn("words", F.when(F.size("lines") > 1, _words(F.concat_ws(" ", "lines")))
                                     .otherwise(F.array().cast("array<string>"))), model, "row", "first", "lines")
    numbered = F.transform("lines", lambda x, i: F.struct((F.col("first") + i).alias("line"), x.alias("notice")))
    single = whole.select("row", F.col("verdict").alias("whole"), F.inline(F.filter(numbered, lambda x: _has_term(x["notice"]))))
    judged = _judged(single.withColumn("words", _words(F.col("notice"))), model, "row", "line", "notice", "whole")
    # a line that stands alone does; any other is judged with its paragraph
    chosen = F.when((F.col("verdict.family") == UNKNOWN) & (F.col("whole.family") != UNKNOWN), F.col("whole")).otherwise(F.col("verdict"))
    return judged.withColumn("v", chosen).select("row", "line", "notice", "v.predicted", "v.p", "v.similarity", "v.family")


def _judged(rows: DataFrame, model: dict, *keep: str) -> DataFrame:
    """``keep`` and the verdict (predicted, p, similarity, family) on ``words``."""
    z = rows.withColumn("z", _logits(F.array_distinct(_ngrams(F.col("words"))), model))
    t = model["temperature"]
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp((x - top) / t))
    predicted = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.array_position("z", top).cast("int"))
    judged = z.withColumn("p", 1 / total).withColumn("predicted", predicted)

    def nearest(family: str) -> Column:
        mine = _shingles(F.col("words"))
        best = F.lit(0.0)
        for notice in TEMPLATES[family]:
            words = F.array(*[F.lit(w) for w in _plain_words(notice)])
            part = F.size(F.array_intersect(_shingles(words), mine)) / F.size(_shingles(words))
            if len(_plain_words(notice)) < SHINGLE:
                part = F.contains(F.concat(F.lit(" "), F.concat_ws(" ", "words"), F.lit(" ")),
                                  F.lit(" " + " ".join(_plain_words(notice)) + " ")).cast("double")
            best = F.greatest(best, part)
        titles = [" ".join(_plain_words(x)) for x in TITLES.get(family, ())]
        return F.when(F.concat_ws(" ", "words").isin(titles), 1.0).otherwise(best) if titles else best

    similarity = F.lit(0.0)
    for family in TEMPLATES:
        similarity = F.when(F.col("predicted") == family, nearest(family)).otherwise(similarity)
    judged = judged.withColumn("similarity", similarity)
    stands = (F.col("p") >= SURE) & (F.col("similarity") >= SIMILAR)
    family = F.when(stands, F.col("predicted")).otherwise(UNKNOWN)
    return judged.select(*keep, F.struct("predicted", "p", "similarity", family.alias("family")).alias("verdict"))


def _plain_words(notice: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in notice.lower()).split()
