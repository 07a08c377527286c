"""Licence families of documents by a trained paragraph classifier; DataFrame and SQL functions only."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Labelled paragraphs (family, part, text): public notices of the families, and other prose as unknown.
# The calibration part is not trained on; it sets the temperature of the probabilities.
LABELLED = [
    ("apache", "train", "Licensed under the Apache License, Version 2.0"),
    ("apache", "train", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "train", "This project is released under the Apache License 2.0."),
    ("apache", "train", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "calibrate", "Distributed under the terms of the Apache License, Version 2.0."),
    ("mit", "train", "Released under the MIT License."),
    ("mit", "train", "This software is licensed under the MIT License."),
    ("mit", "train", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "train", "The MIT License (MIT)"),
    ("mit", "calibrate", "Code is available under the terms of the MIT License."),
    ("gpl", "train", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "train", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "train", "Licensed under the GNU General Public License, version 2 or later"),
    ("gpl", "train", "GNU General Public License v3.0"),
    ("gpl", "calibrate", "Released under the terms of the GNU General Public License, version 3."),
    ("bsd", "train", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "train", "Licensed under the BSD 3-Clause License."),
    ("bsd", "train", "Use of this source code is governed by a BSD-style license"),
    ("bsd", "train", "Released under the BSD 2-Clause License."),
    ("bsd", "calibrate", "This code is distributed under the BSD 3-Clause License."),
    ("cc", "train", "Licensed under CC BY-NC 4.0."),
    ("cc", "train", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc", "train", "Licensed under CC BY-SA 4.0"),
    ("cc", "train", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    ("cc", "calibrate", "Except where noted, content is licensed under CC BY 4.0."),
    ("mpl", "train", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "train", "Licensed under the Mozilla Public License 2.0"),
    ("mpl", "train", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("mpl", "calibrate", "Distributed under the Mozilla Public License, version 2.0."),
    ("unknown", "train", "The driver renewed a license at the office and paid the fee for the new version."),
    ("unknown", "train", "The general was asked to speak to the public about the foundation of the town."),
    ("unknown", "train", "All rights reserved by the owner of the copyright in this work."),
    ("unknown", "train", "This is the story of a house under the hill, and of the people who lived in it."),
    ("unknown", "train", "You may use the pool with or without a towel, provided that the following rules are kept."),
    ("unknown", "train", "The terms of the agreement were published by the court in the following week."),
    ("unknown", "train", "Attribution of the picture to the old master is not certain."),
    ("unknown", "train", "The source of the river lies in the north, and the form of the valley is subject to change."),
    ("unknown", "train", "A creative use of the commons was permitted in the village."),
    ("unknown", "train", "Permission to enter the museum is granted free of charge on the first day of the month."),
    ("unknown", "train", "Er kam mit der Bahn und blieb mit den anderen bis zum Abend in der Stadt."),
    ("unknown", "train", "Sie ging mit dem Hund durch den Park, und das mit Freude."),
    ("unknown", "train", "The end."),
    ("unknown", "train", "Le chat et la souris sont dans la maison avec les enfants."),
    ("unknown", "train", "El perro de la casa y los gatos que viven en el campo."),
    ("unknown", "calibrate", "Das Haus mit dem roten Dach steht mit anderen am Ende der Strasse."),
    ("unknown", "calibrate", "The."),
    ("unknown", "calibrate", "The public library is under the general direction of the city."),
    ("unknown", "calibrate", "He was licensed to teach in the state, and worked at the school for many years."),
    ("unknown", "calibrate", "The copy of the letter was obtained at the sale of the house."),
]
FAMILIES = ("apache", "mit", "gpl", "bsd", "cc", "mpl", "unknown")
# Probability from which a family is reported, and share of the smaller set of word pairs that a template must have in common.
THRESHOLD, CONFIRM = 0.5, 0.5


def with_grams(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``grams``, the distinct words and word pairs of a text (lower-cased runs of letters, digits and everything above
    ASCII), and ``n``, the number of its distinct word pairs.  Each step is a column of its own, so it is computed once per row."""
    words = F.array_remove(F.split(F.lower(F.col(text)), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")
    pairs = F.zip_with(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 1, F.lit(0))), F.slice("_words", F.lit(2), F.size("_words")), lambda a, b: F.concat_ws(" ", a, b))
    listed = df.withColumn("_words", words).withColumn("_pairs", pairs).withColumn("_pairs", F.array_distinct("_pairs"))
    return listed.withColumn("grams", F.concat(F.array_distinct("_words"), "_pairs")).withColumn("n", F.size("_pairs")).drop("_words", "_pairs")


def _inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table as one literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


@dataclass
class LicenseModel:
    """Weights of each n-gram by family (in the order of FAMILIES), intercepts, n-grams of the templates, temperature."""

    weights: dict[str, list[float]]
    intercepts: list[float]
    templates: list[tuple[str, list[str]]]
    temperature: float


def fit_licenses(spark: SparkSession) -> LicenseModel:
    """Multinomial logistic regression over the n-grams of the labelled paragraphs, calibrated on the part left out."""
    table = _inline(spark, [{"y": FAMILIES.index(f), "part": part, "body": text} for f, part, text in LABELLED], "y: double, part: string, body: string")
    table = with_grams(table, "body")
    train = table.where("part = 'train'")
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0).fit(train)
    model = LogisticRegression(labelCol="y", family="multinomial", regParam=0.003, maxIter=100).fit(counter.transform(train))
    held = model.transform(counter.transform(table.where("part = 'calibrate'"))).select("y", "rawPrediction").collect()

    def loss(temperature: float) -> float:
        total = 0.0
        for y, raw in held:
            scaled = [x / temperature for x in raw.toArray()]
            total += math.log(sum(math.exp(x - max(scaled)) for x in scaled)) + max(scaled) - scaled[int(y)]
        return total

    matrix = model.coefficientMatrix.toArray()
    weights = {gram: [float(x) for x in matrix[:, i]] for i, gram in enumerate(counter.vocabulary)}
    templates = [(FAMILIES[int(y)], sorted(found)) for y, found in train.where(f"y < {len(FAMILIES) - 1}").select("y", "grams").collect()]
    best = min((t / 20 for t in range(20, 101)), key=loss)
    return LicenseModel(weights, [float(x) for x in model.interceptVector.toArray()], templates, best)


def scan_licenses(docs: DataFrame, model: LicenseModel, *, threshold: float = THRESHOLD, confirm: float = CONFIRM) -> DataFrame:
    """(doc_id, paragraph, family, probability, overlap, confirmed): the paragraphs that a licence family explains best.

    A paragraph is a line of the whole text.  Its distinct words and word pairs meet the model's weights in a broadcast join (their
    number is that of the labelled table), and their sums give calibrated probabilities.  Paragraphs whose best family is unknown,
    or less likely than ``threshold``, are not reported; a paragraph that shares no n-gram with the model is unknown.  A report is
    confirmed if the paragraph and a template of its family have at least ``confirm`` of the smaller one's word pairs in common.

    Null and empty texts have no paragraphs; repeated rows are reported each; further columns are ignored.
    """
    spark = docs.sparkSession
    k = len(FAMILIES)
    by_gram: dict[str, list[int]] = {}
    pairs = [[gram for gram in found if " " in gram] for _, found in model.templates]
    for t, found in enumerate(pairs):
        for gram in found:
            by_gram.setdefault(gram, []).append(t)
    rows = [{"gram": g, "w": w, "t": by_gram.get(g, [])} for g, w in model.weights.items()]
    weights = _inline(spark, rows, "gram: string, w: array<double>, t: array<int>")
    lines = docs.where("text is not null").select("doc_id", F.monotonically_increasing_id().alias("row"), F.posexplode(F.split("text", "\n")).alias("paragraph", "body"))
    found = with_grams(lines, "body").select("doc_id", "row", "paragraph", "n", F.explode("grams").alias("gram"))
    # The weights hold as many rows as the labelled paragraphs have n-grams.
    met = found.join(F.broadcast(weights), "gram")
    sums = [F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(k)]
    shared = [F.sum(F.array_contains("t", t).cast("int")).alias(f"t{t}") for t in range(len(model.templates))]
    scored = met.groupBy("doc_id", "row", "paragraph", "n").agg(*sums, *shared)
    logits = [(F.col(f"w{i}") + F.lit(b)) / model.temperature for i, b in enumerate(model.intercepts)]
    scored = scored.withColumn("logit", F.array(*logits))
    scored = scored.withColumn("top", F.array_max("logit")).withColumn("best", F.array_position("logit", F.col("top")).cast("int"))
    total = F.aggregate("logit", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    scored = scored.withColumn("probability", 1 / total).where((F.col("best") < k) & (F.col("probability") >= threshold))
    overlaps = [
        F.when(F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("best")) == family, F.col(f"t{t}") / F.greatest(F.least(F.col("n"), F.lit(len(pairs[t]))), F.lit(1))).otherwise(0.0)
        for t, (family, _) in enumerate(model.templates)
    ]
    overlap = F.greatest(*overlaps)
    return scored.select(
        "doc_id", F.col("paragraph").cast("int").alias("paragraph"), F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("best")).alias("family"),
        "probability", overlap.alias("overlap"), (overlap >= confirm).alias("confirmed"),
    )
