"""Licence notices in text (operator 1). DataFrame functions only.

Paragraphs are classified by a multinomial logistic regression over word 1-
and 2-grams, trained here on varied licence templates and on a bounded sample
of the corpus's own lines as the class ``none``. A paragraph is a line, or a
run of lines of a notice that is wrapped. Only n-grams of the templates that
contain a rare word are features; how rare a word is, is counted over all lines of the
corpus. A line without a rare word has the score of the empty one, so it need not be looked at, and one pattern over the text finds the others.

A family counts if its probability passes a cutoff calibrated on held-out
variants and enough of one of the family's templates stands in the paragraph;
otherwise the paragraph is a licence of class ``unknown``.

* null and empty text: no paragraph, no family
* repeated rows are judged one by one, null ``doc_id`` too; the result has one row for each row of the input
* empty table: an empty result; the templates alone are the training set
* very long texts are read whole; extra columns are not read
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stored
from .decontamination import LOWER, UPPER, words

NONE, UNKNOWN = "none", "unknown"
#: Public notices of each licence family.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1 or later."),
    ("agpl", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced or distributed without prior written permission of the copyright holder."),
    (UNKNOWN, "Licensed under the terms of the license agreement."),
    (UNKNOWN, "This software is licensed under its own public license, see the license file for details."),
    (UNKNOWN, "Released under a custom open source license."),
    (UNKNOWN, "Use is subject to license terms."),
]
VARIANTS = 40  # of each template
#: Bound of the sample of lines of class ``none`` that the regression is fitted on, in documents (about; drawn by hash).
BACKGROUND_DOCS = 500
RARE = 0.005  # a feature word is in at most this share of all lines
#: Lines of a wrapped notice follow each other with at most this many lines without a rare word between them.
GAP = 1
#: Words of a line that is no example of the class ``none``.
SPEAKS_OF = ["license", "licence", "licensed", "licenses", "licences", "copyright", "reserved"]
MISS = 0.02  # share of held-out variants that a cutoff may turn away


def grams(w: Column) -> Column:
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(1))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))
    return F.array_distinct(F.concat(w, F.coalesce(pairs, F.expr("CAST(array() AS ARRAY<STRING>)"))))


def template_rows(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("number"), F.lit(f).alias("label"), F.lit(t).alias("text")) for k, (f, t) in enumerate(TEMPLATES)])
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.*").withColumn("w", words(F.col("text")))


def line_words(docs: DataFrame) -> DataFrame:
    """``w``: the words of each line that has any and does not speak of licences."""
    lines = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line")).select(words(F.col("line")).alias("w"))
    return lines.where((F.size("w") > 0) & ~reduce(lambda a, b: a | b, [F.array_contains("w", x) for x in SPEAKS_OF]))


def common_words(docs: DataFrame, vocabulary: list[str]) -> set[str]:
    """Words of ``vocabulary`` that are in too many lines; counted over all lines."""
    marked = F.array_distinct(F.concat(F.array(F.lit("")), "w"))  # the empty word counts the lines
    seen = line_words(docs).select(F.explode(marked).alias("w")).where(F.col("w").isin([*vocabulary, ""])).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in seen.collect()}  # at most the words of the templates
    most = max(RARE * counts.pop("", 0), 1)
    return {w for w, n in counts.items() if n > most}


def background(docs: DataFrame) -> DataFrame:
    """Numbered lines of a bounded sample, without any that speak of licences."""
    share = min(1.0, BACKGROUND_DOCS / max(docs.count(), 1))
    drawn = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000))
    lines = line_words(drawn).distinct()
    return stored(lines.withColumn("number", F.row_number().over(Window.orderBy(F.xxhash64("w"), "w")) - 1), "op1-background")


def any_of(words: list[str]) -> str:
    """Pattern for one of the words: a tree of their common beginnings, so a letter is looked at once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [c + (any_of(rest) if rest != [""] else "") for c, rest in sorted(heads.items()) if c]
    whole = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return f"(?:{whole})?" if "" in heads else whole


@dataclass
class LicenseModel:
    features: CountVectorizerModel
    classes: list[str]
    regression: LogisticRegressionModel
    cutoffs: dict[str, float]
    overlap: float
    rare_words: list[str]

    def pattern(self) -> str:
        """Finds a rare word between separators."""
        inside = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
        return f"(?<!{inside}){any_of(sorted(self.rare_words))}(?!{inside})" if self.rare_words else "(?!)"

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``probabilities`` (in the order of ``classes``), ``overlaps`` (family -> largest share of a template found) to rows with ``w``."""
        scored = self.regression.transform(self.features.transform(rows.withColumn("grams", grams(F.col("w")))))
        best = {}
        for family, text in TEMPLATES:
            parts = F.array_distinct(grams(words(F.lit(text))))
            share = F.size(F.array_intersect("grams", parts)) / F.size(parts)
            best[family] = F.greatest(best[family], share) if family in best else share
        return scored.withColumn("probabilities", vector_to_array("probability")).withColumn("overlaps", F.create_map(*[x for f, c in best.items() for x in (F.lit(f), c)])).drop("features", "rawPrediction", "probability", "prediction")


def train(docs: DataFrame) -> LicenseModel:
    spark = docs.sparkSession
    templates, none = template_rows(spark), background(docs)
    n_none = none.count()
    vocabulary = sorted({r["w"] for r in templates.select(F.explode("w").alias("w")).distinct().collect()})
    common = common_words(docs, vocabulary)
    rare = [w for w in vocabulary if w not in common]
    all_grams = [r["g"] for r in templates.select(F.explode(grams(F.col("w"))).alias("g")).distinct().collect()]
    kept = sorted(g for g in all_grams if any(w in set(rare) for w in g.split(" ")))

    # variants: most of a template's words, with words of a background paragraph before and after
    each = templates.select("number", "label", "w", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("variant")).withColumn("row", F.col("number") * VARIANTS + F.col("variant"))
    pick = lambda salt, n: F.pmod(F.xxhash64("row", F.lit(salt)), n).cast("int")
    cut = F.when(F.col("variant") < VARIANTS // 4, F.lit(0)).otherwise(pick(1, F.greatest(F.floor(F.size("w") * 0.3), F.lit(1)).cast("int")))
    first = pick(2, cut + 1)
    each = each.withColumn("cut", cut).withColumn("own", F.slice("w", first + 1, F.size("w") - F.col("cut")))
    empty = F.expr("CAST(array() AS ARRAY<STRING>)")
    if n_none:
        each = each.withColumn("other", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(n_none))).join(none.select(F.col("number").alias("other"), F.col("w").alias("noise")), "other")
        each = each.withColumn("own", F.concat(F.slice("noise", 1, pick(4, F.lit(9))), F.col("own"), F.slice("noise", 9, pick(5, F.lit(9)))))
    held = F.pmod(F.xxhash64("row", F.lit(6)), F.lit(4)) == 0
    positive = each.select("label", F.col("own").alias("w"), held.alias("held"))
    negative = none.select(F.lit(NONE).alias("label"), "w", F.lit(False).alias("held")).union(spark.range(20).select(F.lit(NONE), empty, F.lit(False)))
    classes = sorted({f for f, _ in TEMPLATES} | {NONE})
    number = F.create_map(*[x for k, c in enumerate(classes) for x in (F.lit(c), F.lit(float(k)))])
    features = CountVectorizerModel.from_vocabulary(kept, inputCol="grams", outputCol="features", minTF=0.0).setBinary(True)
    rows = stored(positive.union(negative).withColumn("grams", grams(F.col("w"))).withColumn("label_number", F.element_at(number, F.col("label"))).coalesce(2), "op1-training")
    fitted = LogisticRegression(featuresCol="features", labelCol="label_number", family="multinomial", maxIter=60, regParam=0.002).fit(features.transform(rows.where("NOT held")))
    model = LicenseModel(features, classes, fitted, {}, 0.0, rare)

    place = F.create_map(*[x for k, c in enumerate(classes) for x in (F.lit(c), F.lit(k))])
    seen = model.score(rows.where("held").drop("grams")).select("label", F.get("probabilities", F.element_at(place, F.col("label"))).alias("p"), F.element_at("overlaps", F.col("label")).alias("o")).collect()  # bounded by the templates
    for family in classes:
        own = sorted(r["p"] for r in seen if r["label"] == family)
        model.cutoffs[family] = own[math.floor(MISS * len(own))] if own else 0.5
    shares = sorted(r["o"] for r in seen if r["label"] != UNKNOWN)
    model.overlap = shares[math.floor(MISS * len(shares))] if shares else 0.5
    return model


def candidates(text: Column, pattern: str) -> Column:
    """Lines with a rare word, and runs of them: array of (first line, last line, text); a line before the runs it is in."""
    low = lambda c: F.translate(c, UPPER, LOWER)
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda line, k: F.struct(k.alias("line"), line.alias("text"))), lambda x: low(x["text"]).rlike(pattern))
    return F.when(low(text).rlike(pattern), lines)


def runs_of(lines: Column) -> Column:
    """Runs of at least two candidate lines with gaps of at most ``GAP`` lines, as (first line, last line, text)."""
    starts = F.filter(F.transform(lines, lambda x, k: F.when((k == 0) | (x["line"] - F.get(lines, k - 1)["line"] > GAP + 1), k)), lambda k: k.isNotNull())
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(lines)))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))
    whole = F.transform(F.filter(runs, lambda r: F.size(r) > 1), lambda r: F.struct(F.get(r, F.lit(0))["line"].alias("line"), F.element_at(r, -1)["line"].alias("last"), F.array_join(F.transform(r, lambda x: x["text"]), " ").alias("text")))
    return F.coalesce(whole, F.expr("CAST(array() AS ARRAY<STRUCT<line: INT, last: INT, text: STRING>>)"))


def find_licenses(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``; ``licenses``, an array of (first line from 0, last line, family, probability, overlap); ``families``, sorted; ``n_unknown``, the
    number of lines of class unknown outside wrapped notices.

    A line that is a notice by itself is reported as such. A run of lines is
    reported if its family is none that its lines have by themselves; its
    lines then do not count as unknown.
    """
    model = model or train(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.select("row", "doc_id", candidates(F.col("text"), model.pattern()).alias("lines"))
    single = F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["line"].alias("last"), x["text"].alias("text")))
    # only here a row is multiplied: its number is given above
    lines = found.select("row", "doc_id", F.explode_outer(F.concat(single, runs_of(F.col("lines")))).alias("p")).select("row", "doc_id", "p.line", "p.last", words(F.col("p.text")).alias("w"))
    scored = model.score(lines)
    none, unknown = model.classes.index(NONE), model.classes.index(UNKNOWN)
    best = F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1
    names = F.array(*[F.lit(c) for c in model.classes])
    cutoffs = F.array(*[F.lit(model.cutoffs[c]) for c in model.classes])
    scored = scored.withColumn("best", best).withColumn("p", F.array_max("probabilities")).withColumn("overlap", F.element_at("overlaps", F.get(names, "best")))
    sure = (F.col("p") >= F.get(cutoffs, "best")) & (F.col("overlap") >= model.overlap) & (F.col("best") != unknown)
    family = F.when(sure, F.get(names, "best")).otherwise(F.lit(UNKNOWN))
    notice = F.col("line").isNotNull() & (F.col("best") != none) & (sure | (F.col("line") == F.col("last")))
    hit = F.when(notice, F.struct("line", "last", family.alias("family"), F.round("p", 6).alias("probability"), F.round("overlap", 6).alias("overlap")))
    out = scored.select("row", "doc_id", hit.alias("hit")).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list("hit")).alias("hits"))
    inside = lambda x, r: (x["line"] >= r["line"]) & (x["last"] <= r["last"])
    own = F.filter("hits", lambda x: (x["line"] == x["last"]) & (x["family"] != UNKNOWN))
    runs = F.filter("hits", lambda r: (r["line"] < r["last"]) & ~F.exists(own, lambda x: inside(x, r) & (x["family"] == r["family"])))
    out = out.withColumn("runs", runs)
    lone = F.filter("hits", lambda x: (x["line"] == x["last"]) & ((x["family"] != UNKNOWN) | ~F.exists("runs", lambda r: inside(x, r))))
    out = out.select("doc_id", F.array_sort(F.concat(lone, "runs")).alias("licenses"))
    known = F.filter(F.transform("licenses", lambda x: x["family"]), lambda f: f != UNKNOWN)
    return out.select("doc_id", "licenses", F.array_sort(F.array_distinct(known)).alias("families"), F.size(F.filter("licenses", lambda x: x["family"] == UNKNOWN)).cast("bigint").alias("n_unknown"))
