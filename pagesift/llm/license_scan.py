"""License scan: a trained paragraph classifier, confirmed by templates.

Paragraphs are the non-blank lines of a text and, for notices that are wrapped over
several lines, runs of consecutive short lines. Word one- and two-grams, hashed to a
sparse vector, go to an L1-regularized logistic regression whose classes are the
licence families and ``unknown``. It is trained on the notices below, on versions
of them with words missing or added, and on a bounded sample of corpus paragraphs as
``unknown``, as are notices of licences that are no family here. A temperature fitted
on held-out templates and paragraphs calibrates its probabilities; below
``MIN_PROBABILITY`` a line counts as unknown. A prediction is confirmed if enough of
some template of that family is found in the paragraph, and enough of what only this
family's templates say. Of runs only confirmed ones are reported.
DataFrame and Spark ML functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import broadcast_if_small, let, lower_ascii, prepare, table, written

FEATURES = 1 << 13
# corpus paragraphs taken as examples of "unknown": a documented bound, the only
# sample here; they are the smallest by hash over all lines of all documents
MAX_BACKGROUND = 1500
MIN_PROBABILITY = 0.5
MIN_COVER = 0.6  # share of a template's words (runs of two) found in the paragraph
MIN_OWN = 0.5  # the same share of the words that only this family's templates have
# a run: this many lines at most, none longer than this
RUN_LINES, RUN_CHARS = 24, 120
UNKNOWN = "unknown"

# short notices of common licences (fixed values: the licences' own wording)
TEMPLATES = {
    "mit": ["Released under the MIT License.",
            "Licensed under the MIT License.",
            "This project is licensed under the terms of the MIT license.",
            "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "Released under the Apache 2.0 license.",
               "SPDX-License-Identifier: Apache-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "Released under the GNU GPL v2 or later.",
            "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
             "SPDX-License-Identifier: LGPL-2.1-only"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.",
             "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": ["Released under the BSD 3-Clause License.",
            "Licensed under the BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Licensed under the Mozilla Public License 2.0.",
            "SPDX-License-Identifier: MPL-2.0"],
    "cc": ["Licensed under CC BY-NC 4.0.",
           "Licensed under CC BY 4.0.",
           "Licensed under CC BY-SA 4.0.",
           "This work is licensed under a Creative Commons Attribution 4.0 International License.",
           "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "public-domain": ["This work is in the public domain.",
                      "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
                      "This is free and unencumbered software released into the public domain."],
    "proprietary": ["Copyright. All rights reserved.",
                    "No part of this publication may be reproduced without the prior written permission of the publisher."],
}
FAMILIES = [UNKNOWN, *TEMPLATES]
# notices of other licences, examples of "unknown" (fixed values: the licences' names)
OTHER = ["Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0",
         "Released under the PostgreSQL License.", "PostgreSQL License", "Licensed under the zlib License.", "zlib License",
         "SPDX-License-Identifier: Zlib", "Released under the terms of the WTFPL license.", "Licensed under the ISC License.",
         "SPDX-License-Identifier: ISC", "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0",
         "Licensed under the European Union Public Licence 1.2.", "SPDX-License-Identifier: EUPL-1.2",
         "Licensed under the Artistic License 2.0.", "Licensed under the Common Development and Distribution License 1.0.",
         "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the Python Software Foundation License.",
         "Licensed under the Microsoft Public License.", "Released under the Open Software License 3.0.",
         "Made available under the Open Database License."]


def _grams(text: str) -> list[str]:
    """Distinct words and two-word runs of a notice, as ``license_words`` has them."""
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return list(dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]))


_GRAMS = {f: [_grams(t) for t in ts] for f, ts in TEMPLATES.items()}
# what only one family's templates say, and no other licence's notice
OWN = {f: {x for g in gs for x in g} - {x for h, other in _GRAMS.items() if h != f for g in other for x in g}
       - {x for t in OTHER for x in _grams(t)} for f, gs in _GRAMS.items()}
OWN_WORDS = sorted({x for own in OWN.values() for x in own if " " not in x})


def license_words(c: Column | str) -> Column:
    """Lower-case runs of letters, digits, dots inside numbers aside."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(lower_ascii(c), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def bigrams(w: Column) -> Column:
    return let(w, lambda a: F.when(F.size(a) >= 2, F.transform(
        F.sequence(F.lit(0), F.size(a) - 2), lambda i: F.concat(F.get(a, i), F.lit(" "), F.get(a, i + 1)))).otherwise(
        F.array().cast("array<string>")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line, text, w): every line with a word of every text."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(
        x.alias("text"), license_words(x).alias("w")))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"),
                        F.posexplode(lines).alias("line", "l"))
            .select("doc_id", "th", "line", "l.text", "l.w").filter(F.size("w") > 0))


def with_features(rows: DataFrame) -> DataFrame:
    grams = rows.withColumn("grams", F.concat("w", bigrams(F.col("w"))))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(grams)


def template_table(spark: SparkSession) -> DataFrame:
    rows = [(f, i, t, sorted(OWN[f])) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    t = spark.createDataFrame(rows, "family string, k int, text string, own array<string>")
    return t.withColumn("w", license_words("text"))


def training_rows(docs: DataFrame) -> DataFrame:
    """(family, w, fold): templates with words left out or put round them, and the
    background. Every fifth template and paragraph is held out for calibration."""
    spark = docs.sparkSession
    t = template_table(spark)
    noise = [None, "file notice", "see the", "all of the content on this site", "2019 2021 by the authors"]
    versions = F.flatten(F.transform(F.array(*[F.lit(x) for x in noise]), lambda n: F.transform(
        F.sequence(F.lit(-1), F.least(F.size("w"), F.lit(12)) - 1),
        lambda k: F.concat(F.coalesce(F.split(n, " "), F.array().cast("array<string>")),
                           F.filter("w", lambda x, i: i != k)))))
    own = t.select("family", "k", "own", F.explode(versions).alias("w"), F.col("family").alias("src"))
    # without any word of its own a version is no notice of the family
    own = own.withColumn("family", F.when(F.arrays_overlap(F.concat("w", bigrams(F.col("w"))), "own"), F.col("family"))
                         .otherwise(UNKNOWN)).select("family", "k", "w", "src")
    others = spark.createDataFrame([(UNKNOWN, -1 - k, x) for k, x in enumerate(OTHER)], "family string, k int, text string")
    others = others.withColumn("w", license_words("text")).select(
        "family", "k", F.explode(versions).alias("w"), F.lit(UNKNOWN).alias("src"))
    known = own.unionByName(others)
    # corpus paragraphs that share no two-word run "licensed under", "the ... license"
    hints = r"(?i)licen[sc]|copyright|public domain|spdx|all rights|free software|redistribut|hereby granted"
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("text")).filter(
        F.col("text").rlike(r"[\p{L}\p{N}]") & ~F.col("text").rlike(hints)).withColumn("h", F.xxhash64("text"))
    # distinct ones, in one pass: a line that many documents repeat counts once. Words are
    # taken of the chosen lines only
    back = (lines.dropDuplicates(["h"]).orderBy("h").limit(MAX_BACKGROUND)
            .select(F.lit(UNKNOWN).alias("family"), F.pmod("h", F.lit(1 << 30)).cast("int").alias("k"), license_words("text").alias("w"),
                    F.lit("corpus").alias("src")))
    mixed = own.filter(F.pmod(F.xxhash64("w"), F.lit(7)) == 0).select(
        F.lit(UNKNOWN).alias("family"), "k", F.filter("w", lambda x, i: i % 3 == 0).alias("w"), "src")
    rows = written(known.unionByName(back).unionByName(mixed).filter(F.size("w") > 0), "license-training")
    label = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")).cast("double") - 1
    # all versions of a template share its fold
    return with_features(rows.withColumn("label", label).withColumn("fold", F.pmod(F.xxhash64("src", "k"), F.lit(5))).drop("src"))


def _nll(rows: DataFrame, ts: list[float]):
    """Mean negative log likelihood at each temperature (``raw``: array of logits)."""
    def at(t):
        scaled = F.transform("raw", lambda x: F.exp(F.greatest(F.lit(-40.0), (x - F.array_max("raw")) / t)))
        return -F.avg(F.log(F.get(scaled, F.col("label").cast("int")) / F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x)))
    return rows.agg(*[at(t).alias(str(i)) for i, t in enumerate(ts)]).first()


def train(docs: DataFrame):
    """(model, temperature) from the templates and the background of ``docs``."""
    rows = training_rows(docs).select("family", "label", "features", "fold").coalesce(2).persist()
    lr = LogisticRegression(maxIter=40, regParam=0.002, elasticNetParam=0.5, family="multinomial", standardization=False)
    held = lr.fit(rows.filter("fold > 0")).transform(rows.filter("fold = 0")).withColumn("raw", vector_to_array("rawPrediction"))
    ts = [0.25 * 1.25 ** k for k in range(16)]
    nll = _nll(held, ts)
    model = lr.fit(rows)  # all templates, at the temperature found without some
    rows.unpersist()
    scored = [(math.inf if x is None else x, t) for x, t in zip(nll, ts)]
    return model, min(scored)[1]


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line, n_lines, text, w): runs of 2 to ``RUN_LINES`` consecutive
    non-blank lines of at most ``RUN_CHARS`` characters that hold a word which only one
    family's templates have; others cannot be confirmed. ``line`` is the first one's; of
    equal runs of a text the first counts."""
    one = rf"[ \t]*[^\s][^\n]{{0,{RUN_CHARS - 1}}}"
    found = F.array_distinct(F.regexp_extract_all(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")),
                                                  F.lit(rf"(?m)^(?:{one}\n){{2,{RUN_LINES}}}"), 0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"),
                       F.col("text").alias("whole"), F.explode(found).alias("text"))
    rows = rows.withColumn("w", license_words("text")).filter(F.arrays_overlap("w", F.array(*[F.lit(x) for x in OWN_WORDS])))
    before = F.expr("substring(concat(whole, '\n'), 1, instr(concat('\n', whole, '\n'), concat('\n', text)) - 1)")
    count = lambda c: (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))).cast("int")
    return rows.select("doc_id", "th", count(before).alias("line"), count(F.col("text")).alias("n_lines"),
                       F.regexp_replace("text", "\n$", "").alias("text"), "w")


def scan(docs: DataFrame, fitted=None) -> DataFrame:
    """One row per line that is predicted to be a licence notice, and per confirmed run
    of lines: doc_id, th (hash of the text), line (0-based), n_lines, text, family,
    probability, cover, confirmed.

    Null and empty texts have no paragraphs; repeated rows come back as often as
    they came; null ids pass through; an empty table gives no rows; other columns
    are ignored. ``cover`` is the best share of a template of the family. A line longer
    than ``RUN_CHARS`` ends a run; a run of more than ``RUN_LINES`` lines is cut there."""
    spark = docs.sparkSession
    model, temperature = fitted or train(docs)
    lines = paragraphs(docs).withColumn("n_lines", F.lit(1)).unionByName(runs(docs))
    rows = with_features(lines).select("doc_id", "th", "line", "n_lines", "text", "w", "features")

    def softmax(raw):
        return let(F.array_max(raw), lambda top: F.transform(
            raw, lambda x: F.exp(F.greatest(F.lit(-60.0), (x - top) / temperature))))

    def decide(p):
        # a run holds other text too: there the likeliest family is tried
        known = F.array_max(F.slice(p, 2, len(FAMILIES) - 1))
        top = F.when(F.col("n_lines") > 1, known).otherwise(F.array_max(p))
        best = F.when((F.col("n_lines") == 1) & (F.get(p, F.lit(0)) == top), 0).otherwise(
            F.array_position(F.slice(p, 2, len(FAMILIES) - 1), top).cast("int"))
        return F.struct(F.get(F.array(*[F.lit(f) for f in FAMILIES]), best).alias("family"),
                        (top / F.aggregate(p, F.lit(0.0), lambda a, x: a + x)).alias("probability"))

    verdict = let(let(vector_to_array("rawPrediction"), softmax), decide)
    # exploding the verdict filters rows without computing the verdict twice
    found = F.filter(F.array(verdict), lambda v: (v["family"] != UNKNOWN) & (
        (v["probability"] >= MIN_PROBABILITY) | (F.col("n_lines") > 1)))
    probs = (model.transform(rows).select("doc_id", "th", "line", "n_lines", "text", "w", F.explode(found).alias("v"))
             .select("doc_id", "th", "line", "n_lines", "text", F.concat("w", bigrams(F.col("w"))).alias("grams"), "v.*"))
    t = spark.createDataFrame([(f, [(g, [x for x in g if x in OWN[f]]) for g in gs]) for f, gs in _GRAMS.items()],
                              "family string, templates array<struct<g:array<string>,own:array<string>>>")
    share = lambda g: F.when(F.size(g) > 0, F.size(F.array_intersect(g, F.col("grams"))) / F.size(g)).otherwise(1.0)
    scored = F.transform("templates", lambda x: F.struct(share(x.g).alias("cover"), share(x.own).alias("own")))
    fits = F.exists("scored", lambda x: (x.cover >= MIN_COVER) & (x.own >= MIN_OWN))
    return (probs.join(broadcast_if_small(t, len(FAMILIES)), "family").withColumn("scored", scored)  # the notices above
            .withColumn("cover", F.array_max("scored.cover")).withColumn("confirmed", fits)
            .filter(F.col("confirmed") | (F.col("n_lines") == 1))
            .select("doc_id", "th", "line", "n_lines", "text", "family", F.round("probability", 6).alias("probability"),
                    F.round("cover", 6).alias("cover"), "confirmed"))


def op6_license_scan(spark, sf_dir):
    """Licence notices in all documents."""
    prepare(spark)
    return scan(table(spark, sf_dir, "documents")).drop("th")
