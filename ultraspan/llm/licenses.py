"""Licence scan: a trained paragraph classifier (DataFrame functions and spark.ml only).

A paragraph (a line, by default) becomes a sparse binary vector of word 1- and 2-grams. A multinomial logistic
regression with an L1 penalty tells licence families apart from ``unknown``; a one-variable logistic regression,
fitted on held-out paragraphs, turns its margin into the calibrated probability that the paragraph is a known licence.
A known paragraph is confirmed when a template of the predicted family is contained in it to ``CONFIRM`` at least;
otherwise it is reported as ``unknown``. Other families that are likelier than ``unknown`` and confirmed are reported beside
it, but for those whose templates are like a likelier one's. A notice wrapped over several lines is found in windows: a line and the next
``SPAN`` words after it, however many lines they take.

The model is trained on variants of the templates below (words left out, corpus words around them) and on paragraphs
of a bounded sample of documents. All features contain a word of a template, however frequent it is. A paragraph without a
feature that weighs for some family more than for ``unknown`` is unknown, whatever the intercepts are. So only paragraphs with
such a feature are scored: they are found by anchors, words of which every such feature has one. Anchors come from the
fitted weights, not from frequencies. Where the held-out paragraphs can't tell (a slope that isn't positive), the log-odds
are not calibrated.

Edge cases: null and empty texts have no paragraphs; repeated documents are scanned each; an empty table gives an
empty result; other columns are ignored. Ties between families go to the first in alphabetical order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stash

#: Customary wording of licence notices, by family.
TEMPLATES = (
    ("agpl", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1 or later."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "This document is confidential and proprietary. Unauthorized copying is strictly prohibited."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
UNKNOWN = "unknown"
VARIANTS = 24
#: Documents whose paragraphs stand for ``unknown`` when the model is fitted, and most paragraphs taken from them.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 400, 4000
CONFIRM = 0.6
PARAGRAPH = r"[\r\n]+"
#: Words of the longest template, so the most that a wrapped notice has after the line it begins in.
SPAN = max(len(re.findall(r"[^\W_]+(?:\.[^\W_]+)*", t)) for _, t in TEMPLATES)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+"), lambda w: F.length(F.regexp_replace(w, r"\.", "")) > 0)


def bigrams(ws: Column) -> Column:
    return F.when(F.size(ws) > 1, F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, computing ``value`` once however often ``use`` names it (a column is pasted in at each place)."""
    return F.transform(F.array(value), use)[0]


def _trim(ws: Column) -> Column:
    """Drops full stops at the ends of words (``2.0.`` and ``2.0`` are one word)."""
    return F.transform(ws, lambda w: F.regexp_replace(w, r"\.+$", ""))


class LicenseModel:
    """What ``fit`` returns and ``scan`` needs; small: its size depends on the templates only."""

    def __init__(self, vocabulary: CountVectorizerModel, classifier: LogisticRegressionModel, families: list[str], calibration: tuple[float, float], anchors: list[str]):
        self.vocabulary, self.classifier, self.families, self.calibration, self.anchors = vocabulary, classifier, families, calibration, anchors


def _templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "family string, template string")


def _grams(col: str) -> Column:
    return _let(_trim(words(F.col(col))), lambda ws: F.concat(ws, bigrams(ws)))


def _word_pairs(text: Column) -> Column:
    return _let(_trim(words(text)), bigrams)


def _features(df: DataFrame, col: str, own: list[str]) -> DataFrame:
    held = F.array(*[F.lit(a) for a in own])
    return df.withColumn("grams", F.array_distinct(F.filter(_grams(col), lambda g: F.arrays_overlap(F.split(g, " "), held))))


def _anchors(terms: list[str], classifier: LogisticRegressionModel, at: int) -> list[str]:
    """Words of which every feature has one that weighs for some family more than for ``unknown`` (class ``at``)."""
    weights = classifier.coefficientMatrix.toArray()  # families x features of the training rows
    raising = [t for t, up in zip(terms, (weights > weights[at]).any(axis=0), strict=True) if up]
    out = {t for t in raising if " " not in t}
    for t in raising:
        if out.isdisjoint(t.split(" ")):
            out.add(max(t.split(" "), key=len))
    return sorted(out)


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_paragraphs: int = SAMPLE_PARAGRAPHS) -> LicenseModel:
    """Trains on template variants against paragraphs of ``sample_docs`` documents (chosen by hash)."""
    spark = docs.sparkSession
    templates = _templates(spark)
    # a share by hash first: without it every task would send its own sample_docs texts to one task
    share = min(1.0, 4.0 * sample_docs / max(docs.count(), 1))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull()).withColumn("h", F.xxhash64("i", "t"))
    sample = texts.filter(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < share).orderBy("h").limit(sample_docs).cache()
    paragraphs = (
        sample.select(F.posexplode(F.split("t", PARAGRAPH)).alias("n", "paragraph"))
        .filter(F.length(F.trim("paragraph")) > 0)
        .orderBy(F.xxhash64("paragraph"))
        .limit(sample_paragraphs)
        .select("paragraph")
        .cache()
    )
    own = sorted({w for _, t in TEMPLATES for w in re.findall(r"[^\W_]+(?:\.[^\W_]+)*", t.lower())})
    filler = paragraphs.filter(F.length("paragraph") < 400).agg(F.slice(F.flatten(F.collect_list(F.slice(F.split("paragraph", " "), 1, 4))), 1, 400)).collect()[0][0] or ["and"]
    extra = F.array(*[F.lit(w) for w in filler])
    ws = F.split("template", " ")
    u = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(1000))
    kept = F.filter(F.transform(ws, lambda w, i: F.when((F.col("variant") < 2) | (u("template", "variant", i) >= 120), w)), lambda w: w.isNotNull())
    around = lambda salt: F.slice(extra, (u("template", "variant", F.lit(salt)) % max(1, len(filler) - 6) + 1).cast("int"), F.when(F.col("variant") < 4, 0).otherwise(u("variant", F.lit(salt)) % 6).cast("int"))
    positive = (
        templates.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
        .select("family", F.array_join(F.concat(around("a"), kept, around("b")), " ").alias("paragraph"), (F.col("variant") % 4 == 3).alias("held"))
    )
    held = F.array(*[F.lit(a) for a in own])
    is_plain = ~F.arrays_overlap(_trim(words(F.col("paragraph"))), held)
    # the sampled paragraphs are unlabelled: those that hold a template to CONFIRM, alone or as lines of a window, take no part, and any other with
    # a template's word is a hard example of ``unknown``
    in_windows = stash(wrapped(sample, "t", "i").select(F.explode(F.split("paragraph", PARAGRAPH)).alias("paragraph")).distinct())
    negative = confirm(paragraphs.join(in_windows, "paragraph", "left_anti").withColumn("family", F.lit(None).cast("string"))).filter((F.col("similarity") < CONFIRM) | is_plain).select(F.lit(UNKNOWN).alias("family"), "paragraph", (F.pmod(F.xxhash64("paragraph"), F.lit(4)) == 3).alias("held"))
    partial = positive.select(F.lit(UNKNOWN).alias("family"), F.array_join(F.slice(F.split("paragraph", " "), 1, 2), " ").alias("paragraph"), "held")
    rows = _features(positive.unionByName(negative).unionByName(partial), "paragraph", own).cache()
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0).fit(rows.filter(~F.col("held")))
    indexer = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    ready = indexer.transform(vocabulary.transform(rows)).withColumn("weight", F.when(F.col("family") == UNKNOWN, 0.3).otherwise(1.0))
    classifier = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=2e-4, maxIter=60, weightCol="weight").fit(ready.filter(~F.col("held")))
    families = list(indexer.labels)
    out = classifier.transform(ready.filter("held")).withColumn("p", vector_to_array("probability"))
    margins = out.select(_margin(F.col("p"), families).alias("m"), (F.col("family") != UNKNOWN).cast("double").alias("label"))
    platt = LogisticRegression(regParam=1e-3, maxIter=50).fit(VectorAssembler(inputCols=["m"], outputCol="features").transform(margins))
    slope, shift = float(platt.coefficients[0]), float(platt.intercept)
    calibration = (slope, shift) if slope > 0 else (1.0, 0.0)  # held-out rows that can't tell leave the log-odds as they are
    model = LicenseModel(vocabulary, classifier, families, calibration, _anchors(vocabulary.vocabulary, classifier, families.index(UNKNOWN)))
    paragraphs.unpersist()
    sample.unpersist()
    rows.unpersist()
    return model


def _margin(p: Column, families: list[str]) -> Column:
    """Log-odds of the likeliest family against ``unknown``."""
    at = families.index(UNKNOWN)
    known = F.array_max(F.array(*[p[i] for i in range(len(families)) if i != at]))
    return F.log(F.greatest(known, F.lit(1e-12))) - F.log(F.greatest(p[at], F.lit(1e-12)))


def score(df: DataFrame, model: LicenseModel) -> DataFrame:
    """Adds ``family`` and ``probability`` (calibrated, of being a known licence) to rows with ``paragraph``, and ``p``, the
    classifier's probabilities."""
    at = model.families.index(UNKNOWN)
    scored = model.classifier.transform(model.vocabulary.transform(df.withColumn("grams", _grams("paragraph")))).withColumn("p", vector_to_array("probability"))
    a, b = model.calibration
    known = [i for i in range(len(model.families)) if i != at]
    best = F.array_max(F.array(*[F.struct(F.col("p")[i].alias("p"), F.lit(-i).alias("i")) for i in known]))
    names = F.array(*[F.lit(x) for x in model.families])
    calibrated = lambda margin: F.lit(1.0) / (F.lit(1.0) + F.exp(-(margin * a + b)))
    return (
        scored.withColumn("probability", calibrated(_margin(F.col("p"), model.families)))
        .withColumn("family", F.when(F.col("probability") >= 0.5, F.element_at(names, F.lit(1) - best["i"])).otherwise(UNKNOWN))
        .drop("grams", "features", "rawPrediction", "prediction")
    )


def _each_family(model: LicenseModel) -> Column:
    """Each family's calibrated probability against ``unknown``, from ``p``."""
    at, (a, b) = model.families.index(UNKNOWN), model.calibration
    log = lambda i: F.log(F.greatest(F.col("p")[i], F.lit(1e-12)))
    known = [i for i in range(len(model.families)) if i != at]
    return F.array(*[F.struct(F.lit(model.families[i]).alias("family"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-((log(i) - log(at)) * a + b)))).alias("probability")) for i in known])


def _template_bigrams() -> list[tuple[str, list[str]]]:
    out = []
    for family, text in TEMPLATES:
        w = [x.rstrip(".") for x in re.split(r"[^\w.]+|_", text.lower()) if x.strip(".")]
        out.append((family, [" ".join(p) for p in zip(w, w[1:], strict=False)]))
    return out


def _alike() -> dict[str, list[str]]:
    """For each family the others with a template that shares half of its bigrams, or more, with one of its own."""
    of: dict[str, list[set[str]]] = {}
    for family, grams in _template_bigrams():
        of.setdefault(family, []).append(set(grams))
    shared = lambda a, b: max(len(x & y) / min(len(x), len(y)) for x in a for y in b)
    return {f: [g for g in of if g != f and shared(of[f], of[g]) >= 0.5] for f in of}


def _shares(paragraph: Column) -> list[Column]:
    """The share of each template's bigrams that ``paragraph`` holds."""
    return [F.size(F.array_intersect(paragraph, F.array(*[F.lit(g) for g in t]))) / F.lit(float(len(set(t)))) for _, t in _template_bigrams()]


def confirm(df: DataFrame) -> DataFrame:
    """Adds ``similarity``: the largest share of a template's bigrams that the paragraph holds, over the templates of
    ``family`` (of all families, where that is null)."""
    by_family: dict[str, list[Column]] = {}
    for (family, _), share in zip(TEMPLATES, _shares(F.col("_bigrams")), strict=True):
        by_family.setdefault(family, []).append(share)
    most = {family: F.array_max(F.array(*ts)) for family, ts in by_family.items()}
    value = F.when(F.col("family").isNull(), F.array_max(F.array(*most.values())))
    for family, share in most.items():
        value = value.when(F.col("family") == family, share)
    return df.withColumn("_bigrams", _word_pairs(F.col("paragraph"))).withColumn("similarity", value.otherwise(0.0)).drop("_bigrams")


def _needed() -> list[str]:
    """Words of which every text has one that holds a template to ``CONFIRM``: in each template, long words that more
    of its bigrams have than may be missing."""
    out: set[str] = set()
    for _, t in _template_bigrams():
        grams, chosen = {tuple(g.split(" ")) for g in t}, set()
        for w in sorted({w for g in grams for w in g}, key=lambda w: (-len(w), w)):
            if sum(not chosen.isdisjoint(g) for g in grams) > (1 - CONFIRM) * len(grams) + 1e-9:
                break
            chosen.add(w)
        out |= chosen
    return sorted(out)


def _any_word(ws: list[str]) -> str:
    return r"(?i)(?<![\p{L}\p{N}.])(?:" + "|".join(re.escape(w) for w in sorted(ws, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"


def wrapped(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """id, ``paragraph_no`` of the first line, ``paragraph``: windows that hold a template to ``CONFIRM`` which no line
    at their start holds alone. Of the windows over one notice, that which begins in the notice's first line. Lines
    without a letter or digit (blank ones, comment marks) are passed over."""
    needed = _any_word(_needed())
    lines = F.filter(F.transform(F.split(F.col(text_col), PARAGRAPH), lambda p, i: F.struct(i.cast("long").alias("no"), p.alias("line"))), lambda x: x["line"].rlike(r"[\p{L}\p{N}]"))
    kept = docs.filter(F.col(text_col).rlike(needed)).select(F.col(id_col), lines.alias("_lines"))
    after = rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}.]++){{0,{SPAN}}}+"

    def line(i: Column) -> Column:  # i from 0; null outside
        return F.get("_lines", i)["line"]

    def window(i: Column) -> Column:
        rest = F.array_join(F.transform(F.slice("_lines", i + 2, SPAN), lambda x: x["line"]), "\n")
        return F.concat(line(i), F.lit("\n"), F.regexp_extract(rest, after, 0))

    def at(x: Column, i: Column) -> Column:
        texts = {"own": window(i), "before": F.when(i > 0, window(i - 1)), "next": window(i + 1), "line": x["line"], "line_after": line(i + 1)}
        row = F.struct(x["no"].alias("paragraph_no"), window(i).alias("paragraph"), *[_word_pairs(F.coalesce(c, F.lit(""))).alias(f"_{k}") for k, c in texts.items()])
        return F.when(window(i).rlike(needed), row)

    rows = kept.select(id_col, F.explode(F.filter(F.transform("_lines", at), lambda x: x.isNotNull())).alias("x")).select(id_col, "x.*")
    templates = F.array(*[F.array(*[F.lit(g) for g in dict.fromkeys(t)]) for _, t in _template_bigrams()])

    def shares(name: str) -> Column:
        return F.transform(templates, lambda t: F.size(F.array_intersect(F.col(name), t)) / F.size(t)).alias(name)

    def first(x: Column) -> Column:
        own = x["_own"]
        return (own >= CONFIRM) & (own > x["_next"]) & (own >= x["_before"]) & (x["_line"] < CONFIRM) & (x["_line_after"] < CONFIRM)

    begins = F.exists(F.arrays_zip(*[shares(k) for k in ("_own", "_before", "_next", "_line", "_line_after")]), first)
    return rows.filter(begins).select(id_col, "paragraph_no", "paragraph")


def scan(docs: DataFrame, model: LicenseModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The paragraphs and windows of lines classed as a licence: id, ``paragraph_no`` (from 0), ``family``, ``probability``, ``similarity``,
    ``confirmed``, ``paragraph``. A paragraph that names several licences is a row for each. An unconfirmed one keeps the predicted family in ``predicted`` and has ``family``
    ``unknown``."""
    anchor = _any_word(model.anchors)
    lines = F.split(F.col(text_col), PARAGRAPH)
    found = F.filter(F.transform(lines, lambda p, i: F.struct(i.cast("long").alias("paragraph_no"), F.when(p.rlike(anchor), p).alias("paragraph"))), lambda x: x["paragraph"].isNotNull())
    candidates = docs.filter(F.col(text_col).rlike(anchor)).select(F.col(id_col).alias(id_col), F.explode(found).alias("x")).select(id_col, "x.paragraph_no", "x.paragraph")
    candidates = candidates.unionByName(wrapped(docs, text_col, id_col))
    # written, as the columns that follow use its probabilities many times; only the paragraphs of licences are left
    scored = stash(score(candidates, model).filter(F.col("family") != UNKNOWN)).withColumn("_bigrams", _word_pairs(F.col("paragraph")))
    most: dict[str, list[Column]] = {}
    for (family, _), share in zip(TEMPLATES, _shares(F.col("_bigrams")), strict=True):
        most.setdefault(family, []).append(share)
    shares = F.array(*[F.struct(F.lit(f).alias("family"), F.array_max(F.array(*ts)).alias("similarity")) for f, ts in most.items()])
    joined = F.transform("families", lambda x: F.struct(x["family"].alias("family"), x["probability"].alias("probability"), F.coalesce(F.filter("_shares", lambda y: y["family"] == x["family"])[0]["similarity"], F.lit(0.0)).alias("similarity")))
    # every family that its template confirms and its own probability passes; else the likeliest one, unconfirmed
    passed = F.filter("_all", lambda x: (x["similarity"] >= CONFIRM) & ((x["probability"] >= 0.5) | (x["family"] == F.col("family"))))
    # of families with like templates the likeliest: a notice of one nearly holds the other's template, too
    alike = F.create_map(*[x for f, others in _alike().items() for x in (F.lit(f), F.array(*map(F.lit, others)).cast("array<string>"))])
    before = lambda y, x: (y["probability"] > x["probability"]) | ((y["probability"] == x["probability"]) & (y["family"] < x["family"]))
    passed = F.filter(passed, lambda x: ~F.exists(passed, lambda y: F.array_contains(alike[x["family"]], y["family"]) & before(y, x)))
    likeliest = F.filter("_all", lambda x: x["family"] == F.col("family"))
    shared = stash(scored.select(id_col, "paragraph_no", "paragraph", "family", _each_family(model).alias("families"), shares.alias("_shares")))
    rows = stash(shared.select(id_col, "paragraph_no", "paragraph", "family", joined.alias("_all"))).select(id_col, "paragraph_no", "paragraph", F.explode(F.when(F.size(passed) > 0, passed).otherwise(likeliest)).alias("f"))
    confirmed = F.col("f.similarity") >= CONFIRM
    return rows.select(id_col, "paragraph_no", F.when(confirmed, F.col("f.family")).otherwise(UNKNOWN).alias("family"), F.col("f.family").alias("predicted"), F.col("f.probability").alias("probability"), F.col("f.similarity").alias("similarity"), confirmed.alias("confirmed"), "paragraph")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scan(docs, fit(docs)).select("doc_id", "paragraph_no", "family", "predicted", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), "confirmed")
