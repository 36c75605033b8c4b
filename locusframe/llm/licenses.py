"""Licence texts in documents: MinHash bands over overlapping windows, then exact containment.

Words as in decontamination; five-word shingles as 64-bit hashes. For templates of c words,
windows of 2c words are taken every c words, so that one of them holds any stretch of c words
whole. A window that has `PERCENT` of a template's shingles has a Jaccard similarity of 1/6 or
more to it (least at five words: one shingle of six); of `BANDS` bands of one minimum each, at
least one then agrees with probability 1 - (5/6)**64 > 0.99999. A template retrieved by a band is
a match where the window really holds that share of its shingles. Windows without any shingle of a template
cannot agree in a band and are left out before the bands are worked out. All built-in functions.

Nulls and ties: a null text has no words. Rows that repeat (doc_id, text) share their findings
and are each returned; a null doc_id is a document like others. Templates of equal text are both
reported; those of fewer than five words have no shingle and never match. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import small
from locusframe.llm.decontaminate import words_of
from locusframe.session import materialise

BANDS = 64
PERCENT = 75
SHINGLE = 5
BROADCAST_ROWS = 500_000

# Customary licence notices and headers.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def shingles(hashes: Column) -> Column:
    """Hash of each five-word shingle, in order, of the words' hashes."""
    n = F.greatest(F.size(hashes) - (SHINGLE - 1), F.lit(0))
    first, *others = [F.slice(hashes, i + 1, n) for i in range(SHINGLE)]
    for following in others:
        first = F.zip_with(first, following, lambda a, b: F.xxhash64(a, b))
    return first


def hashed(text: Column) -> Column:
    """Hash of each word, in order."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _shingled(docs: DataFrame) -> DataFrame:
    """(doc_id, h, s). Hashes are a column of their own, so that they are worked out once for all uses."""
    return docs.select("doc_id", F.xxhash64("text", F.lit(10)).alias("h"), hashed(F.col("text")).alias("words")).select("doc_id", "h", shingles(F.col("words")).alias("s"))


def prepared(templates: DataFrame) -> DataFrame:
    """(template, license, width, shingles) of templates (license, text) that have a shingle."""
    rows = templates.select("license", words_of(F.col("text")).alias("w")).where(f"size(w) >= {SHINGLE}")
    width = F.size("w")
    return rows.select(
        F.xxhash64("license", "w").alias("template"), "license", width.alias("width"), F.array_distinct(shingles(F.transform("w", lambda w: F.xxhash64(w)))).alias("shingles")
    ).distinct()


def bands(found: Column) -> Column:
    """One minimum per band, as (band, least)."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)),
        lambda b: F.struct(b.alias("band"), F.array_min(F.transform(found, lambda h: F.xxhash64(h, b))).alias("least")),
    )


def _held(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, h, width, at): windows, by number, with a shingle of a template of that width.

    Outer explodes keep the optimiser from working the shingles out once more to test for empty ones.
    """
    theirs = known.select("width", F.explode("shingles").alias("x")).distinct()
    found = _shingled(docs).select("doc_id", "h", F.posexplode_outer("s").alias("pos", "x"))
    met = found.join(small(theirs, BROADCAST_ROWS), "x")
    last = F.floor(F.col("pos") / F.col("width")).cast("int")
    before = F.when((F.col("pos") >= F.col("width")) & (F.col("pos") % F.col("width") + SHINGLE <= F.col("width")), last - 1)
    return met.select("doc_id", "h", "width", F.explode(F.array(last, before)).alias("at")).where("at IS NOT NULL").distinct()


def matches(docs: DataFrame, templates: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, h, license, template, word, shared, size): windows that hold a template.

    Shingles are worked out once for all texts, and again only for texts that share one with a template.
    """
    known = materialise(prepared(templates))
    held = materialise(_held(docs, known))
    texts = docs.select("doc_id", F.xxhash64("text", F.lit(10)).alias("h"), "text")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h"))
    asked = small(held.select("doc_id", "h").distinct(), BROADCAST_ROWS)
    split = materialise(texts.alias("a").join(asked.alias("b"), same, "left_semi").select("doc_id", "text").transform(_shingled))
    window = F.slice("s", F.col("at") * F.col("width") + 1, 2 * F.col("width") - (SHINGLE - 1))
    hit = split.alias("a").join(held.alias("b"), same).select("a.doc_id", "a.h", "width", (F.col("at") * F.col("width")).alias("word"), F.array_distinct(window).alias("w"))
    banded = hit.withColumn("b", F.explode(bands(F.col("w")))).select("*", "b.band", "b.least").drop("b")
    keys = known.withColumn("b", F.explode(bands(F.col("shingles")))).select("template", "license", "width", "shingles", "b.band", "b.least")
    met = banded.join(small(keys, BROADCAST_ROWS), ["width", "band", "least"])
    shared = F.size(F.array_intersect("w", "shingles"))
    good = met.withColumn("shared", shared).where(F.col("shared") * 100 >= F.size("shingles") * percent)
    return good.select("doc_id", "h", "license", "template", "word", "shared", F.size("shingles").alias("size")).distinct()


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, licenses (sorted, comma-joined) and the best share of a template held; one row per row of docs."""
    spark = docs.sparkSession
    if templates is None:
        templates = spark.createDataFrame(TEMPLATES, "license string, text string")
    found = matches(docs, templates)
    per = found.groupBy("doc_id", "h").agg(
        F.array_sort(F.collect_set("license")).alias("found"), F.max(F.floor(F.col("shared") * 100 / F.col("size"))).alias("best"),
        F.count_distinct("template").alias("n_templates"),
    )
    per = small(materialise(per), BROADCAST_ROWS)
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h"))
    rows = docs.select("doc_id", F.xxhash64("text", F.lit(10)).alias("h"))
    return rows.alias("a").join(per.alias("b"), same, "left").select(
        "a.doc_id", F.coalesce(F.array_join("b.found", ","), F.lit("")).alias("licenses"),
        F.coalesce("b.n_templates", F.lit(0)).cast("long").alias("n_templates"), F.coalesce("b.best", F.lit(0)).cast("long").alias("best_percent"),
    )
