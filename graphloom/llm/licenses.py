"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

A template of m shingles is looked for in windows of 2m shingles at every m: a contiguous
occurrence lies whole in one of them. Such a window has a Jaccard similarity of 0.36 or more with
a template of which it contains four fifths, so with BANDS one-row bands the chance that none
collides is at most 0.64 ** 32, under one in a million. Only windows with at least one template
shingle get signatures (others cannot collide). Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.decontaminate import words_of
from graphloom.session import checked_broadcast, cut

WIDTH = 5
BANDS = 32
CONTAINMENT = 0.8
#: Template shingles looked up per pass over the texts; more take more passes.
SHINGLES_PER_PASS = 20_000

#: License notices as they stand in texts: fixed values.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "All rights reserved."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2."),
    ("LGPL-2.1", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License, version 2.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
]


def _shingles(words: Column, width: Column) -> Column:
    """Hashes of all runs of ``width`` words."""
    n = F.size(words) - width + 1
    none = F.array().cast("array<bigint>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(none)


def _signature(shingles: Column) -> Column:
    """(band, least hash) for every band."""
    bands = F.sequence(F.lit(0), F.lit(BANDS - 1))
    return F.transform(bands, lambda j: F.struct(j.alias("band"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, j))).alias("least")))


def prepared(templates: DataFrame, *, license_id: str = "license", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Templates as (template, license, w, m, t): shingle width, number of shingles, distinct shingle hashes.

    Templates of fewer than ``width`` words are one shingle of their own length; those without
    words are left out; equal texts under one license are one template.
    """
    words = templates.select(F.col(license_id).cast("string").alias("license"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0).distinct()
    w = F.least(F.size("words"), F.lit(width))
    return words.select(F.xxhash64("license", "words").alias("template"), "license", w.alias("w"), (F.size("words") - w + 1).alias("m"), F.array_distinct(_shingles(F.col("words"), w)).alias("t"))


def scan_licenses(docs: DataFrame, templates: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document row: doc_id and found, sorted (license, first_word, containment), one per license.

    first_word is the 1-based word at which the best window starts (the first of equally good
    ones). Null and empty texts and texts without words have nothing found; rows without an id
    and repeated rows are scanned like others; other columns are not read. Without templates
    nothing is found. Documents are keyed by a 128-bit hash of their text.
    """
    known = cut(prepared(templates, width=width), "templates")
    shapes = [(r["w"], r["m"]) for r in known.select("w", "m").distinct().orderBy("w", "m").collect()]
    rare = [(r["w"], r["s"]) for r in known.select("w", F.explode("t").alias("s")).distinct().orderBy("w", "s").collect()]
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2")]
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = src.select("doc_id", *key)
    split = src.select(*key, words_of(F.col("text")).alias("x"))

    def windows(hits: Column, w: int) -> Column:
        """Windows of every template size that hold a hit."""

        def one(m: int) -> Column:
            at = F.array_distinct(F.flatten(F.transform(hits, lambda p: F.array(F.floor((p - 1) / m).cast("int"), F.floor((p - 1) / m).cast("int") - 1))))
            return F.transform(
                F.filter(at, lambda k: k >= 0),
                lambda k: F.struct(F.lit(w).alias("w"), F.lit(m).alias("m"), (k * m + 1).alias("first"), F.slice("x", k * m + 1, F.lit(2 * m + w - 1)).alias("words")),
            )

        return F.concat(*[one(m) for v, m in shapes if v == w])

    found = None
    for w in sorted({v for v, _ in shapes}):
        own = [s for v, s in rare if v == w]
        for i in range(0, len(own), SHINGLES_PER_PASS):
            listed = ", ".join(f"{s}L" for s in own[i : i + SHINGLES_PER_PASS]).replace("-9223372036854775808L", "(-9223372036854775807L - 1L)")
            hits = F.expr(f"filter(IF(size(x) >= {w}, sequence(1, size(x) - {w - 1}), CAST(array() AS array<int>)), i -> xxhash64(slice(x, i, {w})) IN ({listed}))")
            part = split.select("k1", "k2", F.explode(F.flatten(F.transform(F.array(hits), lambda h: windows(h, w)))).alias("v"))  # noqa: B023
            found = part if found is None else found.union(part)
    if found is None:
        return base.select("doc_id", F.array().cast("array<struct<license:string,first_word:int,containment:double>>").alias("found"))
    texts = found.select("k1", "k2", "v.*").distinct()
    signed = cut(texts.select("k1", "k2", "w", "m", "first", F.array_distinct(_shingles(F.col("words"), F.col("w"))).alias("s")), "windows")

    # retrieve by any equal band, then verify by exact containment
    asked = known.select("template", "license", "w", "m", "t", F.explode(_signature(F.col("t"))).alias("b")).select("template", "license", "w", "m", "t", "b.*")
    held = signed.select("k1", "k2", "w", "m", "first", "s", F.explode(_signature(F.col("s"))).alias("b")).select("k1", "k2", "w", "m", "first", "s", "b.*")
    share = F.size(F.array_intersect("s", "t")) / F.size("t")
    met = held.join(checked_broadcast(asked, 50_000), ["w", "m", "band", "least"]).select("k1", "k2", "license", "first", share.alias("containment")).where(F.col("containment") >= containment).distinct()
    best = met.groupBy("k1", "k2", "license").agg(F.max_by(F.struct("first", "containment"), F.struct("containment", -F.col("first"))).alias("x"))
    lists = best.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("license", F.col("x.first").alias("first_word"), F.col("x.containment").alias("containment")))).alias("found"))
    none = F.array().cast("array<struct<license:string,first_word:int,containment:double>>")
    return base.join(lists, ["k1", "k2"], "left").select("doc_id", F.coalesce("found", none).alias("found"))
