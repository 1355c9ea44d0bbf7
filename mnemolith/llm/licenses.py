"""Operator 8: license scans, in DataFrame functions only.

Overlapping windows of words carry MinHash values; a window that agrees with a template in one of the bands is a
candidate, and exact containment of the template's five-word shingles in the window decides; templates of fewer words have
one shingle, of all their words. Windows come in sizes that double, up to that of the longest template: templates of at most L
words are looked for in windows of 3 L / 2 words that start every L / 2, so each occurrence lies in one of them whole. The least
Jaccard similarity of such a window and a template contained to 0.8 is 1/8, and 64 bands of one value meet there with
probability 1 - (7/8)^64 = 0.9998.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64
LEAST_SIZE = 8
#: Templates are literals in the plan; a scan looks for so many of their shingles at a time, and for the next ones in another pass.
PART = 4_096
#: Notices of public licenses, in their own words.
TEMPLATES = {
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-header": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def scan_words(text: Column) -> Column:
    """Runs of letters and digits of a text, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(hashes: Column, k: int = SHINGLE) -> Column:
    """A 64-bit hash for each run of k words, from the words' hashes."""
    some = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: F.xxhash64(F.slice(h, i, k))))
    return F.when(F.size(hashes) < k, F.array().cast("array<bigint>")).otherwise(some)


def min_hashes(hashes: Column, bands: int = BANDS) -> Column:
    return let(hashes, lambda x: F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda s: F.array_min(F.transform(x, lambda h: F.xxhash64(h, s)))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, int, int, list[int]]]:
    """(license, words of a shingle, size, shingles) of each template that has words."""
    if not templates:
        return []
    df = spark.createDataFrame(list(templates.items()), "license string, text string")
    rows = df.select("license", F.transform(scan_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") > 0)
    own = reduce(lambda a, k: a.when(F.size("h") == k, shingles(F.col("h"), k)), range(1, SHINGLE), F)
    rows = rows.select("license", F.size("h").alias("n"), F.array_distinct(own.otherwise(shingles(F.col("h")))).alias("s")).collect()
    return [(r.license, min(r.n, SHINGLE), max(LEAST_SIZE, 1 << (r.n - 1).bit_length()), r.s) for r in rows]


def _literal(values) -> Column:
    return F.from_json(F.lit(json.dumps(sorted(values))), "array<bigint>")


def _scan(docs: DataFrame, known: list, id_col: str, text_col: str, containment: float) -> DataFrame:
    """(id, license, c, at): windows that contain one of the known templates to the given share. Texts are read once, for shingles of all lengths that the templates have."""
    table = docs.sparkSession.createDataFrame(known, "license string, k int, size int, t array<bigint>")
    bands = table.select("license", "k", "size", "t", F.posexplode(min_hashes(F.col("t"))).alias("band", "value"))
    lengths = sorted({k for _, k, _, _ in known})
    every = {k: _literal({x for _, own, _, s in known if own == k for x in s}) for k in lengths}
    hashed = docs.select(F.col(id_col).alias("_id"), F.transform(scan_words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("_h"))
    rows = hashed.select("_id", *[shingles(F.col("_h"), k).alias(f"_s{k}") for k in lengths])
    found = {k: F.arrays_overlap(f"_s{k}", every[k]) for k in lengths}
    rows = rows.where(reduce(Column.__or__, found.values()))

    def windows(k: int) -> Column:
        own = F.col(f"_s{k}")

        def starts(size: int) -> Column:
            step, most = size // 2, 3 * size // 2 - k + 1
            return F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / step).cast("int")), lambda i: F.struct(F.lit(size).alias("size"), (i * step).alias("at"), F.lit(most).alias("n")))

        cut = lambda w: F.struct(F.lit(k).alias("k"), w["size"].alias("size"), w["at"].alias("at"), F.array_distinct(F.slice(own, w["at"] + 1, w["n"])).alias("s"))
        some = F.filter(F.transform(F.concat(*[starts(size) for size in sorted({x[2] for x in known if x[1] == k})]), cut), lambda w: F.arrays_overlap(w["s"], every[k]))
        return F.when(found[k], some).otherwise(F.array().cast("array<struct<k:int,size:int,at:int,s:array<bigint>>>"))

    # windows are made in one array: exploded first, each would carry the shingles of the whole text
    each = rows.select("_id", F.explode(F.concat(*[windows(k) for k in lengths])).alias("_w")).select("_id", "_w.k", "_w.size", "_w.at", F.col("_w.s").alias("_s"))
    marked = each.select("_id", "k", "size", "at", "_s", F.posexplode(min_hashes(F.col("_s"))).alias("band", "value"))
    # templates of a pass are of bounded number, so their bands can be broadcast
    meet = marked.join(F.broadcast(bands), ["k", "size", "band", "value"]).dropDuplicates(["_id", "at", "license", "_s"])
    share = F.size(F.array_intersect("_s", "t")) / F.size("t")
    return meet.select("_id", "license", share.alias("c"), "at").where(F.col("c") >= containment)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(id, license, containment, first_word): one row for each template that a document contains to the given share.

    Templates may have any number of words, and there may be any number of them; one without words is found nowhere. containment:
    the greatest share of the template's distinct shingles in one window; first_word: where the first window that reaches
    the threshold begins, in words from 0. Null, empty and short texts match nothing, an empty table gives an empty result; rows
    that share an id give one row; whole texts of any length are scanned, and only id and text are read. A text without any
    shingle of any template can match none, so only others are cut into windows; nothing of the text is shuffled.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    passes, size = [], 0
    for x in template_table(spark, templates):
        if not passes or size + len(x[3]) > PART:
            passes.append([])
            size = 0
        passes[-1].append(x)
        size += len(x[3])
    if not passes:
        return spark.createDataFrame([], f"{id_col} {kind}, license string, containment double, first_word bigint")
    found = reduce(DataFrame.unionByName, [_scan(docs, known, id_col, text_col, containment) for known in passes])
    return found.groupBy(F.col("_id").alias(id_col), "license").agg(F.max("c").alias("containment"), F.min("at").cast("long").alias("first_word"))
