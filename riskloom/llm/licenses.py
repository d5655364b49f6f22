"""License scans by MinHash bands over overlapping text windows.  DataFrame functions only.

Words are ``[a-z0-9]+`` of the lower-cased text, shingles GRAM consecutive words.  A text is cut into windows of WINDOW words,
one every STRIDE, so that every stretch of up to WINDOW - STRIDE + 1 words, and so every template, lies within one of them.
A window and a template collide if they agree in one of BANDS minima of one hash each: a template of the least length,
whole in a window, has similarity 4/23 or more to it and is missed with probability (19/23)**BANDS < 2e-5.  A collision counts
once the template's shingles are contained in the window's to CONTAINMENT or more, which is worked out exactly, and all of
its shingles with a number are: a text with another version is another license's.

Minima are only worked out for windows in which at least NEED positions hold a shingle of some template.  No other
window can pass the containment test, as every template needs that many; nothing is lost by it.

Defined results: null and empty texts match nothing; rows of equal ids count as one document; a null id is reported as null;
other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

GRAM, WINDOW, STRIDE, BANDS, CONTAINMENT = 2, 24, 8, 60, 0.75
# Usual wordings of license notices, one short sentence each.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License, version 2.1"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose"),
)


def _let(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _shingles(words: Column) -> Column:
    return F.when(F.size(words) >= GRAM, F.transform(F.sequence(F.lit(0), F.size(words) - GRAM), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(GRAM)]))).otherwise(F.array().cast("array<bigint>"))


def shingles(text: Column) -> Column:
    """Hashes of a text's shingles, in order."""
    return _let(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), ""), _shingles)


def versions(text: Column) -> Column:
    """Hashes of the shingles that hold a word with a digit: those that tell a license's versions apart."""
    words = F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")
    told = _let(words, lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.array_join(F.slice(w, i + 1, GRAM), " ").rlike("[0-9]")))
    return F.array_distinct(F.transform(told, lambda i: F.get(shingles(text), i)))


def minima(hashes: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda band: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band))))


def catalogue(spark: SparkSession, templates: tuple = TEMPLATES) -> tuple[DataFrame, list[int], int]:
    """(template, license, own, must, band, least), BANDS rows a template; all shingles; the least number that a match needs."""
    for _, t in templates:
        size = len(re.findall("[a-z0-9]+", t.lower()))
        if not 5 <= size <= WINDOW - STRIDE + 1:
            raise ValueError(f"a template has 5 to {WINDOW - STRIDE + 1} words, not {size}: {t}")
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), F.lit(t).alias("text")) for k, (name, t) in enumerate(templates)])))
    rows = rows.withColumn("own", F.array_distinct(shingles(F.col("text")))).withColumn("must", versions(F.col("text")))
    known = rows.select("own").collect()  # the catalogue is a parameter, not data
    bands = rows.select("template", "license", "own", "must", F.posexplode(minima(F.col("own"))).alias("band", "least"))
    return bands, sorted({h for r in known for h in r["own"]}), min(math.ceil(CONTAINMENT * len(r["own"])) for r in known)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """(id, license, containment, first_word, windows): a row for each license of each document that has one."""
    bands, known, need = catalogue(docs.sparkSession, templates)
    span = WINDOW - GRAM + 1
    inside = lambda h: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.get(h, i).isin(known))
    cover = lambda p: F.sequence(F.greatest(F.lit(0), F.floor((p - span + STRIDE) / STRIDE)).cast("int"), F.floor(p / STRIDE).cast("int"))
    often = lambda s: F.array_distinct(F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - need), lambda i: F.when(F.get(s, i) == F.get(s, i + need - 1), F.get(s, i))), lambda x: x.isNotNull()))
    none = F.array().cast("array<int>")
    windows = lambda h: _let(F.sort_array(F.flatten(F.transform(inside(h), cover))), lambda s: F.when(F.size(s) >= need, often(s)).otherwise(none))
    pieces = lambda h: F.when(F.size(h) >= need, F.transform(windows(h), lambda j: F.struct(j.alias("at"), F.slice(h, j * STRIDE + 1, F.lit(span)).alias("own")))).otherwise(F.array().cast("array<struct<at:int,own:array<bigint>>>"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.explode(_let(shingles(F.col(text_col)), pieces)).alias("w"))
    seen = rows.select("id", (F.col("w.at") * STRIDE).alias("word"), F.col("w.own").alias("held"), F.posexplode(minima(F.col("w.own"))).alias("band", "least"))
    hits = seen.join(F.broadcast(bands), ["band", "least"])  # BANDS rows for each template of the catalogue
    share = F.size(F.array_intersect("own", "held")) / F.size("own")
    found = hits.select("id", "license", "word", share.alias("share"), (F.size(F.array_except("must", "held")) == 0).alias("told")).where((F.col("share") >= CONTAINMENT) & F.col("told"))
    return found.groupBy("id", "license").agg(F.max("share").alias("containment"), F.min("word").alias("first_word"), F.count_distinct("word").alias("windows"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(store.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE_SQL: dict[str, str] = {}
