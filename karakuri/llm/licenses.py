"""Licence scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karakuri.llm.common import table

SHINGLE, CONTAINMENT = 5, 0.8
#: One minimum per band: a window and a template of Jaccard similarity j share a band with probability 1 - (1 - j)**BANDS,
#: which is over 0.999 from j = 0.11 on.
BANDS = 64

# Notices and key paragraphs of public licences, as their texts have them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]


def _words(text):
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(h, k: int):
    """Hashes of k consecutive word hashes; null where fewer follow."""
    return F.transform(h, lambda x, i: F.when(F.get(h, i + k - 1).isNotNull(), F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k)))))


def template_table(spark, templates=TEMPLATES):
    """The templates (a fixed, small table) on the driver: [(number, licence, k, reach, sorted shingle hashes)].

    A template of fewer than SHINGLE words is one shingle of all its words. reach: the power of two, 8 at least, that
    its words fit in; windows of 2 * reach words at every reach words hold each of its occurrences whole.
    """
    named = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "t int, name string, text string")
    hashed = named.select("t", "name", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    ks = {k: F.filter(_shingles(F.col("h"), k), lambda x: x.isNotNull()) for k in range(1, SHINGLE + 1)}
    n = F.least(F.size("h"), F.lit(SHINGLE))
    chosen = F.coalesce(*(F.when(n == k, ks[k]) for k in ks))
    rows = hashed.where("size(h) > 0").select("t", "name", n.alias("k"), F.size("h").alias("n"), F.array_sort(F.array_distinct(chosen)).alias("s")).collect()
    return [(r["t"], r["name"], r["k"], max(8, 1 << (r["n"] - 1).bit_length()), r["s"]) for r in sorted(rows)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(id_col, license, template, containment, first_word, n_windows): the templates found in each document.

    Each window keeps those of its shingles that occur in templates of its reach and length of shingle; others can't
    add to a containment. Windows without any are empty and match nothing. A template is found in a document if a window
    holds at least the given share of its shingles; containment is the highest share, first_word where the first such
    window begins. Null and empty texts have no rows; rows equal in id and text are taken together, null ids included.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates)
    families = sorted({(k, reach) for _, _, k, reach, _ in known})
    by_k = {k: sorted({h for t in known if t[2] == k for h in t[4]}) for k, _ in families}
    text = F.col(text_col).cast("string")
    hashed = docs.select(F.col(id_col), F.xxhash64(text).alias("_key"), _words(text).alias("_w")).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))

    def hits(k):
        at = F.transform(_shingles(F.col("_h"), k), lambda x, i: F.when(x.isin(by_k[k]), F.struct(F.lit(k).alias("k"), i.alias("i"), x.alias("h"))))
        return F.filter(at, lambda x: x.isNotNull())

    # explode_outer: for explode the optimiser would compute its argument once more, in a filter
    found = hashed.select(id_col, "_key", F.explode_outer(F.concat(*map(hits, by_k))).alias("x")).where("x IS NOT NULL").select(id_col, "_key", "x.*")
    rows = [(families.index((k, reach)), k, reach, t, name, s) for t, name, k, reach, s in known]
    wanted = spark.createDataFrame(rows, "f int, k int, reach int, template int, license string, of array<bigint>")
    entries = F.broadcast(wanted.select("f", "k", "reach", F.explode("of").alias("h")).distinct())  # the templates' shingles
    block = F.floor(F.col("i") / F.col("reach"))
    windows = (
        found.join(entries, ["k", "h"])
        .select(id_col, "_key", "f", "reach", "h", F.explode(F.array(block - 1, block)).alias("w"))
        .groupBy(id_col, "_key", "f", "reach", "w")
        .agg(F.array_sort(F.collect_set("h")).alias("s"))
        .select(id_col, "f", "s", (F.greatest("w", F.lit(0)) * F.col("reach")).alias("first_word"))
    )

    def banded(df, column):
        minima = F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda j: F.array_min(F.transform(column, lambda x: F.xxhash64(x, j))))
        return df.select("*", F.posexplode(minima).alias("band", "value"))

    keyed = F.broadcast(banded(wanted.drop("k", "reach"), "of"))  # BANDS rows for each template
    matched = (
        banded(windows.select("f", "s").distinct(), "s")  # windows of equal contents are matched once
        .join(keyed, ["f", "band", "value"])
        .dropDuplicates(["f", "s", "template"])
        .withColumn("containment", F.size(F.array_intersect("of", "s")) / F.size("of"))
        .where(F.col("containment") >= containment)
        .select("f", "s", "template", "license", "containment")
    )
    return (
        windows.join(matched, ["f", "s"])
        .groupBy(id_col, "license", "template")
        .agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"), F.count("*").alias("n_windows"))
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "license", "template", F.round("containment", 6).alias("containment"), "first_word", "n_windows")
