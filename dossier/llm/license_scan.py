"""License scans: MinHash bands over overlapping windows, then exact containment.

A template is a license statement. For each size of template a text is cut into
overlapping windows, a quarter of the template longer than it and a quarter of it
apart, so any stretch as long as the template lies inside one. A window's MinHash
signature is cut into bands; a window that shares a band with a template is checked:
``CONTAINMENT`` or more of the template's distinct shingles must be in the window.

A matching window has a Jaccard similarity of at least 0.8 / 1.45 to its template,
so with ``BANDS`` bands of ``ROWS`` rows it is retrieved with a probability of at least
1 - (1 - 0.55 ** 2) ** 24 > 0.9998. A window that has no shingle of any template can share no
minimum with one; such windows are left out before signatures are made.

The template table is broadcast; its size is that of ``TEMPLATES``, not of the data.
Everything else stays in the row until windows have been found, and only those rows
are grouped.

Defined results: null and empty texts, and texts shorter than a shingle, match
nothing; rows are told apart by id, repeated rows report once, rows without an id
as one document; of equal matches the first place counts; an empty table gives an
empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import let, table

#: Words of a shingle. License statements are short: five words would leave some with one.
SHINGLE = 3
BANDS, ROWS = 24, 2
CONTAINMENT = 0.8
# Statements by which works are placed under a license.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights"),
]


def _tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    cleaned = F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " ")))
    nothing = F.array().cast("array<string>")
    return let(cleaned, lambda c: F.when(c == "", nothing).otherwise(F.split(c, " ")))


def _shingles(tokens: Column) -> Column:
    """64-bit hashes of the shingles of an array of tokens."""
    starts = F.sequence(F.lit(0), F.size(tokens) - SHINGLE)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(SHINGLE))))
    return F.when(F.size(tokens) < SHINGLE, F.array().cast("array<bigint>")).otherwise(hashes)


def _bands(shingles: Column) -> list[Column]:
    """One hash per band, of the band's number and its minima."""

    def least(seed: int) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(seed))))

    return [
        F.xxhash64(F.lit(b), *(least(b * ROWS + r) for r in range(ROWS))) for b in range(BANDS)
    ]


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    """template, license, size (distinct shingles), shingles, width and step of its windows."""
    rows = [
        F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text"))
        for i, (name, text) in enumerate(templates)
    ]
    given = spark.range(1).select(F.inline(F.array(*rows))).withColumn("tokens", _tokens(F.col("text")))
    shingles = given.select("template", "license", F.array_distinct(_shingles(F.col("tokens"))).alias("shingles"))
    size = F.size("shingles")
    step = F.greatest(F.lit(1), F.floor(size / 4)).cast("int")
    return shingles.filter(size > 0).select(
        "*", size.alias("size"), (size + step).alias("width"), step.alias("step")
    )


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, template, containment, word (place of the window), n_windows.

    One row per document and license: its best window, the first of equals.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates)
    # Bounded by the template list: at most a few hundred numbers.
    listed = known.select("shingles", "width", "step").collect()
    hashes = sorted({h for row in listed for h in row["shingles"]})
    kinds = sorted({(row["width"], row["step"]) for row in listed})

    def touched(found: Column, width: int, step: int) -> Column:
        """Starts of the windows that hold a place in ``found``."""
        first = F.greatest(F.lit(0), F.ceil((found - (width - 1)) / step)).cast("int")
        return F.sequence(first, F.floor(found / step).cast("int"))

    def windows(shingled: Column) -> Column:
        places = F.filter(
            F.transform(shingled, lambda h, i: F.when(h.isin(hashes), i)), lambda i: i.isNotNull()
        )

        def cut(found: Column) -> Column:
            sizes = [
                F.transform(
                    F.array_distinct(F.flatten(F.transform(found, lambda p: touched(p, width, step)))),
                    lambda w: F.struct(
                        F.lit(width).alias("width"), (w * step).alias("word"),
                        F.slice(shingled, w * step + 1, F.lit(width)).alias("shingles"),
                    ),
                )
                for width, step in kinds
            ]
            return F.concat(*sizes)

        return let(places, cut)

    # The outer form, since the inner one would first evaluate the array for a filter on its size.
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.explode_outer(let(_tokens(F.col("text")), lambda t: let(_shingles(t), windows))).alias("w"),
    ).filter("w IS NOT NULL").select("doc_id", "w.width", "w.word", "w.shingles")
    banded = rows.select("doc_id", "width", "word", "shingles", F.explode(F.array(*_bands(F.col("shingles")))).alias("band"))
    sought = known.select(
        "template", "license", "size", F.col("width").alias("t_width"), F.col("shingles").alias("t_shingles"),
        F.explode(F.array(*_bands(F.col("shingles")))).alias("t_band"),
    )
    met = banded.join(
        F.broadcast(sought), (F.col("band") == F.col("t_band")) & (F.col("width") == F.col("t_width"))
    )
    share = F.size(F.array_intersect("t_shingles", "shingles")) / F.col("size")
    verified = met.select("doc_id", "license", "template", "word", share.alias("share")).filter(
        F.col("share") >= containment
    )
    best = F.max(F.struct("share", -F.col("word"), -F.col("template")))
    return verified.groupBy("doc_id", "license").agg(
        best.alias("best"), F.count_distinct("template", "word").alias("n_windows")
    ).select(
        "doc_id", "license", (-F.col("best.col3")).alias("template"), F.col("best.share").alias("containment"),
        (-F.col("best.col2")).cast("long").alias("word"), "n_windows",
    )


def op1_license_scan(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
