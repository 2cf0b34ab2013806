"""License scan: MinHash bands over overlapping text windows retrieve templates; exact containment verifies them.

Texts and templates are lower-cased and cut into words of a-z and 0-9. For a template of n words, windows of
n + n/4 words start every n/4 + 1 words, so that some window holds any n consecutive words whole. A window and a
template are compared where they share a band of MinHash values over five-word shingles; with one value a band and 48
bands, a window that holds a template (similarity 1/3 or more) is retrieved with probability above 1 - 4e-9. A match is
then verified on the shingles themselves: containment = the share of the template's shingles that the window has. Texts
shorter than a template are one window for it, so that a notice that breaks off is found too.

Texts that can't match are passed over first, and exactly so: for each template there is a word that more than
``1 - threshold`` of its shingles contain (or several words together), and a text without any of them can't reach the
threshold. Templates are a fixed, short list, so their bands and shingles are literals in the plan, and a window is
compared with all of them inside its row. Built-in expressions only.

Null and short texts have no matches. Rows are independent, so repeated ids, ties and extra columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import let

# fixed values: public license notices and short licenses, name -> text
TEMPLATES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License",
    "mit-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
SHINGLE, BANDS = 5, 48


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def shingles_of(text: str) -> list[str]:
    w = words_of(text)
    return [" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]


def anchors(templates: Mapping[str, str], threshold: float) -> list[str]:
    """Words such that a text without any of them misses more than ``1 - threshold`` of every template's shingles."""
    sets = {name: list(dict.fromkeys(shingles_of(t))) for name, t in templates.items()}
    have: list[str] = []
    for s in sets.values():
        covered = lambda ws, s=s: sum(any(w in x.split() for w in ws) for x in s)
        while covered(have) <= (1 - threshold) * len(s) + 1e-9:
            more = [w for w in sorted({w for x in s for w in x.split()}) if covered([*have, w]) > covered(have)]
            have.append(max(more, key=len))
    return have


def _sets(w: Column) -> Column:
    """Distinct shingles of an array of words."""
    n = F.size(w)
    return F.when(n >= SHINGLE, F.array_distinct(F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.array_join(F.slice(w, i + 1, SHINGLE), " ")))).otherwise(
        F.array().cast("array<string>")
    )


def _signature(s: Column, bands: int) -> Column:
    """The smallest hash under each of ``bands`` seeds, for a non-empty array of shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform(s, lambda x: F.xxhash64(x, b))))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8, bands: int = BANDS) -> DataFrame:
    """doc_id, license, containment, first_word (of the first best window) for each document and template that match."""
    spark = docs.sparkSession
    marks = anchors(templates, threshold)
    low = F.lower("text")
    may = F.lit(False)
    for m in marks:
        may = may | F.contains(low, F.lit(m))
    rows = [(name, len(words_of(t)), shingles_of(t)) for name, t in templates.items() if len(words_of(t)) >= SHINGLE]
    held = spark.createDataFrame(rows, "license string, n int, shingles array<string>").withColumn("shingles", F.array_distinct("shingles"))
    signed = held.withColumn("sig", _signature(F.col("shingles"), bands)).collect()  # a row for each template of the list
    known = F.array(*[F.struct(F.lit(r["license"]).alias("license"), F.lit(r["n"]).alias("n"), F.lit(r["shingles"]).alias("shingles"), F.lit(r["sig"]).alias("sig")) for r in signed])
    lengths = sorted({n for _, n, _ in rows})
    sizes = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(n + n // 4).alias("width"), F.lit(n // 4 + 1).alias("step")) for n in lengths])
    word = docs.where(F.col("text").isNotNull() & may).select("doc_id", tokens(F.col("text")).alias("w"))
    # places of the marks; only windows that hold one are cut out, and only their words go on
    literal = F.array(*map(F.lit, marks))
    places = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains(literal, x), i)), lambda i: i.isNotNull())
    size = word.withColumn("at", places).select("doc_id", "w", "at", F.explode(sizes).alias("z")).where(F.size("at") > 0)
    width, step = F.col("z.width"), F.col("z.step")
    around = lambda p: F.transform(F.sequence(F.greatest(F.lit(0), F.ceil((p - width + 1) / step).cast("int")), F.floor(p / step).cast("int")), lambda k: k * step)
    cut = F.transform(F.array_distinct(F.flatten(F.transform("at", around))), lambda i: F.struct(i.alias("first_word"), F.slice("w", i + 1, width).alias("v")))
    window = size.select("doc_id", F.col("z.n").alias("n"), F.explode(cut).alias("c")).select("doc_id", "n", "c.first_word", "c.v").where(F.size("v") >= SHINGLE)

    def matches(v: Column, n: Column) -> Column:
        def of(t: Column, s: Column, sig: Column) -> Column:
            share = F.size(F.array_intersect(t["shingles"], s)) / F.size(t["shingles"])
            return F.struct(t["license"].alias("license"), F.when((t["n"] == n) & F.arrays_overlap(t["sig"], sig), share).otherwise(0.0).alias("containment"))

        each = lambda s: let(_signature(s, bands), lambda sig: F.filter(F.transform(known, lambda t: of(t, s, sig)), lambda m: m["containment"] >= threshold))
        return let(_sets(v), each)

    checked = window.select("doc_id", "first_word", F.explode(matches(F.col("v"), F.col("n"))).alias("m")).select("doc_id", "first_word", "m.license", "m.containment")
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("back")))
    return checked.groupBy("doc_id", "license").agg(best.alias("b")).select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.back")).alias("first_word"))
