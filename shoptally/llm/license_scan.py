"""License scans by MinHash bands (operator 5), JVM-side only.

Templates are short public notices. Texts and templates are lower-cased words
(letters and digits) in shingles of five words; a template of fewer words is
one shingle of all of them. Windows overlap: for templates of m shingles they
hold 2 m and start at every m-th, so any run of m lies whole in one of them.

Each of ``BANDS`` hash functions gives a window's least shingle hash, one row a
band; a window and a template with the same band value are a candidate pair. A
window that holds 80 % of a template's m shingles has a Jaccard similarity of
at least 0.8 m / 2.2 m = 0.36 with it, so all 32 bands miss with probability
0.64^32 < 10^-6. Candidates are verified by exact containment, 80 % or more of
the template's distinct shingles.

A band value can be equal only where the template's least shingle is in the
window, so texts and windows without any such shingle (at most bands x
templates values) are left out before hashing; that changes no band's result.

Defined results: NULL or blank texts match nothing; of a document's windows for
one template the one of highest containment is reported, the first of equals;
rows with equal ids are one document; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N = 5
BANDS = 32
PERCENT = 80


@dataclass(frozen=True)
class Template:
    license: str
    notice: str


# Notices as the licenses' publishers print them.
TEMPLATES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("MIT", "Released under the MIT License"),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("all-rights-reserved", "All rights reserved"),
)


def _words(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " ", -1))


def _grams(hashes: Column, n: int) -> Column:
    return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(
        F.lit(n), *[F.get(hashes, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column, bands: int) -> Column:
    """array<struct<band, least hash>>."""
    def least(b: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(b))))

    return F.array(*[F.struct(F.lit(b).alias("band"), least(b).alias("least")) for b in range(bands)])


def _windows(g: Column, n: int, m: int, anchors: Column) -> Column:
    """The windows of 2 m shingles at every m-th that hold an anchor."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(g) - 1, F.lit(0)), F.lit(m))
    part = lambda i: F.slice(g, i + 1, F.lit(2 * m))
    held = F.filter(starts, lambda i: F.arrays_overlap(part(i), anchors))
    rows = F.transform(held, lambda i: F.struct(F.lit(n).alias("n"), F.lit(m).alias("m"), i.alias("at"), part(i).alias("window")))
    # most texts have no anchor; a filter on the rows instead would be pushed below, and hash anew for each window
    return F.when(F.arrays_overlap(g, anchors), rows).otherwise(F.array().cast("array<struct<n:int,m:int,at:int,window:array<bigint>>>"))


def template_table(spark: SparkSession, templates: tuple[Template, ...], bands: int) -> list[dict]:
    """Per template: number, license, gram length n, shingles, size, band
    values, and the shingles that give them (the anchors)."""
    rows = spark.createDataFrame([(k, t.license, t.notice) for k, t in enumerate(templates)], "template int, license string, notice string")
    rows = rows.withColumn("h", F.transform(_words(F.col("notice")), lambda w: F.xxhash64(w))).where(F.size("h") > 0)
    out = None
    for n in range(1, N + 1):
        part = rows.where(F.size("h") >= N if n == N else F.size("h") == n)
        part = part.select("template", "license", F.lit(n).alias("n"), F.array_distinct(_grams(F.col("h"), n)).alias("shingles"))
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("bands", _bands(F.col("shingles"), bands))
    anchors = F.array_distinct(F.flatten(F.transform("bands", lambda e: F.filter("shingles", lambda s: F.xxhash64(s, e["band"]) == e["least"]))))
    return [r.asDict(recursive=True) for r in out.withColumn("anchors", anchors).orderBy("template").collect()]  # the parameter's rows


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def find_licenses(df: DataFrame, doc_id: Column, text: Column, templates: tuple[Template, ...] = TEMPLATES,
                  bands: int = BANDS, percent: int = PERCENT) -> DataFrame:
    """A row per document and license: doc_id, license, template (its number),
    containment, start_word and end_word of the matched shingles."""
    if not templates or len(templates) > 1000:
        raise ValueError("from 1 to 1000 templates")
    spark = df.sparkSession
    known = template_table(spark, templates, bands)
    lengths = sorted({t["n"] for t in known})
    docs = df.select(doc_id.alias("doc_id"), _words(text).alias("w"))
    docs = docs.select("doc_id", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    docs = docs.select("doc_id", *[_grams(F.col("h"), n).alias(f"g{n}") for n in lengths])

    # for each size m and gram length n the windows that hold an anchor of that size
    kinds = sorted({(t["n"], len(t["shingles"])) for t in known})
    windows = []
    for n, m in kinds:
        own = {a for t in known if (t["n"], len(t["shingles"])) == (n, m) for a in t["anchors"]}
        windows.append(_windows(F.col(f"g{n}"), n, m, _longs(sorted(own))))
    every = F.concat(*windows)
    rows = docs.select("doc_id", F.explode(every).alias("e")).select("doc_id", "e.*")
    pairs = rows.select("doc_id", "n", "m", "at", "window", F.explode(F.array_distinct(_bands(F.col("window"), bands))).alias("b"))
    pairs = pairs.select("doc_id", "n", "m", "at", "window", "b.band", "b.least")
    table = spark.createDataFrame(
        [(t["n"], len(t["shingles"]), b["band"], b["least"], t["template"], t["license"], t["shingles"]) for t in known for b in t["bands"]],
        "n int, m int, band int, least long, template int, license string, shingles array<long>")
    # at most bands x templates rows
    pairs = pairs.join(F.broadcast(table), ["n", "m", "band", "least"])
    both = F.array_intersect("shingles", "window")
    hit = F.filter(F.transform("window", lambda s, i: F.when(F.array_contains("shingles", s), i)), lambda i: i.isNotNull())
    pairs = pairs.withColumn("shared", F.size(both)).where(100 * F.col("shared") >= percent * F.size("shingles"))
    pairs = pairs.select("doc_id", "license", F.struct(
        (-F.col("shared") / F.size("shingles")).alias("less"), (F.col("at") + F.array_min(hit)).alias("start_word"),
        (F.col("at") + F.array_max(hit) + F.col("n")).alias("end_word"), "template").alias("e"))
    best = pairs.groupBy("doc_id", "license").agg(F.min("e").alias("e"))
    return best.select("doc_id", "license", "e.template", (-F.col("e.less")).alias("containment"), "e.start_word", "e.end_word")
