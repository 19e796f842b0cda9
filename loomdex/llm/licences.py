"""Licence scans: MinHash bands over overlapping text windows, then exact containment.

DataFrame and SQL functions only. Words are runs of a-z and 0-9 of the lower-cased text; a
shingle is ``K`` words. A template of L words belongs to the scale w, the least power of two
with L <= 3w/4. Windows of w words start every w/4 words, so any stretch of L words lies
within one of them.

Each template has anchors: words without which fewer than ``containment`` of its shingles
can occur. Texts without any anchor are passed over by one regular expression, and only
windows around an anchor are made; both lose nothing.

A window and a template have MinHash signatures of ``bands`` bands of one row. If the
window holds ``containment`` of the template's shingles their Jaccard similarity is at
least j, known for each template, so they meet in some band with probability
1 - (1 - j)^bands; ``bands`` is the least number for which that is ``sure`` for every
template. What meets is verified by counting the template's shingles in the window.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import broadcast_if_small

K = 3

# Wordings of common licence notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def scale_of(length: int) -> int:
    w = 4
    while 4 * length > 3 * w:
        w *= 2
    return w


def shingle_list(words: list[str]) -> list[str]:
    if len(words) < K:
        return [" ".join(words)] if words else []
    return list(dict.fromkeys(" ".join(words[i : i + K]) for i in range(len(words) - K + 1)))


def anchors_of(words: list[str], containment: float) -> list[str]:
    """Longest words such that shingles without any of them can't make up ``containment``."""
    all_, chosen = shingle_list(words), []
    for word in sorted(set(words), key=lambda x: (-len(x), x)):
        if sum(not set(s.split()) & set(chosen) for s in all_) < math.ceil(containment * len(all_) - 1e-9):
            break
        chosen.append(word)
    return chosen


def least_jaccard(words: list[str], containment: float) -> float:
    m, w = len(shingle_list(words)), scale_of(len(words))
    shared = math.ceil(containment * m - 1e-9)
    return shared / (max(w - K + 1, 1) + m - shared)


def bands_for(templates: dict[str, str], containment: float, sure: float) -> int:
    j = min(least_jaccard(words_of(t), containment) for t in templates.values())
    return math.ceil(math.log(1 - sure) / math.log(1 - j)) if j < 1 else 1


def _signature(shingles: str, bands: int) -> str:
    return f"transform(sequence(1, {bands}), b -> array_min(transform({shingles}, s -> xxhash64(s, b))))"


def _shingles_sql(words: str) -> str:
    return f"array_distinct(transform(sequence(1, greatest(size({words}) - {K - 1}, 1)), i -> array_join(slice({words}, i, {K}), ' ')))"


def template_table(spark: SparkSession, templates: dict[str, str], containment: float) -> DataFrame:
    """licence, scale, anchors, shingles, needed; one row per template with words."""
    rows = []
    for name, text in templates.items():
        if w := words_of(text):
            s = shingle_list(w)
            rows.append((name, scale_of(len(w)), anchors_of(w, containment), s, math.ceil(containment * len(s) - 1e-9)))
    return spark.createDataFrame(rows, "licence string, scale int, anchors array<string>, shingles array<string>, needed int")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, sure: float = 0.999999) -> DataFrame:
    """doc_id long, licence, shingles_found int, shingles int, containment double,
    window_start int (first word of the best window, from 0), window_words int: one row
    for each document row and licence of which some window holds ``containment``.

    Null, empty and wordless texts match nothing; a document may match several licences.
    Rows that repeat a doc_id are one document: the best window of all of them counts.
    Whole texts are scanned. The template set is a parameter and bounds what is broadcast.
    """
    spark = docs.sparkSession
    templates = {n: t for n, t in (TEMPLATES if templates is None else templates).items() if words_of(t)}
    schema = "doc_id long, licence string, shingles_found int, shingles int, containment double, window_start int, window_words int"
    if not templates:
        return spark.createDataFrame([], schema)
    bands = bands_for(templates, containment, sure)
    table = template_table(spark, templates, containment)
    by_word: dict[str, set[int]] = {}
    for t in templates.values():
        for a in anchors_of(words_of(t), containment):
            by_word.setdefault(a, set()).add(scale_of(len(words_of(t))))
    pattern = "|".join(sorted(by_word))
    listed = ", ".join(f"'{a}'" for a in sorted(by_word))
    scales = "map(" + ", ".join(f"'{a}', array({', '.join(map(str, sorted(s)))})" for a, s in sorted(by_word.items())) + ")"
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("low")).where(F.col("low").rlike(pattern))
    split = low.select("doc_id", F.explode(F.array(F.expr("regexp_extract_all(low, '[a-z0-9]+', 0)"))).alias("words"))
    at = F.expr(f"filter(transform(words, (w, i) -> CASE WHEN w IN ({listed}) THEN i END), i -> i IS NOT NULL)")
    near = split.select("doc_id", "words", at.alias("at"))
    starts = f"""array_distinct(flatten(transform(at, p -> flatten(transform({scales}[words[p]], w ->
        transform(filter(sequence(0, 3), q -> p div (w div 4) - q >= 0), q -> named_struct('w', w, 's', (p div (w div 4) - q) * (w div 4))))))))"""
    windows = near.select("doc_id", "words", F.explode(F.expr(starts)).alias("at")).select("doc_id", F.col("at.w").alias("scale"), F.col("at.s").cast("int").alias("start"), F.expr("slice(words, cast(at.s + 1 AS int), at.w)").alias("part"))
    windows = windows.select("doc_id", "scale", "start", F.explode(F.array(F.expr(_shingles_sql("part")))).alias("held"))
    # one generator per step keeps the arrays attributes, so that no lambda computes them again
    signed = windows.select("doc_id", "scale", "start", "held", F.posexplode(F.expr(_signature("held", bands))).alias("band", "value"))
    known = table.select("licence", "scale", "shingles", "needed", F.posexplode(F.expr(_signature("shingles", bands))).alias("band", "value"))
    # equal bands of one template keep one row, so a window meets it at most once for each band
    met = signed.join(broadcast_if_small(known), ["scale", "band", "value"])
    found = met.select("doc_id", "licence", "scale", "start", "needed", F.size("shingles").alias("shingles"), F.size(F.array_intersect("held", "shingles")).alias("hits")).where("hits >= needed")
    best = found.groupBy("doc_id", "licence").agg(F.max(F.struct("hits", (-F.col("start")).alias("start"), "scale", "shingles")).alias("b"))
    return best.select("doc_id", "licence", F.col("b.hits").alias("shingles_found"), F.col("b.shingles").alias("shingles"), (F.col("b.hits") / F.col("b.shingles")).alias("containment"), (-F.col("b.start")).alias("window_start"), F.col("b.scale").alias("window_words"))
