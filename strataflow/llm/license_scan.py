"""License scan with MinHash bands over overlapping windows, in DataFrame functions only.

Words are lower-cased (A-Z) runs between ASCII white space. A template of n words has m = n - 4
5-word shingles. Texts are read in windows of m + h - 1 shingles that begin at every h-th shingle,
h = max(1, m div 4), so every stretch of m shingles lies whole in some window. A window
that holds 80 % of a template's shingles has a Jaccard similarity of 0.8 / 1.45 at least to it; with
``BANDS`` bands of one MinHash each, at least one collides with probability 1 - 0.449^10 > 0.9996. Colliding
pairs are verified by the exact containment of the template's shingles in the window.

Two exact filters come first. A text that holds 80 % of a template's shingles can miss few of its
words: of any t words five or more apart, t = missing shingles div 5 + 1, one is there, so
texts with none of those words are out by plain substring search. And only windows with a
shingle of some template are hashed. The shingles of a text are cut into pieces of ``PIECE`` starts, each
followed by as many shingles more as the largest window needs, so a row never holds more than a piece
and its windows, and a long text costs in proportion to its length.

Templates are a dictionary on the driver and small by nature; they become literals of the plan.

Defined cases: null texts and texts under five words match nothing; repeated rows match each on its
own; of windows with equal containment the first is reported; templates need five words (else
ValueError); extra columns aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K, BANDS, PERCENT = 5, 10, 80
#: Shingles at which windows of one piece begin.
PIECE = 2048

# Notices of common licenses, as they are published.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "apache-2.0-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-line": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text.translate(str.maketrans(_UPPER, _LOW)))


def required(text: str, percent: int = PERCENT) -> list[str]:
    """Words of which any text that holds percent of the template's shingles has at least one."""
    words = template_words(text)
    m = len(words) - K + 1
    missing = m - -(-percent * m // 100)
    need = missing // K + 1
    inner = range(K - 1, m) if m >= K else range(m - 1, K)  # places that as many shingles cover as can be
    cover = min(K, m)
    if m < K:
        need = missing // cover + 1
    picked: list[int] = []
    for i in sorted(inner, key=lambda i: (-len(words[i]), i)):
        if len(picked) < need and all(abs(i - j) >= K for j in picked):
            picked.append(i)
    return sorted({words[i] for i in picked}) if len(picked) == need else [""]


def with_shingles(rows: DataFrame) -> DataFrame:
    """rows(.., text) -> rows(.., h): the hashes of all 5-word windows in order; null under five words.
    Words and hashes are projected one after the other, and no filter tests them: an expression that the
    optimizer inlines into a lambda would be computed anew for each element."""
    keys = [c for c in rows.columns if c != "text"]
    words = F.filter(F.split(F.translate("text", _UPPER, _LOW), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    cut = rows.select(*keys, words.alias("words"))
    at = F.when(F.size("words") >= K, F.sequence(F.lit(1), F.size("words") - (K - 1)))
    return cut.select(*keys, F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("words", i, K), " "))).alias("h"))


def band_marks(shingles: Column) -> Column:
    """Of every band the marks of all shingles; the least of a window's is its MinHash."""

    def band(b: int) -> Column:
        return F.transform(shingles, lambda x: F.xxhash64(x, F.lit(b)))

    return F.array(*map(band, range(BANDS)))


def _windows(m: int, grams: list[int], known: list[int]) -> Column:
    """[(m, start, window, bands)] of the grid windows of one template size that begin in a piece, hold one of the
    n-grams of templates of that size, and have a MinHash of theirs. The piece's column h begins at shingle base of
    the text, marks are its band marks."""
    hop = max(1, m // 4)
    size = m + hop - 1
    first = lambda p: F.greatest(F.ceil(F.col("base") / hop), F.ceil((F.col("base") + p - size + 1) / hop)).cast("int")
    last = lambda p: F.least(F.floor((F.col("base") + PIECE - 1) / hop), F.floor((F.col("base") + p) / hop)).cast("int")
    hits = F.filter(F.transform("h", lambda x, i: F.when(x.isin(grams), i)), lambda i: i.isNotNull())
    grid = F.flatten(F.transform(hits, lambda p: F.when(first(p) <= last(p), F.sequence(first(p), last(p))).otherwise(F.array().cast("array<int>"))))
    window = lambda c, j: F.slice(c, (j * hop - F.col("base") + 1).cast("int"), size)
    bands = lambda j: F.transform("marks", lambda x: F.array_min(window(x, j)))
    hashed = F.transform(F.array_distinct(grid), lambda j: F.struct(j.alias("j"), bands(j).alias("bands")))
    colliding = F.filter(hashed, lambda w: F.exists(w.bands, lambda x: x.isin(known)))
    return F.transform(colliding, lambda w: F.struct(F.lit(m).alias("m"), (w.j * hop).alias("start"), window("h", w.j).alias("window"), w.bands.alias("bands")))


def _template_rows(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(k).alias("template_id"), F.lit(v).alias("text")) for k, v in sorted(templates.items())))
    return with_shingles(spark.range(1).select(F.inline(rows))).select("template_id", F.array_distinct("h").alias("t_set"), F.size("h").alias("m"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, template_id, containment, start_word (from 0) of the best window of every document and
    template that match."""
    short = [k for k, v in templates.items() if len(template_words(v)) < K]
    if short:
        raise ValueError(f"templates need {K} words: {short}")
    spark = docs.sparkSession
    table = _template_rows(spark, templates).select("template_id", "t_set", "m", F.posexplode(F.transform(band_marks(F.col("t_set")), F.array_min)).alias("band", "mark"))
    known = table.select("t_set", "m", "mark").collect()
    sizes = sorted({r.m for r in known})
    of_size = {m: sorted({x for r in known if r.m == m for x in r.t_set}) for m in sizes}
    grams = sorted({x for xs in of_size.values() for x in xs})
    words = sorted({w for v in templates.values() for w in required(v, percent)})
    # One pass over the text for all words: functions that change case cost more than the search.
    start = "\\b" if all(w[:1].isalnum() and w.isascii() for w in words) else ""
    pattern = f"(?i){start}(?:" + "|".join(re.sub("([^a-z0-9])", r"\\\1", w) for w in words) + ")"
    likely = docs.select("doc_id", "text").where(F.lit(False) if not words else F.lit(True) if "" in words else F.col("text").rlike(pattern))
    hashed = with_shingles(likely.select("doc_id", F.xxhash64("text").alias("_t"), "text"))
    # Outer explodes: for inner ones the optimizer infers a filter on their size, pushes it down and computes all anew.
    most = max((m + max(1, m // 4) - 1 for m in sizes), default=1)
    bases = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1, F.lit(PIECE)))
    cut = F.transform(bases, lambda b: F.struct(b.alias("base"), F.slice("h", b + 1, F.lit(PIECE + most - 1)).alias("h")))
    pieces = hashed.select("doc_id", "_t", F.explode_outer(cut).alias("p")).select("doc_id", "_t", "p.base", "p.h")
    hits = pieces.where(F.exists("h", lambda x: x.isin(grams))).select("*", band_marks(F.col("h")).alias("marks"))
    collide = {m: sorted({r.mark for r in known if r.m == m}) for m in sizes}
    windows = hits.select("doc_id", "_t", F.explode_outer(F.flatten(F.array(*(_windows(m, of_size[m], collide[m]) for m in sizes)))).alias("w")).where("w is not null").select("doc_id", "_t", "w.*")
    banded = windows.select("doc_id", "_t", "m", "start", "window", F.posexplode("bands").alias("band", "mark"))
    # The template table holds BANDS rows for each entry of a driver-side dictionary.
    pairs = banded.join(F.broadcast(table), ["m", "band", "mark"])
    held = F.size(F.array_intersect("window", "t_set"))
    verified = pairs.withColumn("held", held).where(F.col("held") * 100 >= F.size("t_set") * percent)
    best = verified.groupBy("doc_id", "_t", "template_id").agg(F.max(F.struct((F.col("held") / F.size("t_set")).alias("c"), (-F.col("start")).alias("s"))).alias("best"))
    return best.select("doc_id", "template_id", F.col("best.c").alias("containment"), (-F.col("best.s")).cast("long").alias("start_word"))


def oracle(templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> str:
    """The same result in DuckDB SQL, by exact containment of every window."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    grams = "list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))"
    words = "list_filter(regexp_split_to_array(translate(text, '{}', '{}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')".format(_UPPER, _LOW)
    return f"""
with t as (select template_id, {words} as w from (values {rows}) v(template_id, text)),
ts as (select template_id, {grams} as g from t),
tm as (select template_id, list_distinct(g) as s, len(g) as m, greatest(1, len(g) // 4) as hop from ts),
tg as (select distinct unnest(s) as gram from tm),
d as (select doc_id, {words} as w from documents),
dg as (select doc_id, {grams} as g from d where len(w) >= 5),
hit as (select distinct doc_id from (select doc_id, unnest(g) as gram from dg) join tg using (gram)),
win as (select doc_id, template_id, s, start, list_distinct(g[start + 1:start + m + hop - 1]) as win
        from (select doc_id, g, template_id, s, m, hop, unnest(range(0, len(g), hop)) as start from dg semi join hit using (doc_id), tm)),
held as (select doc_id, template_id, start, len(list_intersect(win, s)) as n, len(s) as m from win)
select doc_id, template_id, max(n / m) as containment, cast(arg_min(start, (-n, start)) as bigint) as start_word
from held where n * 100 >= m * {percent} group by doc_id, template_id"""
