"""License scan of whole texts by MinHash over overlapping windows; DataFrame functions only.

Texts and templates are taken as lower-cased runs of letters and digits, and as shingles of five of them. A template of
m shingles is looked for in windows of m shingles, at every place. Each of BANDS bands has one row: the window's least
shingle under the band's hash function. A window and a template whose shingle sets have similarity s share a band with
probability 1 - (1 - s) ** BANDS, over 0.99999 at s = 0.5 with 20 bands; a window that holds a template whole always
does. A window can only share a band if the template's least shingle is in it, so windows are taken around the places
of those shingles; this is the same retrieval, without windows that can't collide. What is retrieved is verified by
exact containment: at least CONTAINMENT of the template's shingles are in the window. A shorter template or text has no
shingle and is never found. Of long licenses the catalogue has the passages that name and grant them.

Everything happens within a row: no shuffle. The templates are a fixed catalogue and part of the plan.

Nulls and empty texts: no licenses. Repeated rows and ties give equal results; of windows of equal containment any counts,
as only the containment is returned. Very long texts: each place of a text is the start of one window at most, however
often notices repeat, so time grows with the text's length. An empty table gives an empty one. Input columns are dropped
but for doc_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import let

SHINGLE = 5
BANDS = 20
CONTAINMENT = 0.8

# fixed values: notices of public licenses
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation"
    ),
    "LGPL": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-3.0": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-whole": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "ISC-whole": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely"
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare "
        "derivative works of the Software"
    ),
    "Apache-2.0-grant": (
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, "
        "no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, "
        "sublicense, and distribute the Work and such Derivative Works in Source or Object form."
    ),
    "GPL-preamble": (
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, "
        "the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program"
    ),
    "MPL-2.0-grant": (
        "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: under intellectual property rights (other than patent "
        "or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit "
        "its Contributions"
    ),
}


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """Hashes of the n-word shingles, in order; none of fewer words."""
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) < n, none).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[words[i + k] for k in range(n)])))


def _least(own: Column, band: int) -> Column:
    """The shingle with the least hash in a band."""
    return F.array_min(F.transform(own, lambda x: F.struct(F.xxhash64(x, F.lit(band)).alias("k"), x.alias("x"))))["x"]


def catalogue(spark, templates: dict[str, str] = TEMPLATES) -> list[dict]:
    """Name, distinct shingles and least shingle in each band of every template; as many rows as the catalogue has."""
    rows = spark.createDataFrame(list(templates.items()), "name string, text string")
    own = F.array_distinct(shingles(terms(F.col("text"))))
    least = [_least(F.col("own"), b) for b in range(BANDS)]
    got = rows.select("name", own.alias("own")).select("name", "own", F.array(*least).alias("keys")).where(F.size("own") > 0)
    return [r.asDict() for r in got.orderBy("name").collect()]


def _matches(h: Column, template: dict) -> Column:
    """(place, containment) of verified windows of one template among the shingles h of a text."""
    m, own, keys = len(template["own"]), template["own"], template["keys"]
    own_set = F.array(*[F.lit(x) for x in own])
    wanted = dict.fromkeys(keys)

    def starts(i: Column) -> Column:
        # of the windows of m shingles that hold place i
        first = F.greatest(i - (m - 1), F.lit(0))
        return F.sequence(first, F.greatest(F.least(i, F.size(h) - m), first))

    def window(i: Column) -> Column:
        return F.struct(i.alias("place"), F.slice(h, i + 1, m).alias("w"))

    def collides(w: Column) -> Column:
        hits = [_least(w, b) == F.lit(key) for b, key in enumerate(keys)]
        return reduce(lambda a, c: a | c, hits)

    places = F.filter(F.transform(h, lambda x, i: F.when(x.isin(list(wanted)), i)), lambda i: i.isNotNull())
    retrieved = F.filter(F.transform(F.array_distinct(F.flatten(F.transform(places, starts))), window), lambda c: collides(c["w"]))
    scored = F.transform(retrieved, lambda c: F.struct((F.size(F.array_intersect(c["w"], own_set)) / F.lit(float(m))).alias("containment"), c["place"].alias("place")))
    return F.array_max(F.filter(scored, lambda c: c["containment"] >= CONTAINMENT))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_terms, n_licenses, licenses (names in order, comma-joined) and best (the largest containment)."""
    known = catalogue(docs.sparkSession, templates)
    every = sorted({k for t in known for k in t["keys"]})

    def named(name: str):
        return lambda m: F.when(m.isNotNull(), F.struct(F.lit(name).alias("name"), m["containment"].alias("containment")))

    def found(h: Column) -> Column:
        empty = F.array().cast("array<struct<name:string,containment:double>>")
        each = [let(_matches(h, t), named(t["name"])) for t in known]
        return F.when(F.exists(h, lambda x: x.isin(every)), F.filter(F.array(*each), lambda x: x.isNotNull())).otherwise(empty)

    row = let(terms(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), let(shingles(w), found).alias("m")))
    return docs.select("doc_id", row.alias("_row")).select(
        "doc_id", F.col("_row.n").alias("n_terms"), F.size("_row.m").cast("long").alias("n_licenses"),
        F.array_join(F.transform("_row.m", lambda x: x["name"]), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("_row.m", lambda x: x["containment"])), F.lit(0.0)).alias("best"),
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _oracle() -> str:
    """Every window of every template, without retrieval."""
    rows = ", ".join(f"""('{k}', '{t.replace("'", "''")}')""" for k, t in TEMPLATES.items())
    words = r"list_filter(regexp_split_to_array(lower(COALESCE(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    cut = "CASE WHEN len(w) < 5 THEN [] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END"
    return f"""
WITH t AS (SELECT name, list_distinct({cut}) AS own FROM (SELECT name, {words} AS w FROM (VALUES {rows}) v(name, text))),
tok AS (SELECT name, len(own) AS m, unnest(own) AS s FROM t),
d AS (SELECT doc_id, {words} AS w FROM documents),
g AS (SELECT doc_id, len(w) - 4 AS n, unnest({cut}) AS s, generate_subscripts({cut}, 1) AS i FROM d),
hit AS (SELECT doc_id, n, i, name, m, tok.s AS s FROM g JOIN tok USING (s)),
win AS (SELECT DISTINCT doc_id, name, m, unnest(range(GREATEST(i - m + 1, 1), GREATEST(LEAST(i, n - m + 1), GREATEST(i - m + 1, 1)) + 1)) AS p FROM hit),
c AS (SELECT win.doc_id, win.name, p, COUNT(DISTINCT s) / any_value(win.m) AS c FROM win JOIN hit ON hit.doc_id = win.doc_id AND hit.name = win.name AND i BETWEEN p AND p + win.m - 1 GROUP BY ALL),
b AS (SELECT doc_id, name, MAX(c) AS c FROM c WHERE c >= 0.8 GROUP BY ALL),
r AS (SELECT doc_id, COUNT(*) AS n, string_agg(name, ',' ORDER BY name) AS l, MAX(c) AS c FROM b GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_terms, COALESCE(r.n, 0)::BIGINT AS n_licenses, COALESCE(l, '') AS licenses, COALESCE(r.c, 0)::DOUBLE AS best
FROM d LEFT JOIN r USING (doc_id)
"""


ORACLE = _oracle()
