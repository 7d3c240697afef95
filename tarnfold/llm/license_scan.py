"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A text's segments are its lines, its paragraphs (parted by blank lines) and the whole text, so a notice line in prose
and a licence file are both found. A segment's words are its runs of ASCII letters and digits in lower case; compared
are the sets of neighbouring pairs. Dice d = 2 |A and B| / (|A| + |B|) can reach ``t`` only if |A| lies between
``|B| t / (2 - t)`` and ``|B| (2 - t) / t``: templates outside these bounds are dropped before any comparison.
Texts that hold none of the words
of which every match holds one are done with at once. Expressions only, in one projection: no shuffle, no Python.

Defined results: null and empty texts have no licence; equal segments count once; of ties the licence that comes first
in code point order counts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Wordings of public licence notices and texts, several for one licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def template_rows(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[str, list[str], float, float]]:
    """Licence, distinct bigrams and the bounds of a segment's number of bigrams."""
    out = []
    for name, text in templates:
        words = re.findall("[a-z0-9]+", text.lower())
        pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
        out.append((name, pairs, len(pairs) * threshold / (2 - threshold), len(pairs) * (2 - threshold) / threshold))
    return out


def telling_words(rows: list[tuple[str, list[str], float, float]], threshold: float = THRESHOLD) -> list[str]:
    """Words of which every segment that reaches the threshold holds one.

    Dice t needs ``t / (2 - t)`` of a template's bigrams in the segment. Of each template words are taken, the longest
    first and common ones last, until fewer bigrams than that are left without one of them.
    """
    common = {"at", "by", "for", "following", "in", "is", "of", "the", "to", "under"}
    chosen: set[str] = set()
    for _, pairs, _, _ in rows:
        for word in sorted({w for p in pairs for w in p.split()}, key=lambda w: (w in common, -len(w), w)):
            if sum(not chosen & set(p.split()) for p in pairs) < threshold / (2 - threshold) * len(pairs) - 1e-9:
                break
            chosen.add(word)
    return sorted(chosen)


def segments(text: Column) -> Column:
    """Distinct normalised lines, paragraphs and whole text."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9\n]+", " "))
    return F.array_distinct(F.concat(F.split(plain, "\n"), F.transform(F.split(plain, "\n *\n"), lambda p: F.translate(p, "\n", " ")), F.array(F.translate(plain, "\n", " "))))


def matches(text: Column, templates=TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """Array of (dice, licence): the best match of each segment that reaches the threshold."""
    rows = template_rows(templates, threshold)
    held = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*[F.lit(p) for p in pairs]).alias("pairs"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, pairs, lo, hi in rows])
    least, most = min(r[2] for r in rows), max(r[3] for r in rows)
    words = F.transform(segments(text), lambda s: F.split(F.trim(s), " +"))
    words = F.filter(words, lambda w: F.size(w) - 1 >= least)

    def bigrams(w: Column) -> Column:
        return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))

    pairs = F.filter(F.transform(words, bigrams), lambda p: F.size(p).between(least, most))

    def compared(p: Column) -> Column:
        near = F.filter(held, lambda t: (F.size(p) >= t["lo"]) & (F.size(p) <= t["hi"]))
        # The least (-dice, licence) is the best match, and of ties the first licence.
        return F.array_min(F.transform(near, lambda t: F.struct((F.size(F.array_intersect(p, t["pairs"])) * -2.0 / (F.size(p) + F.size(t["pairs"]))).alias("minus"), t["name"].alias("name"))))

    good = F.filter(F.transform(pairs, compared), lambda d: d["minus"] <= -threshold)
    found = F.transform(good, lambda d: F.struct((-d["minus"]).alias("dice"), d["name"].alias("name")))
    # Texts without any telling word are not cut into segments at all.
    return F.when(text.rlike("(?<![A-Za-z0-9])(?i:" + "|".join(telling_words(rows, threshold)) + ")(?![A-Za-z0-9])"), found).otherwise(F.array().cast("array<struct<dice:double,name:string>>"))


def scan(documents: DataFrame) -> DataFrame:
    """``doc_id, n_licenses, licenses, best, best_dice`` of every row."""
    found = documents.select("doc_id", matches(F.col("text")).alias("found"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["name"])))
    best = F.array_max(F.transform("found", lambda x: x["dice"]))
    first = F.array_min(F.transform(F.filter("found", lambda x: x["dice"] == F.col("top")), lambda x: x["name"]))
    found = found.withColumn("top", best)
    return found.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), first.alias("best"), F.round("top", 6).alias("best_dice"))


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    rows = ", ".join("('{}', [{}], {!r}, {!r})".format(n, ", ".join(f"'{p}'" for p in pairs), lo, hi) for n, pairs, lo, hi in template_rows())
    return rf"""
WITH templates(name, pairs, lo, hi) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9\n]+', ' ', 'g')) AS plain FROM documents),
segments AS (
  SELECT DISTINCT rid, s FROM (SELECT rid, replace(s, chr(10), ' ') AS s FROM (
    SELECT rid, unnest(string_split(plain, chr(10))) AS s FROM docs
    UNION ALL SELECT rid, unnest(regexp_split_to_array(plain, '\n *\n')) FROM docs
    UNION ALL SELECT rid, plain FROM docs))),
worded AS (SELECT rid, regexp_split_to_array(trim(s), ' +') AS w FROM segments),
paired AS (SELECT rid, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p, row_number() OVER () AS sid FROM worded WHERE len(w) > 1),
compared AS (SELECT rid, sid, name, 2.0::DOUBLE * len(list_intersect(p, pairs)) / (len(p) + len(pairs)) AS dice FROM paired JOIN templates ON len(p) >= lo AND len(p) <= hi),
best_of AS (SELECT rid, sid, name, dice FROM compared WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY sid ORDER BY dice DESC, name) = 1),
found AS (SELECT rid, name, max(dice) AS dice FROM best_of GROUP BY rid, name),
per AS (SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY name) AS licenses, arg_max(name, (dice, -rk)) AS best, max(dice) AS top FROM (SELECT *, rank() OVER (ORDER BY name) AS rk FROM found) GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses, best, round(top, 6) AS best_dice FROM docs LEFT JOIN per USING (rid)"""
