"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Texts become hashes of five-word shingles. A template of T shingles belongs to the class of windows whose width W is
the least power of two with T <= W - S + 1, where S = W / 8 is the step: wherever the template stands, one window holds
all of it, and it fills 3/8 of that window or more. A window that holds 0.8 of the template then has a Jaccard
similarity of at least 0.28 with it, 0.36 with a whole one; BANDS bands of ROWS rows meet in at least one band with
probability 1 - (1 - 0.28**2)**96 > 0.9995, and above 0.999997 for a whole template.
A window can only meet a template in a band if it holds the shingles that are the template's minima there, so windows
without any of those are passed over: this loses nothing.
DataFrame operations only; texts stay where they are, and only windows with such shingles go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.registry_base import register
from strandloom.session import table, written

SHINGLE, CONTAINMENT, BANDS, ROWS = 5, 0.8, 96, 2

# The notices and license texts to look for.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; null texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingles(w: str) -> Column:
    """Hashes of the five-word shingles of an array column."""
    piece = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
    return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), piece)).otherwise(F.array().cast("array<bigint>"))


def bands(shingle_hashes: Column, width: Column) -> Column:
    """The band keys of a set of shingles; the class and the band are part of a key."""
    least = lambda j: F.array_min(F.transform(shingle_hashes, lambda x: F.xxhash64(x, j)))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(width, b, *[least(b * ROWS + r) for r in range(ROWS)]))


def width_of(n: int) -> int:
    """The window width of a template of n shingles."""
    w = 1
    while n > w - step_of(w) + 1:
        w *= 2
    return w


def step_of(width: int) -> int:
    return max(1, width // 8)


def prepared(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, dict[int, list[int]], list[int]]:
    """Templates with their keys; the shingles that are minima, by class; all keys. The caller's own list bounds them."""
    rows = spark.createDataFrame(list(templates.items()), "license string, t string").select("license", words_of(F.col("t")).alias("w"))
    cut = rows.select("license", F.array_distinct(shingles("w")).alias("s")).where(F.size("s") > 0)
    w = F.lit(1)
    for n in range(20):  # widths up to a million shingles
        w = F.when(F.size("s") > (1 << n) - step_of(1 << n) + 1, F.lit(1 << (n + 1))).otherwise(w)
    sized = cut.withColumn("width", w.cast("int"))
    at_least = lambda j: F.array_min(F.transform("s", lambda x: F.struct(F.xxhash64(x, j).alias("h"), x.alias("x"))))["x"]
    full = sized.select("license", "s", "width", bands(F.col("s"), F.col("width")).alias("keys"), F.transform(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), at_least).alias("minima"))
    full = written(full, "templates")
    minima: dict[int, set[int]] = {}
    keys: set[int] = set()
    for r in full.select("width", F.array_distinct("minima").alias("m"), "keys").collect():
        minima.setdefault(r.width, set()).update(r.m)
        keys.update(r["keys"])
    return full, {k: sorted(v) for k, v in minima.items()}, sorted(keys)


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, n_template, n_matched): templates of which a window holds 0.8 or more of the shingles.

    n_matched is that of the best window. Templates of fewer than five words match nothing. Null, empty and shorter
    texts give no row; repeated rows under one doc_id give one row a license, null ids are one id. An empty table
    gives an empty result; other columns are not read.
    """
    full, minima, keys = prepared(docs.sparkSession, TEMPLATES if templates is None else templates)
    every = sorted(set().union(*minima.values())) if minima else [0]
    # no filter here: it would be pushed below these projections, and with it the whole tokenisation
    hashed = docs.select("doc_id", words_of(F.col("text")).alias("w")).select("doc_id", shingles("w").alias("s"))
    marked = hashed.select("doc_id", "s", F.filter(F.sequence(F.lit(0), F.size("s")), lambda i: F.get("s", i).isin(every)).alias("at"))
    per_class = [F.array().cast("array<struct<width:int,v:array<bigint>>>")]
    for width, anchors in sorted(minima.items()):
        step = step_of(width)
        at = F.filter("at", lambda i: F.get("s", i).isin(anchors))
        first = lambda p: F.greatest(F.lit(0), F.ceil((p - width + 1) / step).cast("int"))
        starts = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(first(p), F.floor(p / step).cast("int")))))
        per_class.append(F.transform(starts, lambda k: F.struct(F.lit(width).alias("width"), F.array_distinct(F.slice("s", k * step + 1, F.lit(width))).alias("v"))))
    windows = marked.select("doc_id", F.explode(F.flatten(F.array(*per_class))).alias("x")).select("doc_id", "x.width", "x.v")
    met = windows.withColumn("key", F.explode(F.filter(bands(F.col("v"), F.col("width")), lambda b: b.isin(keys or [0]))))
    by_key = full.select("license", F.col("s").alias("t"), F.explode("keys").alias("_key"))
    few = by_key.count() <= 200_000  # so they may be broadcast
    found = met.join(F.broadcast(by_key) if few else by_key, F.col("key") == F.col("_key")).select("doc_id", "license", "v", "t").distinct()
    checked = found.select("doc_id", "license", F.size("t").cast("long").alias("n_template"), F.size(F.array_intersect("v", "t")).cast("long").alias("n_matched"))
    return checked.where(F.col("n_matched") >= CONTAINMENT * F.col("n_template")).groupBy("doc_id", "license", "n_template").agg(F.max("n_matched").alias("n_matched"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LICENSE_SQL = f"""
WITH tt(license, text) AS (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in TEMPLATES.items())}),
tw AS (SELECT license, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM tt),
ts AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM tw)),
tn AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
c(width, step) AS (VALUES {', '.join(f'({1 << n}, {step_of(1 << n)})' for n in range(20))}),
tc AS (SELECT license, n, min(width) AS width FROM tn JOIN c ON n <= width - step + 1 GROUP BY license, n),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
h AS (SELECT doc_id, p, g, license, n, c.width, c.step FROM ds JOIN ts USING (g) JOIN tc USING (license) JOIN c ON c.width = tc.width),
k AS (SELECT doc_id, license, n, g, unnest(range(greatest(0, ceil((p - width + 1) / step)::BIGINT), p // step + 1)) AS k FROM h),
m AS (SELECT doc_id, license, n, k, count(DISTINCT g) AS n_matched FROM k GROUP BY ALL)
SELECT doc_id, license, n AS n_template, max(n_matched) AS n_matched FROM m WHERE n_matched >= {CONTAINMENT} * n GROUP BY doc_id, license, n"""


@register("op3_license_scan", LICENSE_SQL)
def op3_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
