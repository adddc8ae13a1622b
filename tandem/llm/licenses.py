"""License scans (operator 1): TF-IDF cosine of headers and license files to templates, then inheritance along directories.

A passage of a file is a set of terms: each of its lines, each run of up to WRAP lines of at most WRAP_TERMS terms (a
notice may be wrapped), its header (the first lines up to one without terms) and, of a license file, its whole text.
Passages and templates are sparse vectors: a term that occurs weighs its inverse document frequency among the templates,
one that no template has weighs most. The best cosine of a file's passages names its license if it reaches LEAST. A
directory's license is that of its license files (best match first). A file without one of its own takes that of its
nearest directory upward that has one.

Everything is DataFrame operations, and scoring stays within a row: a cosine needs a passage's terms and the constant
templates alone. Two bounds spare most passages the work without losing any: a passage that shares no anchor term with
the templates (what is left of each template without its anchors is too light), or less than a share of its terms (the
others make it too long), can't reach LEAST. Texts never leave the scan; only paths and matches are shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.util import stored

#: Notices and titles as license authors word them, by SPDX name.
NOTICES = [
    ("AGPL-3.0", "GNU Affero General Public License Version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Released under the BSD License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal public domain dedication"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Notices, and the tag of each license that they name.
TEMPLATES = NOTICES + [(name, f"SPDX-License-Identifier: {name}") for name in sorted({n for n, _ in NOTICES})]
#: Words of any English text, which make poor anchors.
COMMON = "a above all an and any are as at be by can do either except file files following for found free in including into is it later may not of on or person persons public so that the this to use version with work you your".split()
LEAST = 0.7
WRAP, WRAP_TERMS = 4, 60
TERM = "[a-z0-9]+"
LICENSE_FILE = "(?i)^(license|licence|copying|notice)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SETS = [(name, sorted(set(re.findall(TERM, text.lower())))) for name, text in TEMPLATES]
_SEEN = Counter(t for _, terms in _SETS for t in terms)


def squared(df: int) -> int:
    """The squared weight of a term that df templates have, in millionths, so that sums are exact."""
    return round((math.log((1 + len(_SETS)) / (1 + df)) + 1) ** 2 * 1e6)


SQUARES = {t: squared(n) for t, n in sorted(_SEEN.items())}
UNKNOWN = squared(0)


def anchors() -> list[str]:
    """Terms of which a passage must have one to reach LEAST: by Cauchy-Schwarz its cosine to a template is at most the
    root of the share of the template's squares that they have in common."""
    found: set[str] = set()
    for _, terms in _SETS:
        total = rest = sum(SQUARES[t] for t in terms)
        for t in sorted(terms, key=lambda t: (t not in found, t in COMMON, -len(t), t)):  # long words are rare in other texts
            if rest < LEAST**2 * total:
                break
            found.add(t)
            rest -= SQUARES[t]
    return sorted(found)


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def line_terms(text: Column) -> Column:
    """The terms of each line, ASCII letters in lower case."""
    return F.transform(F.split(F.translate(text, _UPPER, _LOWER), "\n"), lambda line: F.regexp_extract_all(line, F.lit(TERM), F.lit(0)))


def passages(lines: Column, whole: Column, anchor: Column) -> Column:
    """Term lists of the passages that have an anchor term; see the module's text. lines: the terms of each line."""
    n = F.size(lines)
    places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.arrays_overlap(F.get(lines, i), anchor))
    runs = [(back, k) for k in range(1, WRAP + 1) for back in range(k)]

    def run(i: Column, back: int, k: int) -> Column:
        terms = F.flatten(F.slice(lines, i - back + 1, F.lit(k)))
        fits = (i >= back) & (i - back + k <= n)
        return F.when(fits, terms) if k == 1 else F.when(fits & (F.size(terms) <= WRAP_TERMS), terms)

    around = F.flatten(F.transform(places, lambda i: F.array(*(run(i, back, k) for back, k in runs))))
    worded = F.transform(lines, lambda x: F.size(x) > 0)
    first = F.array_position(worded, F.lit(True)).cast("int")
    rest = F.slice(worded, first, n)
    stop = F.array_position(rest, F.lit(False)).cast("int")
    header = F.when(first > 0, F.flatten(F.slice(lines, first, F.when(stop > 0, stop - 1).otherwise(n))))
    return F.filter(F.concat(around, F.array(header, F.when(whole, F.flatten(lines)))), lambda p: p.isNotNull())


def best_match(passages: Column) -> Column:
    """The best template of all passages, by name among equals: struct<minus, license>, the cosine in ten-thousandths
    with the sign turned; null if none reaches LEAST."""
    known = strings(list(SQUARES))
    square = F.create_map(*(F.lit(x) for t, s in SQUARES.items() for x in (t, s)))
    vectors = F.transform(F.transform(passages, F.array_distinct), lambda d: F.struct(F.size(d).alias("n"), F.array_intersect(d, known).alias("own")))
    # the others' squares alone must not bring the cosine below LEAST; no known term weighs more than an unknown one
    vectors = F.filter(vectors, lambda v: F.size(v["own"]) >= F.lit(LEAST**2 - 1e-9) * v["n"])
    total = lambda terms: F.aggregate(terms, F.lit(0).cast("long"), lambda a, t: a + F.element_at(square, t))
    vectors = F.transform(vectors, lambda v: F.struct(v["own"].alias("own"), (total(v["own"]) + (v["n"] - F.size(v["own"])) * F.lit(UNKNOWN).cast("long")).alias("norm")))

    def scores(v: Column) -> Column:
        each = []
        for name, terms in _SETS:
            length = float(sum(SQUARES[t] for t in terms))
            cosine = total(F.array_intersect(v["own"], strings(terms))) / F.sqrt(F.lit(length) * v["norm"])
            each.append(F.struct((-F.round(cosine * 10000)).cast("long").alias("minus"), F.lit(name).alias("license")))
        return F.array_min(F.array(*each))

    best = F.array_min(F.transform(vectors, scores))
    return F.when(best["minus"] <= -LEAST * 10000, best)


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Find each file's license, by its own passages or by inheritance.

    Returns every column of files but the text, with license, score (long: cosine in ten-thousandths; of the file that
    it comes from) and how (header, inherited or null); columns of files with these names are replaced, others may have
    any name. Terms are ASCII letters and digits in lower case. A null or empty text has no passage; texts of any
    length are taken whole. A null path has no directory: its file inherits nothing and hands nothing on. Rows of one
    path are judged each by itself. An empty table gives an empty result.
    """
    files = files.drop("license", "score", "how")
    names = [c for c in files.columns if c.lower() != text_col.lower()]
    path = F.col(f"`{path_col}`")
    is_license = F.coalesce(F.regexp_extract(path, "[^/]*$", 0).rlike(LICENSE_FILE), F.lit(False))
    anchor = strings(anchors())
    scanned = files.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), directory(path).alias("dir"), is_license.alias("is_license"),
        line_terms(F.col(f"`{text_col}`")).alias("lines"),
    )
    # most texts have no anchor at all, and no passage is made of them
    candidates = F.when(F.exists("lines", lambda x: F.arrays_overlap(x, anchor)), passages(F.col("lines"), F.col("is_license"), anchor))
    judged = stored(scanned.withColumn("passages", candidates).select("row", "dir", "is_license", best_match(F.col("passages")).alias("own")), "license-own")
    given = judged.filter("is_license and own is not null and dir is not null").groupBy(F.col("dir").alias("up")).agg(F.min("own").alias("given"))
    folders = judged.filter("own is null and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    ups = folders.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))).alias("depth"))
    ups = ups.withColumn("up", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    inherited = ups.join(given, "up").groupBy(F.col("dir").alias("key")).agg(F.max_by("given", "depth").alias("given"))
    # files with a license of their own need no partner; their keys are spread
    spread = F.concat(F.lit("\u0000"), F.xxhash64("row", F.monotonically_increasing_id()).cast("string"))
    out = judged.withColumn("key", F.coalesce(F.when(F.col("own").isNull(), F.col("dir")), spread)).join(inherited, "key", "left")
    found = F.coalesce("own", "given")
    how = F.when(F.col("own").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited")
    return out.select(*(F.col("row")[c].alias(c) for c in names), found["license"].alias("license"), (-found["minus"]).alias("score"), how.alias("how"))


def with_paths(docs: DataFrame) -> DataFrame:
    """Documents have no paths; these are derived from source and doc_id, with a license file in each 17 documents."""
    name = F.concat(F.when(F.col("doc_id") % 17 == 0, F.lit("LICENSE-")).otherwise(F.lit("file-")), F.col("doc_id").cast("string"), F.lit(".txt"))
    folder = F.concat_ws("/", "source", F.concat(F.lit("p"), F.expr("cast(doc_id div 5000 as string)")), F.concat(F.lit("m"), F.expr("cast(doc_id div 500 as string)")))
    # some license files stand one directory higher
    folder = F.when(F.col("doc_id") % 34 == 0, F.regexp_replace(folder, "/[^/]*$", "")).otherwise(folder)
    return docs.withColumn("path", F.concat(folder, F.lit("/"), name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_paths(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return scan_licenses(docs).select("doc_id", "path", "license", "score", "how")


def _sql() -> str:
    """From the definition: every passage against every template, without the bounds."""
    values = ", ".join("({}, '{}', '{}')".format(i, k, v.lower().replace("'", "''")) for i, (k, v) in enumerate(TEMPLATES))
    return f"""
with d as (select row_number() over () as r, doc_id, source, text, concat_ws('/', source, 'p' || (doc_id // 5000), 'm' || (doc_id // 500)) as f0 from documents),
f as (select r, doc_id, text, (case when doc_id % 34 = 0 then regexp_replace(f0, '/[^/]*$', '') else f0 end) || '/' || (case when doc_id % 17 = 0 then 'LICENSE-' else 'file-' end) || doc_id || '.txt' as path from d),
s as (select r, doc_id, path, regexp_replace(path, '/[^/]*$', '') as dir, regexp_matches(regexp_extract(path, '[^/]*$'), '{LICENSE_FILE}') as is_license,
  list_transform(string_split(translate(text, '{_UPPER}', '{_LOWER}'), chr(10)), lambda x: regexp_extract_all(x, '{TERM}')) as lines from f),
w as (select *, list_position(list_transform(lines, lambda x: len(x) > 0), true) as a from s),
h as (select *, list_position(list_transform(lines[a:], lambda x: len(x) > 0), false) as z from w),
p as (
  select r, flatten(lines[i:i + k - 1]) as terms from (select r, lines, unnest(range(1, len(lines) + 1)) as i from h) x, (select unnest(range(1, {WRAP} + 1)) as k) y where i + k - 1 <= len(lines) and (k = 1 or len(flatten(lines[i:i + k - 1])) <= {WRAP_TERMS})
  union all select r, flatten(case when coalesce(z, 0) > 0 then lines[a:a + z - 2] else lines[a:] end) from h where coalesce(a, 0) > 0
  union all select r, flatten(lines) from h where is_license),
u as (select row_number() over () as u, r, list_distinct(terms) as terms from p where len(terms) > 0),
t as (select u, r, unnest(terms) as term from u),
tt as (select distinct t, license, unnest(regexp_extract_all(line, '{TERM}')) as term from (values {values}) v(t, license, line)),
sq as (select term, cast(round(power(ln((1 + {len(TEMPLATES)})::double / (1 + count(*))) + 1, 2) * 1e6) as bigint) as square from tt group by term),
norm as (select u, any_value(r) as r, sum(coalesce(square, cast(round(power(ln((1 + {len(TEMPLATES)})::double) + 1, 2) * 1e6) as bigint)))::double as norm from t left join sq using (term) group by u),
tn as (select t, sum(square)::double as tn from tt join sq using (term) group by t),
dots as (select u, t, license, sum(square)::double as dot from t join tt using (term) join sq using (term) group by all),
sc as (select r, license, cast(round(dot / sqrt(tn * norm) * 10000) as bigint) as score from dots join norm using (u) join tn using (t)),
own as (select r, license, score from sc where score >= {LEAST * 10000:g} qualify row_number() over (partition by r order by score desc, license) = 1),
j as (select h.r, doc_id, path, dir, is_license, license, score from h left join own using (r)),
g as (select dir as up, license as gl, score as gs from j where license is not null and is_license qualify row_number() over (partition by dir order by score desc, license) = 1),
a as (select r, depth, array_to_string(list_slice(string_split(dir, '/'), 1, depth), '/') as up from (select r, dir, unnest(range(0, len(string_split(dir, '/')) + 1)) as depth from j where license is null)),
i as (select r, gl, gs from a join g using (up) qualify row_number() over (partition by r order by depth desc) = 1)
select doc_id, path, coalesce(license, gl) as license, coalesce(score, gs) as score, case when license is not null then 'header' when gl is not null then 'inherited' end as how
from j left join i using (r)
"""


ORACLE_SQL = _sql()
