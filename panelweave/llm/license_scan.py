"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A file's candidates are its lines and paragraphs with a licence word, and the whole text of licence files. Equal
candidates are scored once. Terms are weighted by tf * (ln((1 + N) / (1 + df)) + 1), with df counted over all
distinct candidates and templates, and the best template at or above the threshold is the file's own licence.

A file without one takes the licence of the licence file in its own or the nearest directory above, found by
joins on directory paths. Of several licence files in a directory the best score counts, then the smaller licence
name.

Null paths have no directory and inherit nothing; null texts have no candidates. Rows with equal id and path are
one file, and each gets its result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.storage import written
from panelweave.operators.skew import attach_groups

THRESHOLD = 0.6
CUE = r"(?i)licen[cs]|copyright|permission is hereby|redistribution and use|public domain"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
# Notices, titles, file headers and opening paragraphs of well-known licences. Any other list may be passed.
_FREE = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_SPDX = ("Apache-2.0", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MIT", "MPL-2.0")
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    ("GPL-2.0", _FREE.format("program", "General Public License", 2)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", _FREE.format("program", "General Public License", 3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _FREE.format("library", "Lesser General Public License", 3)),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    *((name, f"SPDX-License-Identifier: {name}") for name in _SPDX),
    *((name, f"SPDX-License-Identifier: {name}-{suffix}") for name in _SPDX if "GPL" in name for suffix in ("only", "or-later")),
)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def directory(path: Column) -> Column:
    """What stands before the last slash; empty for files at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def is_licence_file(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(path, r"([^/]*)$", 1).rlike(LICENCE_FILE), F.lit(False))


def _candidates(text: Column, whole: Column) -> Column:
    cue = lambda part: part.rlike(CUE)
    lines = F.filter(F.split(text, r"\r?\n"), cue)
    paragraphs = F.filter(F.split(text, r"\r?\n[ \t]*\r?\n"), cue)
    return F.array_distinct(F.concat(lines, paragraphs, F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>"))))


def _scores(parts: DataFrame, templates: DataFrame) -> DataFrame:
    """(unit, template, license, score): cosines of distinct candidates (unit, words) that share a term with a template.

    A candidate's terms are counted where its words were gathered, without another shuffle. Its length needs the
    weights of all its terms, the products only those of the templates, which are a parameter of a few hundred terms.
    """
    words = parts.groupBy("unit").agg(F.first("words").alias("words"))
    terms = written(words.select("unit", F.explode("words").alias("token")).groupBy("unit", "token").agg(F.count("*").alias("tf")), "terms")
    known = templates.select("template", "license", F.explode("words").alias("token")).groupBy("template", "license", "token").agg(F.count("*").alias("tf"))
    total = parts.select("unit").distinct().count() + templates.count()
    found = terms.select("token").unionAll(known.select("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = written(found.select("token", (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    weight = F.col("tf") * F.col("idf")
    lengths = attach_groups(terms, idf, ["token"]).groupBy("unit").agg(F.sqrt(F.sum(weight * weight)).alias("length"))
    known = known.join(idf, "token").withColumn("weight", weight)
    sizes = known.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"))
    known = known.join(sizes, "template").select("template", "license", "token", (F.col("weight") / F.col("size") * F.col("idf")).alias("other"))
    shared = terms.join(F.broadcast(written(known, "templates")), "token")
    products = shared.groupBy("unit", "template", "license").agg(F.sum(F.col("tf") * F.col("other")).alias("product"))
    return attach_groups(products, lengths, ["unit"]).select("unit", "template", "license", F.round(F.col("product") / F.col("length"), 6).alias("score"))


def scan(
    files: DataFrame, file_id: str, path: str, text: str, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per file: file_id, path, license, origin (own, inherited or null), score, license_dir."""
    spark = files.sparkSession
    named = files.select(F.col(file_id).alias("file_id"), F.col(path).alias("path"), F.col(text).alias("text"))
    key = F.md5(F.to_json(F.struct("file_id", "path")))
    paths = written(named.select("file_id", "path", key.alias("file"), is_licence_file(F.col("path")).alias("is_license"), directory(F.col("path")).alias("dir")), "paths")
    cued = named.where(F.col("text").rlike(CUE) | (is_licence_file(F.col("path")) & F.col("text").isNotNull()))
    parts = cued.select(key.alias("file"), F.explode(_candidates(F.col("text"), is_licence_file(F.col("path")))).alias("part"))
    parts = parts.select("file", tokens(F.col("part")).alias("words")).where("size(words) > 0")
    parts = written(parts.select("file", "words", F.unhex(F.md5(F.array_join("words", " "))).alias("unit")), "parts")
    kinds = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string")
    scores = _scores(parts.select("unit", "words"), kinds.select("template", "license", tokens(F.col("text")).alias("words")))
    best = scores.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("best"))
    best = written(best.select("unit", (-F.col("best.score")).alias("score"), F.col("best.license").alias("license")).where(F.col("score") >= threshold), "best")
    matched = attach_groups(parts.select("file", "unit"), best, ["unit"], "inner")
    owned = matched.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("best"))
    owned = written(owned.select("file", (-F.col("best.score")).alias("score"), F.col("best.license").alias("license")), "owned")
    with_own = attach_groups(paths, owned, ["file"])
    licences = with_own.where("is_license AND license IS NOT NULL AND path IS NOT NULL")
    by_dir = licences.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("best"))
    by_dir = by_dir.select(F.col("dir").alias("license_dir"), F.col("best.license").alias("inherited"), (-F.col("best.score")).alias("inherited_score"))
    wanting = with_own.where("license IS NULL AND path IS NOT NULL").select("dir").distinct()
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("license_dir")))
    # The top directory of `a/b` is the empty one; an absolute path's first step is empty too, so steps may repeat.
    ancestors = wanting.select("dir", F.inline(F.array_distinct(above)))
    nearest = attach_groups(ancestors, by_dir, ["license_dir"], "inner").groupBy("dir").agg(
        F.max(F.struct("depth", "license_dir", "inherited", "inherited_score")).alias("near")
    )
    nearest = nearest.select("dir", F.col("near.license_dir").alias("license_dir"), F.col("near.inherited").alias("inherited"), F.col("near.inherited_score").alias("inherited_score"))
    rows = attach_groups(with_own, written(nearest, "nearest"), ["dir"])
    own, gets = F.col("license").isNotNull(), F.col("path").isNotNull() & F.col("inherited").isNotNull()
    return rows.select(
        "file_id",
        "path",
        F.coalesce("license", F.when(gets, F.col("inherited"))).alias("license"),
        F.when(own, "own").when(gets, "inherited").alias("origin"),
        F.when(own, F.col("score")).when(gets, F.col("inherited_score")).alias("score"),
        F.when(own, F.lit(None).cast("string")).when(gets, F.col("license_dir")).alias("license_dir"),
    )
