import math
import re
from collections import Counter

from edges import documents

from panelweave.llm import license_scan

SCHEMA = "doc_id long, path string, text string, score double, unit string"
FILES = [
    (1, "repo/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."),
    (2, "repo/src/a.py", "# Licensed under the Apache License, Version 2.0.\nprint(1)"),
    (3, "repo/src/b.py", "print(2)"),
    (4, "repo/src/vendor/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (5, "repo/src/vendor/deep/er/c.py", "x = 1"),
    (6, "repo2/c.py", "no inheritance across repositories"),
    (7, None, "Released under the MIT License."),
    (8, None, None),
    (None, "repo/src/none.py", None),
    (9, "LICENSE.md", "Licensed under CC BY 4.0."),
    (10, "top.py", ""),
    (11, "repo/two/LICENSE", "Released under the MIT License."),
    (11, "repo/two/LICENSE", "Released under the MIT License."),
    (12, "repo/two/NOTICE", "This work is licensed under the GNU General Public License, version 2."),
    (13, "repo/two/x.py", "a license is mentioned here, but none of the known ones, in a sentence that goes on for long"),
    (14, "/abs/LICENSE", "Licensed under CC BY-NC 4.0."),
    (15, "/abs/y/z.py", "z" * 200_000),
]


def frame(spark, files=FILES):
    return spark.createDataFrame([(*f, 0.5, "x") for f in files], SCHEMA)


def scan(spark, files=FILES):
    return license_scan.scan(frame(spark, files), "doc_id", "path", "text")


def brute(files):
    cue, token = re.compile(license_scan.CUE), re.compile(license_scan.TOKEN)
    is_file = lambda p: bool(p and re.match(license_scan.LICENCE_FILE, p.rpartition("/")[2]))
    parts = {}
    for i, (_, path, text) in enumerate(files):
        if text is None:
            continue
        own = [x for x in re.split(r"\r?\n", text) + re.split(r"\r?\n[ \t]*\r?\n", text) if cue.search(x)] + [text] * is_file(path)
        parts[i] = {tuple(token.findall(x.lower())) for x in own} - {()}
    units = set().union(*parts.values())
    templates = [(name, tuple(token.findall(t.lower()))) for name, t in license_scan.TEMPLATES]
    df = Counter(t for u in [*units, *(t for _, t in templates)] for t in set(u))
    total = len(units) + len(templates)

    def vector(words):
        weights = {t: n * (math.log((1 + total) / (1 + df[t])) + 1) for t, n in Counter(words).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()}

    def best(words):
        mine, scored = vector(words), []
        for name, t in templates:
            other = vector(t)
            score = round(sum(w * other.get(x, 0) for x, w in mine.items()), 6)
            if score >= license_scan.THRESHOLD:
                scored.append((-score, name))
        return min(scored, default=None)

    owned = {}
    for i, own in parts.items():
        found = [b for b in map(best, own) if b]
        if found:
            owned[i] = min(found)
    by_dir = {}
    for i, (_, path, _) in enumerate(files):
        if i in owned and is_file(path):
            folder = path.rpartition("/")[0]
            by_dir[folder] = min(by_dir.get(folder, owned[i]), owned[i])
    out = []
    for i, (ident, path, _) in enumerate(files):
        row = (ident, path, None, None, None, None)
        if i in owned:
            row = (ident, path, owned[i][1], "own", -owned[i][0], None)
        elif path is not None:
            folder = path.rpartition("/")[0]
            while folder not in by_dir and folder:
                folder = folder.rpartition("/")[0]
            if folder in by_dir:
                row = (ident, path, by_dir[folder][1], "inherited", -by_dir[folder][0], folder)
        out.append(row)
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    assert sorted(map(tuple, scan(spark).collect()), key=str) == brute(FILES)


def test_nearest_directory_counts(spark):
    found = {r.file_id: r for r in scan(spark).collect()}
    assert found[3].license == "MIT" and found[3].license_dir == "repo"
    assert found[5].license == "GPL-3.0" and found[5].license_dir == "repo/src/vendor"
    assert found[2].license == "Apache-2.0" and found[2].origin == "own"
    assert found[8].license is None and found[13].license in ("MIT", "GPL-2.0")


def test_documents_without_paths_and_empty_table(spark):
    docs = documents(spark)
    assert license_scan.scan(docs, "doc_id", "source", "text").count() == docs.count()
    assert scan(spark, []).count() == 0


def test_plan_has_no_python(spark):
    plan = scan(spark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_planted_lines_are_found(spark, medium_dir):
    from panelweave.llm.queries import op3_license_scan

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{medium_dir}/documents.parquet").select("doc_id", "text").collect()}
    planted = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
               "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    found = {r.doc_id: r.license for r in op3_license_scan(spark, medium_dir).where("origin = 'own'").collect()}
    expected = {i: {k for k, line in planted.items() if line in t} for i, t in docs.items()}
    assert set(found) == {i for i, k in expected.items() if k}
    assert all(found[i] in expected[i] for i in found)


GENUINE = [
    ("GPL-3.0", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
     "# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."),
    ("GPL-2.0", " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
     " * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version."),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007"),
    ("LGPL-3.0", "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("MIT", "// SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only"),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
     "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
     "copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n=================================="),
]


def test_genuine_headers_titles_and_tags(spark):
    files = [(i, f"src{i}/a.py", f"x = 1\n\n{text}\n\ny = 2") for i, (_, text) in enumerate(GENUINE)]
    files.append((99, "other/a.py", "# SPDX-License-Identifier: Proprietary"))
    found = {r.file_id: r.license for r in scan(spark, files).collect()}
    assert found == {**{i: name for i, (name, _) in enumerate(GENUINE)}, 99: None}
