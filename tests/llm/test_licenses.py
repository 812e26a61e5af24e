import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from rewardmill.llm import license_queries
from rewardmill.llm import licenses as li

MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
FILES = [
    ("LICENSE", MIT), ("a/x.py", "code\n# licensed under the Apache License, Version 2.0.\nmore"), ("a/b/y.py", "nothing here"),
    ("a/b/LICENSE.txt", "The licence.\n" + GPL), ("a/b/c/d/z.py", None), ("a/b/c/d/z.py", None), ("a/bc/q.py", ""), (None, MIT), (None, "x"),
    (None, None), (None, "x"), (None, GPL), (None, MIT), ("w/h.c", "/*\n * Licensed under the Apache License,\n *   Version 2.0 (the \"License\");\n *\n * text\n */"),
    ("w/p.c", "Here follows some. Released under\n# the MIT License. And more\n\n--\n\nmore"), ("w/one.txt", "MIT\nISC\n\nMIT"),
    ("a/k/COPYING", "no notice"), ("a/k/r.py", "words " * 30000), ("a/k/s.py", "word " * 300 + MIT + " " + "word " * 300), ("LICENCE", GPL),
]


def brute_score(text, template):
    n = len(li.TEMPLATES)

    def terms(t):
        return Counter(x for x in re.findall(li._TERM, re.sub("licen[cs]ed?", "license", t.lower())) if x not in li.STOP_WORDS)

    df = Counter(x for _, t in li.TEMPLATES for x in terms(t))
    weigh = lambda c: {x: k * (math.log((1 + n) / (1 + df[x])) + 1) for x, k in c.items()}
    a, b = weigh(terms(text)), weigh(terms(template))
    norm = math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))
    return sum(w * b.get(x, 0) for x, w in a.items()) / norm if norm else 0.0


def known(text):
    held = {x for _, t in li.TEMPLATES for x in re.findall(li._TERM, re.sub("licen[cs]ed?", "license", t.lower()))} - set(li.STOP_WORDS)
    return len(held & set(re.findall(li._TERM, re.sub("licen[cs]ed?", "license", text.lower()))))


def sentences(part):
    return re.sub(r"([.!?])[ \t]+", "\\1\n", part).split("\n")


def brute_own(path, text):
    if text is None:
        return None
    parts = sentences(text)
    paragraph = []
    for line in [*text.split("\n"), ""]:
        if re.search("[A-Za-z0-9]", line):
            paragraph.append(line if not paragraph else re.sub("^[^A-Za-z0-9]*", "", line))
        else:
            if len(paragraph) > 1:
                parts += sentences(" ".join(paragraph))
            paragraph = []
    if path and re.search(li.LICENSE_FILE, path.split("/")[-1]):
        parts.append(text)
    best = min(((-round(brute_score(p, t), 6), name) for p in parts if known(p) > 1 for name, t in li.TEMPLATES), default=(0, ""))
    return (best[1], -best[0]) if -best[0] >= li.THRESHOLD else None


def brute(files):
    own = {}
    for path, text in files:
        got = brute_own(path, text)
        name = path if path is not None else ("unnamed", text)
        if got and (name not in own or (-got[1], got[0]) < (-own[name][1], own[name][0])):
            own[name] = got
    dirs = {}
    for path, got in own.items():
        if isinstance(path, str) and re.search(li.LICENSE_FILE, path.split("/")[-1]):
            d = "/".join(path.split("/")[:-1])
            if d not in dirs or (-got[1], got[0]) < (-dirs[d][1], dirs[d][0]):
                dirs[d] = got
    out = []
    for path, text in files:
        name = path if path is not None else ("unnamed", text)
        if name in own:
            out.append((path, *own[name], "own", None))
            continue
        parts = path.split("/")[:-1] if path else []
        ups = ["/".join(parts[:n]) for n in range(len(parts), -1, -1)] if path else []
        hit = next((d for d in ups if d in dirs), None)
        out.append((path, *dirs[hit], "inherited", hit) if hit is not None else (path, None, None, None, None))
    return out


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(p, t, "clash", 1) for p, t in FILES], "path string, text string, license string, score int")
    got = [tuple(r) for r in li.scan_licenses(df).select("path", "license", "score", "origin", "license_dir").collect()]
    assert sorted(got, key=key) == sorted(brute(FILES), key=key)


def test_what_is_not_compared_is_below_the_threshold():
    v = li.Vectors(li.TEMPLATES, li.THRESHOLD)
    for number in range(len(li.TEMPLATES)):
        unit = {t: w for n, _, t, w in v.rows if n == number}
        # One term less than needed, the heaviest ones; a match has at least two known terms anyway.
        assert any(set(unit) <= held and (n <= 2 or sum(sorted((w * w for w in unit.values()), reverse=True)[: n - 1]) < li.THRESHOLD**2) for n, held in v.needed.items())


# Notices as files carry them, in other words or lines than the templates.
REAL = [
    ("MIT", "// SPDX-License-Identifier: MIT\nint x;"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "/* SPDX-License-Identifier: GPL-3.0-or-later */"),
    ("Apache-2.0", "x = 1\n# you may not use this file except in compliance with the License.\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n"),
    ("Apache-2.0", "/*\n * Licensed under the Apache License, Version 2.0 (the \"License\"); you may not\n * use this file except in compliance with the License. You may obtain a\n * copy of the License.\n */\npackage x;"),
    ("GPL-3.0", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."),
    ("GPL-2.0", "# This program is free software; you can redistribute it and/or\n# modify it under the terms of the GNU General Public License as published\n# by the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version."),
    ("MIT", "Copyright (c) 2020 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above"),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007"),
    ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"),
    (None, "MIT"), (None, "She studied at the MIT. The license of the driver was public."), (None, "We published the software under terms that you can obtain, free of charge."),
    (None, "Version 3 of the program, June 2007"), (None, "SPDX-License-Identifier: WTFPL"), (None, "The software is subject to the following conditions"),
]


def test_notices_as_files_carry_them(spark):
    df = spark.createDataFrame([(f"d/{i}.c", t) for i, (_, t) in enumerate(REAL)], "path string, text string")
    got = {r["path"]: r["license"] for r in li.scan_licenses(df).collect()}
    assert [got[f"d/{i}.c"] for i in range(len(REAL))] == [name for name, _ in REAL]


def test_empty(spark):
    df = spark.createDataFrame([], "path string, text string")
    assert li.scan_licenses(df).count() == 0


def test_no_python_in_the_plan(spark, small):
    plan = license_queries.op3_license_scan(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_oracle(spark, small):
    name = "op3_license_scan"
    for sf in (small, small.replace("0.001", "0.01")):
        assert compare(spark, connect(sf), sf, name, license_queries.QUERIES[name], license_queries.ORACLES[name]) is None
    origins = license_queries.op3_license_scan(spark, small.replace("0.001", "0.1")).groupBy("origin").count().collect()
    assert {r.origin for r in origins} == {"own", "inherited", None}
