"""License scans: sparse TF-IDF cosine to templates, then inheritance down the directories.

Every line and sentence of a file, wrapped ones too, is compared with each template, and a file
that is named like a licence file also as a whole. A file without a notice of its own
inherits from the nearest directory above it that holds a licence file. All of
it is joins and grouped sums over (segment, term) rows.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.functions.text import let
from rewardmill.llm.common import stored

# Licences by their SPDX names, and public notices of each: short ones, headers of files, titles of licence texts.
NOTICES = (
    ("AGPL-3.0", "GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: The notices, and the tag line of each licence.
TEMPLATES = NOTICES + tuple((name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in NOTICES}))
# Words that name no licence.
STOP_WORDS = ("a", "and", "any", "are", "for", "in", "into", "is", "of", "or", "the", "this", "to", "under", "use", "with", "without")
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)(\.[^/]*)?$"
_TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
THRESHOLD = 0.7


class Vectors:
    """Unit vectors of the templates, weights of their terms, and how many terms every match must share."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float):
        counts = [Counter(t for t in re.findall(_TERM, re.sub("licen[cs]ed?", "license", text.lower())) if t not in STOP_WORDS) for _, text in templates]
        seen = Counter(t for c in counts for t in c)
        self.unknown = math.log(1 + len(templates)) + 1
        self.idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in sorted(seen.items())}
        self.rows: list[tuple[int, str, str, float]] = []
        #: Number of shared terms to the terms of the templates that need so many.
        self.needed: dict[int, set[str]] = {}
        for number, ((name, _), count) in enumerate(zip(templates, counts)):
            raw = {t: n * self.idf[t] for t, n in count.items()}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            unit = {t: w / norm for t, w in raw.items()}
            self.rows += [(number, name, t, w) for t, w in sorted(unit.items())]
            # What shares some terms has a cosine of at most their norm; fewer of the heaviest stay below the threshold.
            shared, need = 0.0, 0
            for w in sorted(unit.values(), reverse=True):
                if shared >= threshold * threshold:
                    break
                shared, need = shared + w * w, need + 1
            self.needed.setdefault(max(need, 2), set()).update(unit)

    def worth_comparing(self, said: Column) -> Column:
        """Whether a segment shares enough different terms to reach the threshold with any template."""
        known = F.array_intersect(terms(said), F.array(*[F.lit(t) for t in self.idf]))
        enough = [(n, F.array(*[F.lit(t) for t in sorted(held)])) for n, held in sorted(self.needed.items())]

        def any_of(k: Column) -> Column:
            tests = [F.size(F.array_intersect(k, held)) >= n for n, held in enough]
            return (F.size(k) >= 2) & functools.reduce(lambda a, b: a | b, tests)

        return let(known, any_of)


# Paragraphs end at a line without a letter or digit; the next line's comment signs go with the line end.
PARAGRAPH_END = r"\n(?:[^A-Za-z0-9\n]*\n)+"
LINE_END = r"\n[^A-Za-z0-9\n]*"
SENTENCE_END = r"([.!?])[ \t]+"


def segments(text: Column) -> Column:
    """Lines and their sentences, and the sentences of every paragraph of several lines, unwrapped."""

    def sentences(part: Column) -> Column:
        return F.split(F.regexp_replace(part, SENTENCE_END, "$1\n"), "\n")

    several = F.filter(F.split(text, PARAGRAPH_END), lambda p: F.contains(p, F.lit("\n")))
    return F.concat(sentences(text), F.flatten(F.transform(several, lambda p: sentences(F.regexp_replace(p, LINE_END, " ")))))


def terms(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), "licen[cs]ed?", "license")
    return F.filter(F.regexp_extract_all(plain, F.lit(f"({_TERM})"), F.lit(1)), lambda t: ~t.isin(*STOP_WORDS))


def directory(path: Column) -> Column:
    """The path without its last part; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def notices(spark: SparkSession, files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path_key, license, score) of every file with a notice: its best segment's best template; ties to the lesser name.

    A notice has at least two different words of the templates.

    Only segments that share enough terms with a template become (segment, term) rows; no other can reach
    the threshold. Term weights are those of the templates, words outside them weigh most, so a notice drowned in
    other words does not count. The broadcast tables hold the terms of the templates.
    """
    v = Vectors(templates, threshold)
    whole = F.when(F.regexp_extract(F.col("path"), "[^/]*$", 0).rlike(LICENSE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))
    candidates = F.concat(segments(F.col("text")), whole)
    found = files.select("path_key", F.posexplode(candidates).alias("segment", "said")).filter(v.worth_comparing(F.col("said")))
    found = found.select("path_key", "segment", F.xxhash64("said").alias("said_hash"), F.explode(terms(F.col("said"))).alias("term"))
    where = ["path_key", "said_hash", "segment"]
    counted = found.groupBy(*where, "term").count()
    names = [name for name, _ in templates]
    unit = {(t, number): w for number, _, t, w in v.rows}
    columns = [f"unit_{n}" for n in range(len(names))]
    rows = [(t, idf, *[unit.get((t, n), 0.0) for n in range(len(names))]) for t, idf in v.idf.items()]
    vectors = spark.createDataFrame(rows, "term string, idf double, " + ", ".join(f"{c} double" for c in columns))
    weighed = counted.join(F.broadcast(vectors), "term", "left").withColumn("weight", F.col("count") * F.coalesce("idf", F.lit(v.unknown)))
    # Norm and all products of a segment from one grouping: one column for each of the few templates. One word of a notice is none.
    dots = [F.sum(F.col("weight") * F.coalesce(c, F.lit(0.0))).alias(c) for c in columns]
    sums = weighed.groupBy(*where).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.count("idf").alias("known"), *dots).filter("known > 1")
    matches = [F.struct((-F.round(F.col(c) / F.col("norm"), 6)).alias("order"), F.lit(name).alias("license")) for c, name in zip(columns, names)]
    best = sums.select("path_key", F.least(*matches).alias("b")).groupBy("path_key").agg(F.min("b").alias("b"))
    return best.filter(F.col("b.order") <= -threshold).select("path_key", F.col("b.license").alias("license"), (-F.col("b.order")).alias("score"))


def scan_licenses(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``files`` (path, text, ...) with license, score, origin and license_dir.

    ``origin`` is ``own`` for a notice in the file itself, ``inherited`` for one from the licence file of the
    nearest directory above (its own included), else null, as are the other three; ``license_dir`` is that directory.
    Of several licence files in one directory the best match counts. Rows that repeat a path are one file. A null
    path has no directory and inherits nothing, and each text without a path is a file of its own; a null text has no notice. Columns of these names are replaced.

    Directories, not files, are walked up: each distinct one meets its ancestors by joins. The wide
    rows are only joined with narrow tables, and adaptive execution splits a directory with many files.
    """
    spark = files.sparkSession
    unnamed = F.concat(F.lit("#"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    key = F.when(F.col("path").isNotNull(), F.concat(F.lit("="), F.col("path"))).otherwise(unnamed)
    rows = files.drop("license", "score", "origin", "license_dir").withColumns({"path_key": key, "dir": directory(F.col("path"))})
    own = stored(notices(spark, rows.select("path", "path_key", "text"), templates, threshold), "notices")
    is_file = F.regexp_extract(F.col("path"), "[^/]*$", 0).rlike(LICENSE_FILE)
    holders = rows.filter(is_file).select("path_key", "dir").distinct().join(own, "path_key")
    best = F.min(F.struct((-F.col("score")).alias("order"), "license"))
    by_dir = holders.groupBy(F.col("dir").alias("above")).agg(best.alias("b")).select("above", F.col("b.license").alias("license"), (-F.col("b.order")).alias("score"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = rows.filter("dir IS NOT NULL").select("dir").distinct()
    steps = dirs.select("dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = steps.join(by_dir, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "license", "score")).alias("near"))
    mine = own.select("path_key", F.col("license").alias("own_license"), F.col("score").alias("own_score"))
    joined = rows.join(mine, "path_key", "left").join(nearest, "dir", "left")
    has_own = F.col("own_license").isNotNull()
    return joined.select(
        *[c for c in rows.columns if c not in ("path_key", "dir")],
        F.coalesce("own_license", "near.license").alias("license"),
        F.when(has_own, F.col("own_score")).otherwise(F.col("near.score")).alias("score"),
        F.when(has_own, F.lit("own")).when(F.col("near").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(~has_own, F.col("near.above")).alias("license_dir"),
    )
