"""License notices in documents, with DataFrame functions only.

A template's words make five-word shingles. A document is read in windows of twice a template's words that
start every one template's length, so a whole copy of the template lies inside some window. Each window
and each template has ``bands`` MinHash values, one to a band; an equal value in any band retrieves the
template for the window. Shingles that no template holds say nothing about any template and are dropped
from a window first, so a window with a share ``t`` of a template of ``m`` shingles has, beside other
templates' shingles, a Jaccard similarity of nearly ``t`` to it, and at worst (its other 1.2 m shingles all
from other templates) of 0.8 / 2.2; ``1 - (1 - 0.36) ** 32`` of such windows, all but one in a million, are
retrieved. Exact containment of the template's shingles then decides, at ``least`` or more.

What a license has in a document are the shingles of its wordings' best windows. A license all of whose shingles there
are another's, too, is left out if the other has more of them or a higher containment: another version's notice, or the
opening that two licenses share.
Templates are a parameter with a fixed bound (``MAX_TEMPLATES``), so their tables are broadcast.

Edge cases: null, empty and shorter texts hold no shingle and give no rows; a document gives one row for
each license, with its best and then first window; rows with one id, a null one too, are one document of
several texts; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHINGLE = 5
BANDS = 32
LEAST = 0.8
MAX_TEMPLATES = 10_000
#: Wordings of common notices, by SPDX identifier.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
        "Licensed under the BSD 2-Clause License.",
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
        "Licensed under the BSD 3-Clause License.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License."),
    "BSL-1.0": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "Distributed under the Boost Software License, Version 1.0."),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
}


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def _hash(at: str) -> str:
    return f"xxhash64(slice(words, {at}, {SHINGLE}))"


def prepared(spark: SparkSession, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """license, template (number), n_words, hashes (distinct shingle hashes) of each wording of at least five words."""
    rows = [(lic, f"{lic}#{k}", text) for lic, texts in (templates or TEMPLATES).items() for k, text in enumerate(texts)]
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"{len(rows)} templates; the bound is {MAX_TEMPLATES}")
    df = spark.createDataFrame(rows, "license string, template string, text string").withColumn("words", words(F.col("text")))
    df = df.withColumn("n_words", F.size("words")).where(F.col("n_words") >= SHINGLE)
    longest = f"transform(sequence(1, n_words - {SHINGLE - 1}), i -> element_at(array_sort(slice(words, i, {SHINGLE}), (a, b) -> length(b) - length(a)), 1))"
    return df.select("license", "template", "n_words", F.expr(longest).alias("anchors"), F.expr(f"array_distinct(transform(sequence(1, n_words - {SHINGLE - 1}), i -> {_hash('i')}))").alias("hashes"))


def _minhashes(bands: int) -> Column:
    return F.expr(f"transform(sequence(0, {bands - 1}), b -> named_struct('band', b, 'value', array_min(transform(hashes, h -> xxhash64(h, b)))))")


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, least: float = LEAST, bands: int = BANDS) -> DataFrame:
    """doc_id, license, containment (of the best window), first_word (of that window, from 0): one row for each license of a document."""
    spark = docs.sparkSession
    temps = prepared(spark, templates)
    kept = temps.collect()  # at most MAX_TEMPLATES rows
    known = ", ".join(f"{h}L" if h != -(2**63) else "(-9223372036854775807L - 1L)" for h in sorted({h for t in kept for h in t["hashes"]}))
    sizes = sorted({t["n_words"] for t in kept})
    # Every shingle of a template has an anchor, its longest word; only shingles around anchors are hashed.
    anchors = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in sorted({w for t in kept for w in t["anchors"]}))
    hits = f"filter(transform(words, (w, i) -> IF(w IN ({anchors}), i, -1)), i -> i >= 0)"
    near = f"array_distinct(flatten(transform({hits}, i -> sequence(greatest(i - {SHINGLE - 1}, 0), least(i, size(words) - {SHINGLE})))))"
    # words and met are bound by lambdas, so each is computed once for a document, whatever the optimizer joins
    met = f"filter(transform({near}, i -> named_struct('at', i, 'hash', {_hash('i + 1')})), x -> x.hash IN ({known}))"
    read = docs.select("doc_id", F.xxhash64("text").alias("h"), F.array(words(F.col("text"))).alias("one"))
    read = read.select("doc_id", "h", F.explode(F.expr(f"flatten(transform(filter(one, words -> size(words) >= {SHINGLE}), words -> {met}))")).alias("x")).select("doc_id", "h", "x.*")
    # a shingle lies in at most two windows of each template length, and a window holds a bounded number of them
    places = read.select("doc_id", "h", "at", "hash", F.explode(F.array(*map(F.lit, sizes))).alias("n_words"))
    places = places.select("doc_id", "h", "at", "hash", "n_words", F.explode(F.expr("array(at div n_words, at div n_words - 1)")).alias("k")).where(f"k >= 0 AND at + {SHINGLE} <= (k + 2) * n_words")
    each = places.groupBy("doc_id", "h", "n_words", "k").agg(F.collect_set("hash").alias("hashes")).select("doc_id", "n_words", (F.col("k") * F.col("n_words")).alias("first_word"), "hashes")
    pairs = each.withColumn("m", F.explode(_minhashes(bands))).select("doc_id", "n_words", "first_word", "hashes", "m.band", "m.value")
    temp = temps.withColumn("m", F.explode(_minhashes(bands))).select("license", "template", "n_words", "m.band", "m.value")
    met = pairs.join(F.broadcast(temp), ["n_words", "band", "value"])
    found = met.join(F.broadcast(temps.select("template", F.col("hashes").alias("wanted"))), "template")
    found = found.withColumn("shared", F.array_intersect("wanted", "hashes")).withColumn("containment", F.size("shared") / F.size("wanted")).where(F.col("containment") >= least)
    first = F.struct("containment", -F.col("first_word"))
    each = found.groupBy("doc_id", "license", "template").agg(F.max_by(F.struct("containment", "first_word", "shared"), first).alias("x")).select("doc_id", "license", "x.*")
    best = each.groupBy("doc_id", "license").agg(F.max_by(F.struct("containment", "first_word"), first).alias("x"), F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared"))
    # lists of at most one row for each wording, then for each license
    own = best.groupBy("doc_id").agg(F.collect_list(F.struct("license", "x.containment", "x.first_word", "shared")).alias("xs"))
    more = "(y.containment > x.containment OR size(y.shared) > size(x.shared)) AND size(array_except(x.shared, y.shared)) = 0"
    own = own.select("doc_id", F.explode(F.expr(f"filter(xs, x -> NOT exists(xs, y -> {more}))")).alias("x"))
    return own.select("doc_id", "x.license", "x.containment", "x.first_word")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "license", F.round("containment", 6).alias("containment"), F.col("first_word").cast("bigint").alias("first_word"))
