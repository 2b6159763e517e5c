"""Licence notices in texts: MinHash bands over text windows retrieve templates, shingle containment verifies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfolio.llm.common import stored
from wayfolio.llm.decontamination import index_words, small

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64

# Notices as their licences word them.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def _shingle_hashes(words: Column) -> Column:
    return F.when(
        F.size(words) >= SHINGLE,
        F.transform(F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(words, i, SHINGLE))),
    ).otherwise(F.array().cast("array<bigint>"))


def _text_at(words: Column, pos: Column) -> Column:
    return F.array_join(F.slice(words, pos + 1, SHINGLE), " ")


def template_index(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """Stored (license, n, span, hash, shingle): the distinct shingles of each template.

    ``span`` is the least power of two not below ``n``; templates of one span share windows of twice that length, which
    start every ``span`` shingles, so whatever is no longer than ``span`` lies whole in one of them.
    """
    given = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in templates.items()))
    empty = F.array().cast("array<struct<license:string,text:string>>")
    rows = spark.range(1).select(F.inline(given if templates else empty)).select("license", index_words(F.col("text")).alias("words"))
    at = rows.select("license", "words", F.posexplode(_shingle_hashes(F.col("words"))).alias("pos", "hash"))
    shingles = at.select("license", "hash", _text_at(F.col("words"), F.col("pos")).alias("shingle")).distinct()
    counts = shingles.groupBy("license").agg(F.count("*").alias("n"))
    span = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long")
    return stored(shingles.join(counts.withColumn("span", span), "license"), "templates")


def _signature() -> list[Column]:
    """One minimum per band: bands of one row, so that a window collides with a template of Jaccard J with probability
    1 - (1 - J) ** BANDS."""
    return [F.min(F.xxhash64("hash", F.lit(k))).alias(f"m{k}") for k in range(BANDS)]


def _bands(signed: DataFrame, *keep: str) -> DataFrame:
    return signed.select(*keep, F.posexplode(F.array(*(f"m{k}" for k in range(BANDS)))).alias("band", "minimum"))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT,
                 identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and licence found: doc_id, license, n_shingles, matched, containment, first_word, last_word.

    Found means that some window holds at least ``containment`` of the template's distinct five-word shingles; ``matched``
    is the best window's count and the words (0-based) span all such windows' shingles.

    Only shingles that occur in a template can be the minimum a template has, so all others leave before windows are made,
    by one probe in the scan. Among the rest a window of containment 0.8 has Jaccard 0.8 n / (2 span + 0.2 n) >= 0.19 with
    its template at worst, which 64 bands miss once in 700,000. Windows are counted exactly after that.

    * Null, empty and short texts, and templates of fewer than five words, match nothing. Texts are scanned whole.
    * Rows that repeat an id are searched each on its own. Other columns are not read. An empty table gives no rows.
    """
    known = template_index(docs.sparkSession, TEMPLATES if templates is None else templates)
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(identity).alias("doc_id"),
                        index_words(F.col(text)).alias("words"))
    at = words.select("row", "doc_id", "words", F.posexplode(_shingle_hashes(F.col("words"))).alias("pos", "hash"))
    hits = at.join(small(known.select("hash", "shingle", "span").distinct()), "hash").filter(
        _text_at(F.col("words"), F.col("pos")) == F.col("shingle")
    )
    last = F.floor(F.col("pos") / F.col("span")).cast("long")
    hits = stored(
        hits.select("row", "doc_id", "pos", "hash", "span", F.explode(F.array(last - 1, last)).alias("window")), "license_hits"
    )

    place = ["row", "span", "window"]
    window_bands = _bands(hits.groupBy(*place).agg(*_signature()), *place)
    template_bands = _bands(known.groupBy("license", "span").agg(*_signature()), "license", "span")
    candidates = window_bands.join(small(stored(template_bands, "bands")), ["span", "band", "minimum"]).select(*place, "license").distinct()

    held = hits.join(candidates, place).join(small(known.select("license", "n", "hash")), ["license", "hash"])
    verified = held.groupBy("row", "doc_id", "license", "n", "window").agg(
        F.count_distinct("hash").alias("matched"), F.min("pos").alias("first"), F.max("pos").alias("last")
    ).filter(F.col("matched") >= F.lit(containment) * F.col("n"))
    return verified.groupBy("row", "doc_id", "license", "n").agg(
        F.max("matched").alias("matched"), F.min("first").alias("first"), F.max("last").alias("last")
    ).select(
        "doc_id", "license", F.col("n").alias("n_shingles"), "matched", (F.col("matched") / F.col("n")).alias("containment"),
        F.col("first").cast("long").alias("first_word"), (F.col("last") + (SHINGLE - 1)).cast("long").alias("last_word"),
    )
