"""License scans: MinHash bands over text windows, verified by exact containment.

Words are lower-cased and freed of punctuation; shingles are five words.
Windows of two overlapping sizes slide over each text (every half window): short
ones for templates of a line, long ones for templates of a paragraph.  Templates
are cut into windows of the same sizes.  Each window has band keys from least
shingle hashes under many permutations; a window of a text that shares a
band with a window of a template retrieves it.  A match is verified on exact shingles:
the share of the template's shingles found around the window.

Band settings, for a template that is there in full: a short window holds at
least a quarter of what it shares with the template's window, and 32 bands of one
value collide with probability 0.9999; a long window shares 0.6 or more, and
16 bands of two values collide with probability 0.999, at each of several windows.

Texts that hold no shingle of any template can't share a band; they are set
aside before any window is hashed.  Everything is built-in column functions.

Null, empty and short texts match nothing.  Copies of a template in one text are one
row with their number of windows.  Repeated rows match alike, each in its own row.
An empty table returns no rows.  Other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import ascii_lower, whole_text, words_of

SHINGLE, LEAST_PERCENT = 5, 75
PUNCTUATION = ".,;:!?()[]{}<>\"'`*#|/\\"
#: (shingles in a window, step of a text's windows, step of a template's windows, bands, values in a band).
SCALES = ((4, 2, 1, 32, 1), (16, 8, 4, 16, 2))
#: Templates with fewer shingles than this use the first scale only, the others the second.
LONG = 9

#: Public license notices and lines.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software."),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."),
}


def shingled(text: Column) -> Column:
    """Hashes of all five-word shingles of a text, in order (words need their own column: see ``with_shingles``)."""
    n = F.size(text)
    return F.when(n >= SHINGLE, F.transform(
        F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(text, i + k) for k in range(SHINGLE)])))


def with_shingles(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``shingles``; null if the text has fewer words than one shingle."""
    plain = F.translate(ascii_lower(whole_text(text)), PUNCTUATION, " " * len(PUNCTUATION))
    return rows.withColumn("_words", words_of(plain)).withColumn("shingles", shingled(F.col("_words"))).drop("_words")


def bands(window: Column, number: int, rows: int) -> Column:
    """Band keys of an array of shingle hashes: least values under permutations that flip bits."""
    def least(k: int) -> Column:
        # Flipping chosen bits permutes the 64-bit values; the top bits of the mask decide which comes first.
        mask = ((k + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
        return F.array_min(F.transform(window, lambda h: h.bitwiseXOR(F.lit(mask - (1 << 63)))))

    return F.array(*[F.xxhash64(F.lit(b), F.lit(rows), *[least(b * rows + r) for r in range(rows)]) for b in range(number)])


def windows(scale: int, step: int) -> Column:
    """Windows of ``shingles`` at a scale: where each starts and its band keys; the last may be shorter."""
    size, _, _, number, rows = SCALES[scale]
    last = F.greatest(F.size("shingles") - size, F.lit(0))
    starts = F.array_union(F.sequence(F.lit(0), last, F.lit(step)), F.array(last))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), bands(F.slice(F.col("shingles"), s + 1, size), number, rows).alias("bands")))


def templates(spark: SparkSession) -> DataFrame:
    """name, text and shingles of the templates."""
    listed = F.from_json(F.lit(json.dumps([{"name": k, "text": v} for k, v in TEMPLATES.items()])), "array<struct<name:string,text:string>>")
    return with_shingles(spark.range(1).select(F.explode(listed).alias("t")).select("t.name", "t.text")).withColumn(
        "scale", (F.size("shingles") >= LONG).cast("int"))


def matches(docs: DataFrame) -> DataFrame:
    """One row per document and license found: windows that retrieved it, best containment and where (in words)."""
    known = templates(docs.sparkSession).select("name", "scale", F.array_distinct("shingles").alias("template"), "shingles")
    index = known.select("name", "scale", F.explode(F.when(F.col("scale") == 0, windows(0, SCALES[0][2])).otherwise(
        windows(1, SCALES[1][2]))).alias("w")).select("name", "scale", F.explode("w.bands").alias("band")).distinct().collect()
    # As large as the list of templates, whatever the input.
    every = [r["s"] for r in known.select(F.explode("template").alias("s")).distinct().collect()]
    largest = known.agg(F.max(F.size("template")).alias("n")).first()["n"]
    by_scale = [sorted({r["band"] for r in index if r["scale"] == k}) for k in range(len(SCALES))]
    rows = with_shingles(docs.select(F.col("doc_id").cast("long"), "text")).drop("text")
    # A generator, not a filter: a filter would be moved below the shingles and compute them once more for every word.
    overlap = F.arrays_overlap("shingles", F.from_json(F.lit(json.dumps(every)), "array<bigint>"))
    rows = rows.withColumn("_hit", F.explode(F.when(overlap, F.array(F.lit(1))))).drop("_hit").withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumns({f"_w{k}": windows(k, SCALES[k][1]) for k in range(len(SCALES))})

    def retrieved(k: int) -> Column:
        keys = ",".join(f"{x}L" for x in by_scale[k])
        return F.expr(f"transform(filter(_w{k}, w -> exists(w.bands, b -> b IN ({keys}))), w -> named_struct("
                      f"'scale', {k}, 'start', w.start, 'bands', array_distinct(filter(w.bands, b -> b IN ({keys})))))")

    found = rows.withColumn("w", F.explode(F.concat(*[retrieved(k) for k in range(len(SCALES))])))
    # Only what can belong to a template around the window goes on.
    begin = F.greatest(F.col("w.start") - largest, F.lit(0))
    found = found.select("row", "doc_id", "w", begin.alias("begin"), F.slice(
        "shingles", begin + 1, F.lit(2 * largest + max(s for s, *_ in SCALES))).alias("near"))
    names = F.from_json(F.lit(json.dumps([{"name": r["name"], "scale": r["scale"], "band": r["band"]} for r in index])),
                        "array<struct<name:string,scale:int,band:bigint>>")
    table = docs.sparkSession.range(1).select(F.explode(names).alias("t")).select("t.*")
    found = found.withColumn("band", F.explode("w.bands")).withColumn("scale", F.col("w.scale"))
    found = (found.join(F.broadcast(table), ["band", "scale"])  # a row per band of the templates
             .select("row", "doc_id", "name", "begin", F.col("w.start").alias("start"), "near").dropDuplicates(["row", "name", "start"]))
    found = found.join(F.broadcast(known.select("name", "template")), "name")
    part = F.size(F.array_intersect("near", "template")) / F.size("template")
    found = found.withColumn("containment", part).filter(100 * F.col("containment") >= LEAST_PERCENT)
    place = F.col("begin") + F.array_min(F.filter(F.transform("template", lambda t: F.array_position("near", t).cast("int")), lambda p: p > 0)) - 1
    return found.groupBy("row", "doc_id", "name").agg(
        F.count(F.lit(1)).alias("n_windows"), F.max("containment").alias("containment"),
        F.min(place).cast("long").alias("first_word")).select(
        "doc_id", F.col("name").alias("license"), "n_windows", F.round("containment", 6).alias("containment"), "first_word")
