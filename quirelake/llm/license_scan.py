"""Operator 5: licence scan by MinHash bands over overlapping windows. DataFrame functions only.

Texts and templates become runs of word-shingle hashes (five words; words are letters and digits, lower-cased). For
each template size a text is read in overlapping windows, and windows whose MinHash bands (one value each) equal a
template's are candidates; exact containment of the template's shingles in the window verifies them.

* A template of fewer than ``LONG`` shingles must be there whole (containment 0.8 of so few leaves no shingle out). Its
  windows have its own size and start at every place: window and template are equal sets, so every band agrees.
* Longer templates have windows of two blocks of ``LONG`` * 2**i shingles, one block apart, with a block no shorter than
  the template, so one window holds the whole of it. The Jaccard similarity is at least ``least_similarity``: a verbatim
  copy has 1/4 or more and is missed by all ``BANDS`` bands with a chance under 1e-4, one at containment 0.8 has 0.19 or
  more and is missed with one under 0.001.

A window can share a template's minimum under an order only if it holds that very shingle. So a text's shingles are
first probed for the templates' minima, and the bands are computed for the windows around those places only; that
leaves out no window whose bands would agree.

Defined results: null and short texts match nothing; a text that holds a template several times is reported once with
the first word of the first window that verifies and its best containment; repeated rows are each reported (once for equal ids); a null id is reported as
null; an empty table gives no rows; other columns are ignored. Templates are a parameter; a template of fewer than five
words cannot match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS, LONG, BANDS = 5, 8, 40
MIN_CONTAINMENT = 0.8
#: Widely used licence notices, as their licences word them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


def shingle_hashes(text: Column) -> Column:
    """Array of the hashes of all runs of WORDS words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def all_of(ws: Column) -> Column:
        return F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - (WORDS - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(ws, i + j) for j in range(1, WORDS))))

    return F.get(F.transform(F.array(words), all_of), F.lit(0))  # the words are made once


def least_similarity(n: int, block: int) -> float:
    """Least Jaccard similarity of a template of n shingles, 0.8 of them in a window of two blocks, and that window."""
    need = -(-4 * n // 5)
    return need / (2 * block + n - need)


def template_table(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """Shingles and the window kind of each template; templates are a parameter, so this is small."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string").select("license", shingle_hashes(F.col("text")).alias("h")).collect()
    found = []
    for r in rows:
        n = len(r["h"])
        if n:
            block = LONG
            while block < n:
                block *= 2
            found.append({"license": r["license"], "shingles": list(dict.fromkeys(r["h"])), "n": n, "block": 0 if n < LONG else block})
    return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_containment: float = MIN_CONTAINMENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word): licences found in each text."""
    spark = docs.sparkSession
    table = template_table(spark, templates or TEMPLATES)
    rows = []
    for t in table:
        size, step = (2 * t["block"], t["block"]) if t["block"] else (t["n"], 1)
        for j in range(BANDS if t["block"] else 1):
            least = min(t["shingles"], key=lambda x, j=j: _ordered(x, j))
            rows.append((t["license"], size, step, t["shingles"], _pattern(j), least))
    # the templates are a parameter, so this side is small by its making
    bands = F.broadcast(spark.createDataFrame(rows, "license string, size int, step int, shingles array<long>, pattern long, least long"))
    minima = sorted({r[-1] for r in rows}) or [0]
    own = docs.select(F.col(doc_id).alias("doc_id"), shingle_hashes(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    hits = F.filter(F.transform("h", lambda x, i: F.when(x.isin(*minima), i)), lambda i: i.isNotNull())
    met = own.select("doc_id", "h", F.explode(hits).alias("hit")).withColumn("least", F.get("h", F.col("hit"))).join(bands, "least")
    low = F.greatest(F.ceil((F.col("hit") - F.col("size") + 1) / F.col("step")), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(low, F.floor(F.col("hit") / F.col("step")).cast("int")), lambda k: k * F.col("step"))
    windows = met.withColumn("at", F.explode(starts)).select("doc_id", "license", "shingles", "pattern", "least", "at", F.slice("h", F.col("at") + 1, F.col("size")).alias("window"))
    agree = F.array_min(F.transform("window", lambda x: x.bitwiseXOR(F.col("pattern")))) == F.col("least").bitwiseXOR(F.col("pattern"))
    share = F.size(F.array_intersect("window", "shingles")) / F.size("shingles")
    verified = windows.filter(agree).withColumn("containment", share).filter(F.col("containment") >= min_containment)
    return verified.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_word"))


def _pattern(j: int) -> int:
    """The j-th order of hashes is by their exclusive or with this bit pattern, as the hashes are well mixed."""
    value = (0x9E3779B97F4A7C15 * (2 * j + 1)) & (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def _ordered(x: int, j: int) -> int:
    return x ^ _pattern(j)
