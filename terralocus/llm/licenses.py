"""License scans: TF-IDF cosine of lines to templates, inherited along directories.

Every line of every text is compared with short license templates. The weight of
a template word is its inverse document frequency over all documents; a word of
no template weighs like one that no document has. The cosine is a sparse
product: words of a line join the words of the templates. A line can reach the
threshold with a template only if it holds one of the template's heavy words
(the lighter ones together stay below it, by Cauchy-Schwarz), so other lines
leave before anything is joined; distinct lines are compared once.

A file's own license is that of its best line. A licence file (by its name, or
because license lines hold half of its words) gives its license to its
directory, and a file without one takes that of the nearest directory above it.

Defined results: null and empty texts, and null paths, have no license of their
own, and a null path inherits nothing; ties of a best line go to the smaller
license name; of several licence files in a directory the one with the best
line counts, then the smaller license name, then the smaller path; repeated
rows are reported each.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from .tables import BROADCAST_ROWS, staged, whole_text

THRESHOLD = 0.75
# Share of a text's words in license lines that makes it a licence file.
FILE_SHARE = 0.5
FILE_NAME = r"(?i)(^|/)(license|licence|copying|notice)[^/]*$"

# License and a text that states it.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
]
WORD = r"[0-9a-z]+(?:\.[0-9]+)*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _template_words() -> list[tuple[int, str, str, int]]:
    """(template, license, word, times)."""
    out = []
    for number, (name, text) in enumerate(TEMPLATES):
        found = re.findall(WORD, text.lower())
        out += [(number, name, w, found.count(w)) for w in sorted(set(found))]
    return out


def _frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many texts each template word stands, and the number of texts."""
    vocabulary = sorted({w for _, _, w, _ in _template_words()})
    held = F.array_intersect(words(whole_text()), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counts.collect()}, docs.count()


def _weights(frequency: dict[str, int], number: int) -> tuple[dict[str, float], float]:
    idf = lambda n: round(math.log((1 + number) / (1 + n)) + 1, 9)
    return {w: idf(frequency.get(w, 0)) for _, _, w, _ in _template_words()}, idf(0)


def _heavy(weight: dict[str, float], threshold: float) -> list[str]:
    """Words without which a line stays below the threshold for every template."""
    heavy = set()
    for number in range(len(TEMPLATES)):
        own = sorted(((weight[w] * n, w) for i, _, w, n in _template_words() if i == number))
        norm, light = math.sqrt(sum(x * x for x, _ in own)), 0.0
        for x, w in own:
            light += x * x
            if math.sqrt(light) >= threshold * norm * (1 - 1e-9):
                heavy.add(w)
    return sorted(heavy)


def lines_of(docs: DataFrame, heavy: list[str]) -> DataFrame:
    """`row`, `uid`, `path`, number of words, and the lines that hold a heavy word; the text is left behind."""
    lines = F.transform(F.split(whole_text(), "\n"), lambda x: F.trim(x))
    near = F.filter(lines, lambda x: F.arrays_overlap(words(x), F.array(*map(F.lit, heavy))))
    others = [c for c in docs.columns if c != "text"]
    out = docs.select(F.struct(*others).alias("row"), F.col("path").alias("path"), F.size(words(whole_text())).alias("words"), near.alias("lines"))
    return staged(out.withColumn("uid", F.monotonically_increasing_id()), "license-lines")


def compared(lines: DataFrame, weight: dict[str, float], unknown: float, threshold: float) -> DataFrame:
    """Distinct `line`s with the license of the nearest template and its `cosine`, where it reaches the threshold."""
    spark = lines.sparkSession
    terms = lines.select("line", F.explode(words(F.col("line"))).alias("word")).groupBy("line", "word").count()
    known = spark.createDataFrame(sorted(weight.items()), "word string, idf double")
    weighed = terms.join(F.broadcast(known), "word", "left").select("line", "word", (F.col("count") * F.coalesce("idf", F.lit(unknown))).alias("w"))
    norm = weighed.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    norms = {i: math.sqrt(sum((weight[w] * n) ** 2 for j, _, w, n in _template_words() if i == j)) for i in range(len(TEMPLATES))}
    rows = [(i, name, w, weight[w] * n / norms[i]) for i, name, w, n in _template_words()]
    template = spark.createDataFrame(rows, "template int, license string, word string, unit double")
    dots = weighed.join(F.broadcast(template), "word").groupBy("line", "template", "license").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    scored = dots.join(norm, "line").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("cosine") >= threshold)
    best = scored.groupBy("line").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("best"))
    return best.select("line", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("cosine"))


def directory(path: Column) -> Column:
    """Everything before the last slash; the root is the empty string."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def above(folder: Column) -> Column:
    """The folder and all above it, the root last."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def scanned(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(path, text, ...) -> every row as `row`, with path, license, cosine, origin (own or directory) and folder."""
    weight, unknown = _weights(*_frequencies(docs))
    files = lines_of(docs, _heavy(weight, threshold))
    asked = files.select("uid", F.explode("lines").alias("line"))
    found = staged(compared(asked.select("line").distinct(), weight, unknown, threshold), "licensed-lines")
    met = asked.join(_small(found), "line").withColumn("own_words", F.size(words(F.col("line"))))
    own = met.groupBy("uid").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("best"), F.sum("own_words").alias("held"))
    marked = files.drop("lines").join(own, "uid", "left").select(
        "row", "path", directory(F.col("path")).alias("own_folder"), F.col("best.license").alias("license"), (-F.col("best.minus")).alias("cosine"),
        (F.col("best").isNotNull() & F.col("path").isNotNull() & (F.rlike("path", F.lit(FILE_NAME)) | (F.col("held") >= FILE_SHARE * F.col("words")))).alias("is_file"))
    marked = staged(marked, "licensed-files")
    given = marked.filter("is_file").groupBy(F.col("own_folder").alias("folder")).agg(
        F.min(F.struct((-F.col("cosine")).alias("minus"), "license", "path"))["license"].alias("given"))
    folders = marked.filter("license is null and own_folder is not null").select("own_folder").distinct()
    reach = folders.select("own_folder", F.posexplode(above(F.col("own_folder"))).alias("up", "folder")).join(_small(given), "folder")
    nearest = reach.groupBy("own_folder").agg(F.min(F.struct("up", "folder", "given")).alias("near")).select("own_folder", "near.folder", "near.given")
    return marked.join(_small(nearest), "own_folder", "left").select(
        "row", "path", F.coalesce("license", "given").alias("license"), "cosine",
        F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "directory").alias("origin"),
        F.when(F.col("license").isNull(), F.col("folder")).alias("folder"))


def judged(docs: DataFrame) -> DataFrame:
    """Every document at the path source/lang/doc_id: doc_id, path, license, cosine, origin, folder."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    out = scanned(docs.select("doc_id", "text", path.alias("path")))
    return out.select(F.col("row")["doc_id"].alias("doc_id"), "path", "license", "cosine", "origin", "folder")


# ---- the same in SQL -----------------------------------------------------------------------------

def oracle_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(name)}, {quote(w)}, {n})" for i, name, w, n in _template_words())
    cut = f"regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""
WITH template(template, license, word, times) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS uid, doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, coalesce(text, '') AS text FROM documents),
total AS (SELECT count(*) AS n FROM docs),
held AS (SELECT uid, unnest(list_distinct({cut.format('text')})) AS word FROM docs),
frequency AS (SELECT word, count(*) AS n FROM held WHERE word IN (SELECT word FROM template) GROUP BY word),
idf AS (SELECT w.word, round(ln((1 + total.n) / (1 + coalesce(f.n, 0))) + 1, 9) AS idf FROM (SELECT DISTINCT word FROM template) w LEFT JOIN frequency f USING (word), total),
unit AS (SELECT template, license, word, times * idf / sqrt(sum(times * idf * times * idf) OVER (PARTITION BY template)) AS unit FROM template JOIN idf USING (word)),
lines AS (SELECT uid, trim(unnest(string_split(text, chr(10)))) AS line FROM docs),
terms AS (SELECT line, word, count(*) AS times FROM (SELECT line, unnest({cut.format('line')}) AS word FROM (SELECT DISTINCT line FROM lines)) GROUP BY ALL),
weighed AS (SELECT line, word, times * coalesce(idf, round(ln(1 + total.n) + 1, 9)) AS w FROM terms LEFT JOIN idf USING (word), total),
norm AS (SELECT line, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY line),
dots AS (SELECT line, template, license, sum(w * unit) AS dot FROM weighed JOIN unit USING (word) GROUP BY ALL),
near AS (SELECT line, license, round(dot / norm, 6) AS cosine FROM dots JOIN norm USING (line) WHERE round(dot / norm, 6) >= {THRESHOLD}),
best AS (SELECT line, license, cosine FROM near QUALIFY row_number() OVER (PARTITION BY line ORDER BY cosine DESC, license) = 1),
met AS (SELECT uid, license, cosine, len({cut.format('line')}) AS own_words FROM lines JOIN best USING (line)),
own AS (SELECT uid, sum(own_words) AS held FROM met GROUP BY uid),
first AS (SELECT uid, license, cosine FROM met QUALIFY row_number() OVER (PARTITION BY uid ORDER BY cosine DESC, license) = 1),
marked AS (
  SELECT d.uid, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS own_folder, license, cosine,
         license IS NOT NULL AND (regexp_matches(path, '{FILE_NAME}') OR held >= {FILE_SHARE} * len({cut.format('text')})) AS is_file
  FROM docs d LEFT JOIN first USING (uid) LEFT JOIN own USING (uid)),
given AS (SELECT own_folder AS folder, license AS given FROM marked WHERE is_file QUALIFY row_number() OVER (PARTITION BY own_folder ORDER BY cosine DESC, license, path) = 1),
reach AS (SELECT m.own_folder, g.folder, given FROM (SELECT DISTINCT own_folder FROM marked) m JOIN given g ON g.folder = '' OR m.own_folder = g.folder OR starts_with(m.own_folder, g.folder || '/')),
nearest AS (SELECT own_folder, folder, given FROM reach QUALIFY row_number() OVER (PARTITION BY own_folder ORDER BY length(folder) DESC) = 1)
SELECT doc_id, path, coalesce(license, given) AS license, cosine,
       CASE WHEN license IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'directory' END AS origin,
       CASE WHEN license IS NULL THEN folder END AS folder
FROM marked LEFT JOIN nearest USING (own_folder)"""
