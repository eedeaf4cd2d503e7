"""License scans with DataFrame functions only.

Each line of a text is a sparse TF-IDF vector (a term counts once in a line;
document frequencies, of every word, are over all lines of the corpus) and is
compared by cosine with notice templates; a file's own license is that of its
best line at ``THRESHOLD`` or more. A template word that no line has weighs as
much as the mean word of the corpus, or it would outgrow the seen words as the
number of lines grows. A file whose name says that it holds the license of its
directory is also compared as a whole, with the whole license texts too. A file without a license of its own
inherits that of the nearest ancestor directory which states one, found by
joins on directory paths, one row for each directory.

Only lines with one of a template's heaviest terms are compared: without them
no cosine can reach the threshold (Cauchy-Schwarz), nor if it does not when all
other words weigh 1, the least weight; so none is lost. That last bound is first
taken over classes of about equal weight, which a line's words are counted in
without looking at each template. Templates, their terms
and the frequencies collected for those terms are of fixed size; the frequencies
of other words stay distributed and are joined to the distinct lines compared.

Defined results: null and empty texts have no license of their own, a null path
lies in the root directory ""; ties of cosine go to the earlier template and
those of statements to the name that sorts first; texts of any length are read
whole, line by line; every row is answered, repeated rows included; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .license_texts import TEXTS

#: Cosine from which a line states a template's license.
THRESHOLD = 0.8
#: Parts into which the rows of one common line are dealt.
SALTS = 64
#: Notice texts by SPDX name.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
]
#: File names that hold a directory's license, without ending, in lower case.
LICENSE_FILES = ("license", "licence", "copying", "unlicense", "notice")
#: Words are runs of letters; numbers keep their inner dots.
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"


def terms_of(text: str) -> list[str]:
    return sorted(set(re.findall(TERM, text.lower())))


def vocabulary() -> list[str]:
    return sorted({t for _, text in TEMPLATES + TEXTS for t in terms_of(text)})


def line_vocabulary() -> list[str]:
    return sorted({t for _, text in TEMPLATES for t in terms_of(text)})


def _terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(f"({TERM})"), F.lit(1))


def _literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


class Weights:
    """Squared IDF weights of the templates' terms; ``mean`` is the weight of those that no line has."""

    def __init__(self, lines: int, frequency: dict[str, int], mean: float = 1.0):
        self.lines = lines
        self.squared = {t: (math.log((1 + lines) / (1 + frequency[t])) + 1 if frequency.get(t) else mean) ** 2 for t in vocabulary()}

    def idf(self, count: Column) -> Column:
        return F.log((1 + F.lit(self.lines)) / (1 + count)) + 1

    def classes(self) -> list[tuple[float, list[str]]]:
        """The notices' terms by weight: the largest squared weight of each class, and its terms."""
        out: list[tuple[float, list[str]]] = []
        for t in sorted(line_vocabulary(), key=lambda t: (-self.squared[t], t)):
            if not out or self.squared[t] < out[-1][0] * 0.75:
                out.append((self.squared[t], []))
            out[-1][1].append(t)
        return out

    def norm(self, terms: list[str]) -> float:
        return math.sqrt(sum(self.squared[t] for t in terms))

    def anchors(self, threshold: float) -> list[str]:
        """Terms of which a line must have one to reach the threshold with any template."""
        out = set()
        for _, text in TEMPLATES:
            own = sorted(terms_of(text), key=lambda t: (-self.squared[t], t))
            for k in range(len(own) + 1):
                if self.norm(own[k:]) < threshold * self.norm(own) * (1 - 1e-9):
                    out.update(own[:k])
                    break
        return sorted(out)


def document_frequencies(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """term, count: lines of all texts that have the term; "" stands for the line itself."""
    line = texts.select(F.explode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")).alias("line"))
    words = F.array_append(F.array_distinct(_terms(F.col("line"))), F.lit(""))
    return materialise(line.select(F.explode(words).alias("term")).groupBy("term").count(), "line_terms")


def corpus_weights(frequency: DataFrame) -> Weights:
    """The templates' weights and the mean weight of a word of a line."""
    found = {r["term"]: r["count"] for r in frequency.where(F.col("term").isin("", *vocabulary())).collect()}
    weights = Weights(found.pop("", 0), found)
    mean = frequency.where("term <> ''").agg((F.sum(F.col("count") * weights.idf(F.col("count"))) / F.sum("count")).alias("mean")).first()["mean"]
    return Weights(weights.lines, found, 1.0 if mean is None else mean)


def _squared(weights: Weights, terms: Column) -> Column:
    table = F.create_map(*[F.lit(x) for t in line_vocabulary() for x in (t, weights.squared[t])])
    return F.aggregate(F.array_sort(terms), F.lit(0.0), lambda acc, t: acc + F.element_at(table, t))


def notice_bound(words: Column, weights: Weights) -> Column:
    """The best cosine that distinct words could have with a notice if all other words had the least weight, 1."""
    known = F.array_intersect(words, _literal(line_vocabulary()))
    norm = F.sqrt(_squared(weights, known) + F.size(words) - F.size(known))
    dots = [_squared(weights, F.array_intersect(known, _literal(terms_of(text)))) / F.lit(weights.norm(terms_of(text))) for _, text in TEMPLATES]
    return F.when(F.size(words) > 0, F.greatest(*dots) / norm)


def template_terms(spark, weights: Weights) -> DataFrame:
    """(k, license, norm, term) of all templates, of fixed size; whole texts stand behind the notices."""
    rows = [f"{k}|{name}|{weights.norm(terms_of(text))!r}|{t}" for k, (name, text) in enumerate(TEMPLATES + TEXTS) for t in terms_of(text)]
    one = spark.range(1).select(F.explode(F.split(F.lit("\n".join(rows)), "\n")).alias("r")).select(F.split("r", r"\|").alias("c"))
    return one.select(F.col("c")[0].cast("int").alias("k"), F.col("c")[1].alias("license"), F.col("c")[2].cast("double").alias("norm"), F.col("c")[3].alias("term"))


def score_vectors(vectors: DataFrame, frequency: DataFrame, weights: Weights) -> DataFrame:
    """vectors (key, distinct words) -> key and their best license (score, license) as a line and as a whole file, by the corpus' frequencies of all their words."""
    each = vectors.select("key", F.explode("words").alias("term")).join(frequency, "term")
    weighed = each.withColumn("w2", F.pow(weights.idf(F.col("count")), 2))

    def total(w2):
        return F.aggregate(F.array_sort(F.collect_list(w2)), F.lit(0.0), lambda a, x: a + x)

    norms = weighed.groupBy("key").agg(F.sqrt(total("w2")).alias("own"))
    met = weighed.join(F.broadcast(template_terms(vectors.sparkSession, weights)), "term")
    dots = met.groupBy("key", "k", "license", "norm").agg(total("w2").alias("dot")).join(norms, "key")
    # -k: of equal scores the earlier template
    option = F.struct(F.round(F.col("dot") / (F.col("own") * F.col("norm")), 9).alias("score"), (-F.col("k")).alias("k"), "license")
    best = dots.groupBy("key").agg(F.max(F.when(F.col("k") < len(TEMPLATES), option)).alias("line"), F.max(option).alias("whole"))
    return best.select("key", *[F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.score").alias("score"), F.col(f"{c}.license").alias("license"))).alias(c) for c in ("line", "whole")])


def _best(options: Column) -> Column:
    """The struct of highest score, then of the license that sorts first."""
    top = F.array_max(F.transform(options, lambda o: o["score"]))
    return F.array_min(F.transform(F.filter(options, lambda o: o["score"] == top), lambda o: F.struct(o["license"].alias("license"), o["score"].alias("score"))))


def own_licenses(files: DataFrame, frequency: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """files (key, path, text) -> key, path, dir, names_directory, own (license, score)."""
    weights = corpus_weights(frequency)
    anchor = "|".join(map(re.escape, weights.anchors(threshold)))
    pattern = rf"(?i)(?<![a-z])(?:{anchor})(?![a-z])" if anchor else "$^"
    some = F.filter(F.split("text", "\n"), lambda line: F.lower(line).rlike(pattern))
    base = F.lower(F.regexp_extract("path", r"([^/.]*)[^/]*$", 1))
    named = files.select(
        "key", "path", "text", F.regexp_extract(F.coalesce("path", F.lit("")), r"^(.*)/[^/]*$", 1).alias("dir"), base.isin(*LICENSE_FILES).alias("names_directory")
    )
    whole = F.when(F.col("names_directory") & F.col("text").isNotNull(), F.array("text")).otherwise(F.array().cast("array<string>"))

    def vector(unit):
        return F.array_sort(F.array_distinct(_terms(unit)))

    def has_room(words):
        """Whether the notices' words could outweigh the others, by classes of weight."""

        def counted(own):
            return F.size(F.filter(words, lambda x: x.isin(own)))

        known, most = F.lit(0), F.lit(0.0)
        for w, own in weights.classes():
            known, most = known + counted(own), most + w * counted(own)
        return most * (1 / threshold**2 - 1) >= (F.size(words) - known) * (1 - 1e-9)

    def may_reach(words):
        return notice_bound(words, weights) >= threshold - 1e-6

    lines = F.filter(F.filter(F.transform(F.coalesce(some, F.array().cast("array<string>")), vector), has_room), may_reach)

    def unit(words, is_whole: bool):
        # words move under their hash, so that a long text's are not repeated with each of them
        return F.struct(F.sha2(F.array_join(words, " "), 256).alias("key"), words.alias("words"), F.lit(is_whole).alias("whole"))

    units = F.concat(F.transform(lines, lambda w: unit(w, False)), F.transform(F.transform(whole, vector), lambda w: unit(w, True)))
    kept = named.select(F.monotonically_increasing_id().alias("row"), "key", "path", "dir", "names_directory", F.array_distinct(units).alias("near"))
    kept = materialise(kept, "license_lines")
    each = kept.select("row", F.explode("near").alias("unit")).select("row", "unit.key", "unit.words", "unit.whole")
    scored = score_vectors(each.groupBy("key").agg(F.first("words").alias("words")), frequency, weights)
    # a common line's rows are dealt over SALTS tasks
    scored = scored.select("key", F.col("line").alias("by_line"), F.col("whole").alias("by_whole"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = each.drop("words").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(scored, ["key", "salt"])
    option = F.when(F.col("whole"), F.col("by_whole")).otherwise(F.col("by_line"))
    own = met.select("row", option.alias("option")).where(F.col("option.score") >= threshold).groupBy("row").agg(_best(F.collect_list("option")).alias("own"))
    return kept.join(own, "row", "left").select("key", "path", "dir", "names_directory", "own")


def directory_licenses(stated: DataFrame) -> DataFrame:
    """(dir, license) statements -> dir, license: the one stated most often there, then the first by name."""
    counted = stated.groupBy("dir", "license").count()
    ranked = counted.groupBy("dir").agg(F.min(F.struct((-F.col("count")).alias("less"), "license")).alias("first"))
    return ranked.select("dir", F.col("first.license").alias("license"))


def inherit(own: DataFrame, statements: DataFrame) -> DataFrame:
    """own (key, path, dir, own) and (dir, license) statements -> license and the directory it comes from."""
    directories = directory_licenses(statements)
    wanted = own.where("own is null").groupBy("dir").agg(F.count("*").alias("files")).select("dir")
    # "a/b/c" -> a/b/c, a/b, a and the root ""
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    climbed = wanted.select("dir", F.explode(F.array_distinct(above)).alias("ancestor"))
    nearest = (
        climbed.join(directories.withColumnRenamed("dir", "ancestor"), "ancestor")
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("ancestor").alias("depth"), "ancestor", "license")).alias("from"))
    )
    return own.join(nearest, "dir", "left").select(
        "key",
        "path",
        F.col("own.license").alias("own_license"),
        F.col("own.score").alias("own_score"),
        F.coalesce("own.license", "from.license").alias("license"),
        F.when(F.col("own").isNull(), F.col("from.ancestor")).alias("inherited_from"),
    )


def scan(files: DataFrame, threshold: float = THRESHOLD, every_statement: bool = False) -> DataFrame:
    """files (key, path, text) -> key, path, own_license, own_score, license, inherited_from.

    Directories state a license by their license files or, with
    every_statement, by any file directly in them that has one of its own.
    """
    files = files.select("key", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    own = materialise(own_licenses(files, document_frequencies(files), threshold), "licenses")
    states = own.where(F.col("own").isNotNull() & (F.lit(every_statement) | F.coalesce("names_directory", F.lit(False))))
    return inherit(own, states.select("dir", F.col("own.license").alias("license")))


def _oracle() -> str:
    values = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(TEMPLATES + TEXTS))
    return f"""
WITH t(k, license, text) AS (VALUES {values}),
tt AS (SELECT DISTINCT k, license, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM t),
files AS (SELECT doc_id, text, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM (
  SELECT doc_id, text, CASE WHEN doc_id % 1000 = 0 THEN source WHEN doc_id % 100 = 0 THEN concat_ws('/', source, doc_id // 1000)
    ELSE concat_ws('/', source, doc_id // 1000, doc_id // 100) END || CASE WHEN doc_id % 100 = 0 THEN '/LICENSE.' ELSE '/' END || doc_id || '.txt' AS path FROM documents)),
l AS (SELECT doc_id, row_number() OVER () AS line_id, list_distinct(regexp_extract_all(lower(line), '{TERM}')) AS own
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
n AS (SELECT count(*) AS n FROM l),
df AS (SELECT term, count(*) AS c FROM (SELECT unnest(own) AS term FROM l) GROUP BY term),
idf AS (SELECT term, c, ln((1 + n) / CAST(1 + c AS DOUBLE)) + 1 AS w FROM df, n),
mean AS (SELECT coalesce(sum(c * w) / sum(c), 1) AS w FROM idf),
u AS (SELECT doc_id, line_id AS unit, own, false AS whole FROM l UNION ALL SELECT doc_id, -1 - doc_id, list_distinct(regexp_extract_all(lower(text), '{TERM}')), true FROM files WHERE doc_id % 100 = 0 AND text IS NOT NULL),
e AS (SELECT doc_id, unit, whole, unnest(own) AS term FROM u),
unit_norm AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM e JOIN idf USING (term) GROUP BY unit),
tw AS (SELECT tt.k, tt.license, tt.term, coalesce(idf.w, mean.w) AS w FROM tt LEFT JOIN idf USING (term) CROSS JOIN mean),
template_norm AS (SELECT k, any_value(license) AS license, sqrt(sum(w * w)) AS norm FROM tw GROUP BY k),
c AS (SELECT e.doc_id, e.unit, tw.k, sum(tw.w * tw.w) AS dot FROM e JOIN tw USING (term) WHERE e.whole OR tw.k < {len(TEMPLATES)} GROUP BY ALL),
s AS (SELECT c.doc_id, c.unit, c.k, tn.license, round(c.dot / (un.norm * tn.norm), 9) AS score FROM c JOIN unit_norm un USING (unit) JOIN template_norm tn USING (k)),
b AS (SELECT doc_id, unit, max(score) AS score, arg_min(license, (-score, k)) AS license FROM s GROUP BY ALL),
own AS (SELECT doc_id, max(score) AS own_score, arg_min(license, (-score, license)) AS own_license FROM b WHERE score >= {THRESHOLD} GROUP BY doc_id),
f AS (SELECT files.doc_id, files.path, files.dir, own_license, own_score FROM files LEFT JOIN own USING (doc_id)),
st AS (SELECT dir, own_license AS license, count(*) AS c FROM f WHERE own_license IS NOT NULL GROUP BY ALL),
d AS (SELECT dir, arg_min(license, (-c, license)) AS license FROM st GROUP BY dir),
i AS (SELECT f.doc_id, arg_max(d.dir, length(d.dir)) AS inherited_from, arg_max(d.license, length(d.dir)) AS license
  FROM f JOIN d ON f.own_license IS NULL AND (f.dir = d.dir OR starts_with(f.dir, d.dir || '/') OR d.dir = '') GROUP BY f.doc_id)
SELECT f.doc_id, f.path, f.own_license, f.own_score, coalesce(f.own_license, i.license) AS license, i.inherited_from
FROM f LEFT JOIN i USING (doc_id)
"""


#: For the query's paths and statements by any document.
ORACLE = _oracle()
