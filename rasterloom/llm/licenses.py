"""Licence scan: TF-IDF cosine of header lines to templates, inherited down directories.

A header line is a line or sentence that holds one of the templates' anchor words.  Its terms
are weighted by term frequency and by inverse document frequency over all rows, terms outside the
templates count with weight 1, and the nearest template at ``THRESHOLD`` or more is its licence.
A file without a licence takes that of the nearest ancestor directory that has a licence file.
Everything is DataFrame functions.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, table, unused, written

THRESHOLD = 0.6
BROADCAST_DIRECTORIES = 100_000
FILES_A_PART = 1_000_000  # input files for each written part of the directories' table, which has a row for a directory at most
SALTS = 32
SHORT, SHORTER, NOTICE = 1000, 500, 2000  # characters: of the query's folders, and of a text that may be a licence notice
# fixed values: licence templates, shortened to their identifying sentence
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted; BSD license",
    "CC-BY-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, v. 2.0",
    "Proprietary": "Copyright, all rights reserved",
}
ANCHORS = r"licen[sc]e|copyright|redistribution|rights reserved|creative commons"
NOT_TERM = r"[^a-z0-9.-]+"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)([.-][^/]*)?$"


def terms(text: str) -> list[str]:
    import re

    return [w for w in (x.strip(".-") for x in re.split(NOT_TERM, text.lower())) if w]


VECTORS = {name: Counter(terms(text)) for name, text in TEMPLATES.items()}
VOCABULARY = sorted({t for v in VECTORS.values() for t in v})


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def header_lines(text: Column) -> Column:
    """Array of the lines and sentences that hold an anchor word, lower-cased; tags end a line too."""
    broken = F.regexp_replace(F.regexp_replace(ascii_lower(text), r"<[^>]*>", "\n"), r"([.!?])\s+", "$1\n")
    return F.when(F.lower(text).rlike(ANCHORS), F.filter(F.split(broken, "\n"), lambda x: x.rlike(ANCHORS))).otherwise(F.array().cast("array<string>"))


def line_terms(line: Column, words: Column | None = None) -> Column:
    return F.filter(F.transform(F.split(line, NOT_TERM) if words is None else words, lambda w: F.regexp_replace(w, r"^[.-]+|[.-]+$", "")), lambda w: w != "")


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, dict[str, int]]:
    """Rows, and rows whose text holds each template term: one aggregate over all rows."""
    low = ascii_lower(F.col(text_col))
    held = F.array_intersect(line_terms(low, F.array_distinct(F.split(low, NOT_TERM))), _strings(VOCABULARY))
    counts = [F.coalesce(F.sum(F.array_contains("held", t).cast("long")), F.lit(0)).alias(f"t{k}") for k, t in enumerate(VOCABULARY)]
    row = docs.select(held.alias("held")).agg(F.count("*").alias("n"), *counts).first()
    return row["n"], {t: row[f"t{k}"] for k, t in enumerate(VOCABULARY)}


def _projected(scaled: Column):
    """The step that adds a counted term's share of the dot product with one template."""

    def step(total: Column, x: Column) -> Column:
        return total + x["n"] * F.coalesce(x["i"] * F.try_element_at(scaled, x["w"]), F.lit(0.0))

    return step


def _best(words: Column, idf: dict[str, float]) -> Column:
    """Struct (score, name) of the nearest template; ties go to the first name."""
    weight = F.create_map(*(F.lit(x) for t in VOCABULARY for x in (t, idf[t])))
    # distinct terms with their counts, once per line
    counted = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("w"), F.size(F.filter(words, lambda x: x == w)).cast("double").alias("n"), F.try_element_at(weight, w).alias("i")))
    norm2 = F.aggregate(counted, F.lit(0.0), lambda a, x: a + F.pow(x["n"] * F.coalesce(x["i"], F.lit(1.0)), F.lit(2.0)))
    scores = []
    for name, vector in sorted(VECTORS.items()):
        own = math.sqrt(sum((n * idf[t]) ** 2 for t, n in vector.items()))
        scaled = F.create_map(*(F.lit(x) for t, n in sorted(vector.items()) for x in (t, n * idf[t] / own)))
        dot = F.aggregate(counted, F.lit(0.0), _projected(scaled))
        scores.append(F.struct(F.round(dot / F.sqrt(norm2), 6).alias("score"), F.lit(name).alias("name")))
    return F.reduce(F.array(*scores), F.struct(F.lit(0.0).alias("score"), F.lit("").alias("name")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))


def parent(path: Column) -> Column:
    """Directory of a path, '' at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, path_col: str, text_col: str, is_licence_file: Column | None = None) -> DataFrame:
    """``files`` with ``own_licence, own_score, inherited_licence, inherited_from, licence`` added.

    One row per input row, repeated rows too.  Null and empty texts state nothing; a null path
    inherits nothing.  A file is a licence file when ``is_licence_file`` holds (by default by
    its name) and it states a licence; of several in a directory the best score counts, then the
    first path, then the first name; of a text's own lines the best score, then the first line, then the first
    name.  Whole texts are read.  An empty table gives no rows.  Input columns of the added names are replaced.
    """
    added = ("own_licence", "own_score", "inherited_licence", "inherited_from", "licence")
    files = files.drop(*(c for c in files.columns if c.lower() in added and c not in (path_col, text_col)))
    total, held = document_frequencies(files, text_col)
    idf = {t: math.log((1 + total) / (1 + n)) + 1.0 for t, n in held.items()}
    best, where = unused(files, "best", "in_directory")
    # a filter over a transform: the scan and the scoring stay in one stage, with no shuffle
    scored = F.transform(header_lines(F.col(text_col)), lambda line: _best(line_terms(line), idf))
    top = F.aggregate(F.filter(scored, lambda x: x["score"] >= THRESHOLD), F.struct(F.lit(0.0).alias("score"), F.lit("").alias("name")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    rows = files.withColumn(best, top)
    stated = F.col(f"{best}.name") != ""
    rows = rows.withColumns({"own_licence": F.when(stated, F.col(f"{best}.name")), "own_score": F.when(stated, F.col(f"{best}.score")), where: parent(F.col(path_col))}).drop(best)

    rule = F.col(path_col).rlike(LICENCE_FILE) if is_licence_file is None else is_licence_file
    declared = (
        rows.where(rule & F.col("own_licence").isNotNull() & F.col(path_col).isNotNull())
        .groupBy(F.col(where).alias("d"))
        .agg(F.min(F.struct(-F.col("own_score"), F.col(path_col), F.col("own_licence").alias("l"))).alias("x"))
        .select("d", F.col("x.l").alias("l"))
    )
    # ancestors are enumerated once per directory, not once per file
    parts = F.split("d", "/")
    prefix = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ancestors = rows.where(F.col(where).isNotNull()).select(F.col(where).alias("d")).distinct().select(F.col("d").alias("child"), F.explode(F.array_distinct(prefix)).alias("d"))
    nearest = ancestors.join(declared, "d").groupBy("child").agg(F.max_by(F.struct("d", "l"), F.length("d")).alias("x"))
    # written: the texts are scored once for it and once for the result; few rows, so not a part for each shuffle partition
    nearest = nearest.select(F.col("child").alias(where), F.col("x.l").alias("inherited_licence"), F.col("x.d").alias("inherited_from"))
    nearest = written(nearest.repartition(max(1, math.ceil(total / FILES_A_PART))), "nearest-licences")
    if nearest.count() <= BROADCAST_DIRECTORIES:
        out = rows.join(F.broadcast(nearest), where, "left")
    else:  # a directory may hold a third of all files
        salt = unused(files, "salt")[0]
        spread = nearest.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn(salt, F.pmod(F.xxhash64(path_col, text_col), F.lit(SALTS)).cast("int")).join(spread, [where, salt], "left").drop(salt)
    return out.withColumn("licence", F.coalesce("own_licence", "inherited_licence")).select(*files.columns, *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in folders of three depths: the shortest texts at source, short ones at source/lang, the rest at source/lang/digits of their length.

    The tables hold no licence files; a text of at most ``NOTICE`` characters that states a licence stands for
    the licence file of its folder and of those below it.
    """
    docs = table(spark, sf_dir, "documents")
    size = F.length(F.coalesce("text", F.lit("")))
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    deep = F.concat(F.lit("n"), F.length(size.cast("string")).cast("string"))
    folder = F.when(size <= SHORTER, source).when(size <= SHORT, F.concat_ws("/", source, lang)).otherwise(F.concat_ws("/", source, lang, deep))
    files = docs.select("doc_id", "text", F.concat_ws("/", folder, F.col("doc_id").cast("string")).alias("path"))
    found = scan(files, "path", "text", size <= NOTICE)
    return found.select("doc_id", "own_licence", "own_score", "inherited_licence", "inherited_from", "licence")


def _values(rows: list[str]) -> str:
    return ", ".join(rows)


ORACLE = f"""
WITH vec(name, term, tf) AS (VALUES {_values([f"('{n}', '{t}', {c})" for n, v in VECTORS.items() for t, c in v.items()])}),
voc AS (SELECT DISTINCT term FROM vec),
placed AS (SELECT *, length(coalesce(text, '')) AS size, CASE WHEN length(coalesce(text, '')) <= {SHORTER} THEN coalesce(source, 'none')
    WHEN length(coalesce(text, '')) <= {SHORT} THEN coalesce(source, 'none') || '/' || coalesce(lang, 'none')
    ELSE coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/n' || length(CAST(length(text) AS VARCHAR)) END AS dir FROM documents),
low AS (SELECT doc_id, dir, size, dir || '/' || doc_id AS path,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM placed),
held AS (SELECT DISTINCT doc_id, regexp_replace(w, '^[.-]+|[.-]+$', '', 'g') AS term
    FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '{NOT_TERM}')) AS w FROM low)),
idf AS (SELECT voc.term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(held.doc_id))) + 1.0 AS idf
    FROM voc LEFT JOIN held USING (term) GROUP BY voc.term),
lines AS (SELECT doc_id, row_number() OVER () AS line, x FROM (
    SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(t, '<[^>]*>', chr(10), 'g'), '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS x
    FROM low WHERE regexp_matches(t, '{ANCHORS}')) WHERE regexp_matches(x, '{ANCHORS}')),
words AS (SELECT doc_id, line, term, count(*) AS n FROM (
    SELECT doc_id, line, regexp_replace(w, '^[.-]+|[.-]+$', '', 'g') AS term
    FROM (SELECT doc_id, line, unnest(regexp_split_to_array(x, '{NOT_TERM}')) AS w FROM lines)) WHERE term <> '' GROUP BY ALL),
norms AS (SELECT line, sqrt(sum(pow(n * coalesce(idf, 1.0), 2))) AS nl FROM words LEFT JOIN idf USING (term) GROUP BY line),
tnorm AS (SELECT name, sqrt(sum(pow(tf * idf, 2))) AS nt FROM vec JOIN idf USING (term) GROUP BY name),
cosines AS (SELECT doc_id, line, name, round(sum(n * idf * tf * idf) / min(nl * nt), 6) AS score
    FROM words JOIN idf USING (term) JOIN vec USING (term) JOIN norms USING (line) JOIN tnorm USING (name) GROUP BY doc_id, line, name),
best AS (SELECT doc_id, name, score FROM cosines WHERE score >= {THRESHOLD}
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line, name) = 1),
own AS (SELECT low.doc_id, dir, size, path, name, score FROM low LEFT JOIN best USING (doc_id)),
declared AS (SELECT dir, name FROM own WHERE size <= {NOTICE} AND name IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, name) = 1)
SELECT doc_id, own.name AS own_licence, score AS own_score, coalesce(a.name, b.name, c.name) AS inherited_licence,
    coalesce(a.dir, b.dir, c.dir) AS inherited_from, coalesce(own.name, a.name, b.name, c.name) AS licence
FROM own LEFT JOIN declared a ON own.dir = a.dir LEFT JOIN declared b ON regexp_replace(own.dir, '/[^/]*$', '') = b.dir AND own.dir <> b.dir
LEFT JOIN declared c ON regexp_replace(own.dir, '/[^/]*/[^/]*$', '') = c.dir AND own.dir <> c.dir
"""
