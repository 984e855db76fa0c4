"""Operator 4: licence scans (DataFrame functions only).

Three kinds of units are compared with licence templates by the cosine of
sparse TF-IDF vectors: every line with short notices (``TEMPLATES``), every
block of comment or text lines (``blocks_of``) with licence headers, and
every licence file as a whole with whole licence texts. Inverse document
frequencies are those of the unit's template collection, and a term no
template has weighs most (so prose around a licence sentence lowers the
cosine). A file's own licence is its best unit's template, if that reaches
``MIN_COSINE``; a whole text goes before a block of several lines, and that before
a line, as a line of a header may name another licence or none (``All rights
reserved.``). A file without one inherits the licence of the
nearest ancestor directory that holds a licence file (``LICENSE*``,
``LICENCE*``, ``COPYING*``) with a licence of its own.

Pruning is exact. A unit without any of a template's heavier terms cannot
reach the threshold with it when the terms left out hold less than its square
of the template's squared length (prefix filtering); the terms left out are
common English words first (``COMMON``), so that prose has few of those kept.
Texts, lines and blocks without a kept term of any template go. Then the known
terms' share of a unit's squared length bounds its cosine (Cauchy-Schwarz):
one walk over its sorted words gives both. Only the distinct texts of the units left are
exploded into terms and scored; a notice in very many files is scored once.
Directories are reduced to distinct ones before their ancestors are joined, so
a directory with very many files is one row there; the joins back use a
broadcast only below ``BROADCAST_ROWS`` counted rows.

Edge cases: null text has no lines; a row with a null path is a file of its own
without directory, scanned like any other; rows repeating a path are one file
(their units are pooled, each row is returned); equal cosines go to the
licence first by code point; an empty table gives an empty result; other
columns pass through (one named like an output is replaced).
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogset.llm.common import broadcast_if, let, text_or_empty
from dialogset.llm.decontaminate import words_of
from dialogset.llm.licence_texts import HEADERS, full_texts
from dialogset.session import pin

# fixed values: short standard notices by licence
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
]
# fixed values: common English words, which say little about a licence
COMMON = frozenset(
    "a all an and any are as at be by can for from has have if in is it its may more no not of on one or other shall "
    "such that the their then there these they this to under use was which who will with without work would you your 0 1 2 3 4".split()
)
MIN_COSINE = 0.75
BROADCAST_ROWS = 200_000
# what a licence is found in, the surest first
WHOLE, BLOCK, LINE = 0, 1, 2
COMMENT_LINE = r"^[\x20\x09]*(//|#|;|--|%|!|<!--|(?i:dnl|rem)\b|\.\\\")"
COMMENT = r"(?s)/\*.*?\*/|<!--.*?-->|\"{3}.*?\"{3}|'{3}.*?'{3}"
LICENCE_FILE = r"(?i)^(licen[sc]e|copying)([.\-_].*)?$"


def _terms(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


class Weights:
    """TF-IDF vectors of the templates."""

    def __init__(self, templates):
        bags = [Counter(_terms(t)) for _, t in templates]
        df = Counter(term for bag in bags for term in bag)
        self.unknown = math.log(1 + len(bags)) + 1
        self.idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in sorted(df.items())}
        self.rows, lengths, vectors = [], [], []
        for i, ((licence, _), bag) in enumerate(zip(templates, bags)):
            v = {t: n * self.idf[t] for t, n in bag.items()}
            length = math.sqrt(sum(w * w for w in v.values()))
            vectors.append(v)
            lengths.append(length)
            self.rows += [(i, licence, t, w / length) for t, w in sorted(v.items())]
        self.vectors, self.lengths = vectors, lengths

    def signature(self, least: float) -> list[str]:
        """Terms of which a unit must hold one to reach cosine ``least``."""
        kept: set[str] = set()
        for v, n in zip(self.vectors, self.lengths):
            left_out = 0.0
            for t in sorted(v, key=lambda t: (t not in COMMON, self.idf[t], t)):
                left_out += (v[t] / n) ** 2
                if left_out >= least * least - 1e-9:
                    kept.add(t)
        return sorted(kept)


def _texts(terms) -> Column:
    """One literal for many terms (which hold no blanks)."""
    return F.split(F.lit(" ".join(terms)), " ")


def _may_reach(words: Column, w: Weights, least: float) -> Column:
    """Whether the share of known terms in a unit's length allows ``least``.

    Over the sorted words, the r-th copy of a term adds 2 r - 1 to the square
    of its count, so one walk gives the squared lengths."""
    classes: dict[float, list[str]] = {}
    for t, x in w.idf.items():
        classes.setdefault(x, []).append(t)
    zero = F.lit(0.0)

    def square(x: Column) -> Column:
        out = F.when(~x.isin(*w.idf), zero)
        # common terms first; the last class needs no test
        *tested, last = sorted(classes)
        for idf in tested:
            out = out.when(x.isin(*classes[idf]), F.lit(idf * idf))
        return out.otherwise(F.lit(last * last))

    def step(acc: Column, x: Column) -> Column:
        again = x == acc["word"]
        run = F.when(again, acc["run"] + 1).otherwise(F.lit(1))
        known = F.when(again, acc["square"]).otherwise(square(x))
        more = (2 * run - 1).cast("double")
        unknown = F.when(known == 0, more * F.lit(w.unknown**2)).otherwise(zero)
        return F.struct(
            x.alias("word"), run.alias("run"), known.alias("square"), (acc["known"] + more * known).alias("known"), (acc["rest"] + unknown).alias("rest")
        )

    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), zero.alias("square"), zero.alias("known"), zero.alias("rest"))
    bound = least * least - 1e-6
    return F.aggregate(F.sort_array(words), start, step, lambda acc: acc["known"] > bound * (acc["known"] + acc["rest"]))


def _runs(lines: Column, kinds: Column) -> Column:
    """The runs of neighbouring lines of one kind: (text, several lines)."""

    def cut(starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines)))
        return F.zip_with(
            starts, ends, lambda a, b: F.struct(F.array_join(F.slice(lines, a + 1, b - a), "\n").alias("text"), (b - a > 1).alias("several"))
        )

    none = F.expr("cast(array() as array<struct<text: string, several: boolean>>)")
    first = F.filter(F.transform(kinds, lambda k, i: F.when((i == 0) | (k != F.get(kinds, i - 1)), i)), lambda i: i.isNotNull())
    return F.when(F.size(lines) > 0, let(first, cut)).otherwise(none)


def blocks_of(text: Column) -> Column:
    """Where a header may stand: runs of comment lines or of text lines, parted
    by lines without a word, by blank lines, and not parted by blank lines;
    and comments between their marks, whatever lines they have."""
    comment = lambda x: x.rlike(COMMENT_LINE).cast("int")
    worded = lambda x: x.rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")
    filled = lambda x: x.rlike(r"[^\x20\x09-\x0D]")

    def runs(lines: Column, full: Column) -> Column:
        def parted(test) -> Column:
            kinds = F.transform(lines, lambda x: F.when(test(x), comment(x)).otherwise(F.lit(-1)))
            return let(kinds, lambda k: _runs(lines, k))

        whole = let(F.transform(full, comment), lambda k: _runs(full, k))
        spans = F.transform(F.regexp_extract_all(text, F.lit(COMMENT), F.lit(0)), lambda c: F.struct(c.alias("text"), c.contains("\n").alias("several")))
        return F.array_distinct(F.concat(parted(worded), parted(filled), whole, spans))

    return let(F.split(text, "\n"), lambda lines: let(F.filter(lines, filled), lambda full: runs(lines, full)))


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from one literal (no Python workers)."""
    fields = [f.split() for f in schema.split(", ")]
    cells = F.split(F.col("row"), "\t")
    lines = F.lit("\n".join("\t".join(map(str, r)) for r in rows))
    return spark.range(1).select(F.explode(F.split(lines, "\n")).alias("row")).select(*[cells[i].cast(kind).alias(name) for i, (name, kind) in enumerate(fields)])


def _found(units: DataFrame, w: Weights, least: float, name: str) -> DataFrame:
    """file, rank, license, score of the units (file, rank, words) that reach ``least``."""
    spark = units.sparkSession
    units = pin(units.withColumn("unit", F.sha2(F.array_join("words", " "), 256)), name)
    idf = F.broadcast(_rows(spark, list(w.idf.items()), "term string, idf double"))  # the terms of the templates
    texts = units.groupBy("unit").agg(F.first("words").alias("words"))  # equal texts are scored once
    terms = texts.select("unit", F.explode("words").alias("term")).groupBy("unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = terms.join(idf, "term", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.lit(w.unknown)))
    known = F.broadcast(_rows(spark, w.rows, "template int, license string, term string, share double"))
    norms = terms.groupBy("unit").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = terms.where(F.col("idf").isNotNull()).join(known, "term").groupBy("unit", "template", "license").agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    scored = dots.join(norms, "unit").select("unit", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = scored.where(F.col("score") >= least).groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    best = pin(best.select("unit", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score")), f"{name}-scored")
    return units.select("unit", "file", "rank").join(broadcast_if(best, best.count(), BROADCAST_ROWS), "unit").drop("unit")


def _file(path: Column, text: Column) -> Column:
    """What a file is known by: its path; without one, its text."""
    return F.coalesce(path, F.concat(F.lit("\0"), F.sha2(text, 256)))


def own_licences(files: DataFrame, templates=None, least: float = MIN_COSINE) -> DataFrame:
    """path, own_license, own_score for the files of which a whole licence
    text, a block or a line reaches ``least`` (a null path's ``path`` is a hash of its text)."""
    text = text_or_empty("text")
    files = files.select(_file(F.col("path"), text).alias("file"), text.alias("text"), F.col("path").isNotNull().alias("located"))

    def holding(rows: DataFrame, words: Column, w: Weights) -> DataFrame:
        return rows.where(F.arrays_overlap(words, _texts(w.signature(least))))

    def units(rows: DataFrame, rank: Column, text: Column, w: Weights) -> DataFrame:
        rows = holding(rows.select("file", rank.alias("rank"), words_of(text).alias("words")), F.col("words"), w)
        return rows.where(_may_reach(F.col("words"), w, least))

    short, headers, full = Weights(templates or TEMPLATES), Weights(HEADERS), Weights(full_texts())
    lines = holding(files, words_of(text), short).select("file", F.explode(F.split("text", "\n")).alias("line"))
    found = _found(units(lines, F.lit(LINE), F.col("line"), short), short, least, "license-lines")

    blocks = holding(files, words_of(text), headers).select("file", F.inline(blocks_of(F.col("text"))))
    # a block of one line is no more than that line
    rank = F.when(F.col("several"), F.lit(BLOCK)).otherwise(F.lit(LINE))
    found = found.unionByName(_found(units(blocks, rank, F.col("text"), headers), headers, least, "license-blocks"))

    named = files.where(F.col("located") & F.element_at(F.split("file", "/"), -1).rlike(LICENCE_FILE))
    found = found.unionByName(_found(units(named, F.lit(WHOLE), F.col("text"), full), full, least, "license-whole"))

    best = F.min(F.struct("rank", (-F.col("score")).alias("s"), "license"))
    return found.groupBy("file").agg(best.alias("b")).select(F.col("file").alias("path"), F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score"))


def _directory(path: Column) -> Column:
    """The path without its last part; the root is the empty text."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(directory: Column) -> Column:
    """(directory, depth) of a directory and all above it, to the root."""
    parts = F.split(directory, "/")
    n = F.when(directory == "", F.lit(0)).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("above"), k.alias("depth")))


def scan(files: DataFrame, templates=None, least: float = MIN_COSINE) -> DataFrame:
    """``files`` (path, text, ...) plus own_license, own_score, license,
    license_from (header, inherited or none) and origin (the licence file's
    directory)."""
    files = files.drop("own_license", "own_score", "license", "license_from", "origin")
    own = pin(own_licences(files, templates, least), "license-own")
    n_own = own.count()
    named = own.withColumn("dir", _directory(F.col("path"))).where(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE))
    best = F.min(F.struct((-F.col("own_score")).alias("s"), "own_license"))
    held = pin(named.groupBy("dir").agg(best.alias("b")).select(F.col("dir").alias("above"), F.col("b.own_license").alias("dir_license")), "license-dirs")
    n_held = held.count()

    dirs = files.where(F.col("path").isNotNull()).select(_directory(F.col("path")).alias("dir")).distinct()
    lines = dirs.select("dir", F.inline(ancestors(F.col("dir"))))
    resolved = (
        lines.join(broadcast_if(held, n_held, BROADCAST_ROWS), "above")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "above", "dir_license")).alias("r"))
        .select(F.col("dir").alias("__dir"), F.col("r.above").alias("__above"), F.col("r.dir_license").alias("__inherited"))
    )
    resolved = pin(resolved, "license-resolved")
    n_resolved = resolved.count()
    own = own.select(F.col("path").alias("__path"), F.col("own_license").alias("__own"), F.col("own_score").alias("__score"))
    joined = files.join(broadcast_if(own, n_own, BROADCAST_ROWS), _file(files["path"], text_or_empty(files["text"])) == F.col("__path"), "left").join(
        broadcast_if(resolved, n_resolved, BROADCAST_ROWS), _directory(files["path"]) == F.col("__dir"), "left"
    )
    header, above = F.col("__own").isNotNull(), F.col("__inherited").isNotNull()
    return joined.select(
        *[files[c] for c in files.columns],
        F.col("__own").alias("own_license"),
        F.col("__score").alias("own_score"),
        F.coalesce("__own", "__inherited").alias("license"),
        F.when(header, "header").when(above, "inherited").otherwise("none").alias("license_from"),
        F.when(~header & above, F.col("__above")).alias("origin"),
    )


def files_of(docs: DataFrame) -> DataFrame:
    """The documents as files of source trees, derived from their ids: each
    source has repositories of 2000 consecutive ids with packages of 100; the
    first 20 ids of a repository and of a package name their licence files."""
    i = F.col("doc_id")
    repo = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("none")), F.concat(F.lit("repo"), F.floor(i / 2000).cast("string")))
    pkg = F.concat(F.lit("pkg"), F.floor(i / 100).cast("string"))
    path = (
        F.when(i % 2000 < 20, F.concat(repo, F.lit("/LICENSE")))
        .when(i % 100 < 20, F.concat_ws("/", repo, pkg, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", repo, pkg, F.concat(F.lit("file"), i.cast("string"), F.lit(".txt"))))
    )
    return docs.select("doc_id", "text", path.alias("path"))
