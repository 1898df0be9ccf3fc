"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then directory inheritance.

Texts are cut into paragraphs at lines without letters and digits. Segments are runs of up to four adjacent pieces of a
paragraph, cut at line and sentence ends, and its whole sentences with their lines joined. A segment is compared with every template as a sparse vector
of term frequency times inverse document frequency; document frequencies are counted over all files. A segment that has
none of the templates' heaviest terms can't reach the threshold (the heaviest terms are chosen so that the rest of
a template has a smaller cosine), so only segments with one of them become vectors. A file's own licence is its best
segment's; a segment that lacks a version number of a statement doesn't count for it. Files that are named as licence files, or consist mostly of a licence statement, give their licence to the
files below their directory that have none; the nearest such directory wins. All of it is DataFrame operations.

Defined results: null text is the empty text, a null path the empty one (in the root directory). Files repeated under
one path are each reported. Ties go to the alphabetically first licence, in a directory to the best score first. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.session import checkpointed

THRESHOLD = 0.6
# Share of a file's characters that makes it a licence file.
STATEMENT = 0.5
# Adjacent pieces that are compared as one segment; sentences are compared whole besides.
ADJACENT = 4
# A term with one HOT-th of all segments' terms is hot.
HOT = 1000
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([-_.].*)?$"

# The usual statements of licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Released to the public domain under CC0 1.0"),
    ("Proprietary", "All rights reserved"),
]


BETWEEN = "[^a-z0-9]+"
# A line end before a line without letters and digits, and what ends a piece or a sentence.
GAP, PIECE_END, SENTENCE_END = r"(?:\r\n?+|\n)[^\p{L}\p{N}\r\n]*+(?=[\r\n])", r"[\r\n]+|(?<=[.!?;])\s+", r"(?<=[.!?;])\s+"
# Signs before and after the words of a line.
SIGNS = r"(?m)^[^\p{L}\p{N}\r\n]++|[*/#>\s-]*+$"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN), lambda t: t != "")


def scan(files: DataFrame, path_column: str = "path", text_column: str = "text",
         templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """path, own licence and score, licence that holds, its origin (own, inherited, none) and the giving directory."""
    spark = files.sparkSession
    rows = files.select(F.coalesce(path_column, F.lit("")).alias("path"), F.coalesce(text_column, F.lit("")).alias("text")) \
        .withColumn("mark", F.xxhash64("text"))
    made = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)],
                                 "template int, licence string, statement string")
    wanted = made.select("template", "licence", F.explode(terms(F.col("statement"))).alias("term")) \
        .groupBy("template", "licence", "term").agg(F.count("*").alias("times")).collect()
    words = sorted({r["term"] for r in wanted})

    # over all files: how many have each term ('' is in all). Only terms of one file are left out, so that a missing one has one.
    files_with = rows.select(F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower("text"), BETWEEN)))).alias("term")) \
        .groupBy("term").agg(F.count("*").alias("files")).filter((F.col("files") > 1) | F.col("term").isin("", *words))
    files_with = checkpointed(files_with)
    counted = {r["term"]: r["files"] for r in files_with.filter(F.col("term").isin("", *words)).collect()}
    total = counted.get("", 0)
    idf = {w: math.log((1 + total) / (1 + counted.get(w, 0))) + 1 for w in words}
    weights: dict[int, dict[str, float]] = {}
    names = {}
    for r in wanted:
        weights.setdefault(r["template"], {})[r["term"]] = r["times"] * idf[r["term"]]
        names[r["template"]] = r["licence"]
    cues = set()
    for vector in weights.values():
        norm = math.sqrt(sum(w * w for w in vector.values()))
        rest = dict(vector)
        while math.sqrt(sum(w * w for w in rest.values())) >= threshold * norm:
            heaviest = max(rest, key=lambda t: (rest[t], t))
            cues.add(heaviest)
            del rest[heaviest]
    # one row per template and term, as many as the statements have words, and one per version written as v3
    parts = []
    for t, v in weights.items():
        norm = math.sqrt(sum(x * x for x in v.values()))
        versions = [term for term in v if term.isdigit() and term != "0"]
        parts += [(t, names[t], term, w / norm, term if term in versions else None, len(versions)) for term, w in v.items()]
        parts += [(t, names[t], "v" + term, 0.0, term, len(versions)) for term in versions]
    vectors = spark.createDataFrame(
        parts, "template int, licence string, term string, part double, version string, versions int")

    def has_cue(text: Column) -> Column:
        return F.arrays_overlap(F.split(F.lower(text), BETWEEN), F.array(*map(F.lit, sorted(cues))))

    paragraphs = rows.filter(has_cue(F.col("text"))).distinct() \
        .select("path", "mark", F.length("text").alias("chars"), F.posexplode(F.split("text", GAP)).alias("at", "paragraph")) \
        .filter(has_cue(F.col("paragraph")))
    pieces = F.filter(F.split("paragraph", PIECE_END), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    runs = F.flatten(F.transform(
        F.filter(F.sequence(F.lit(1), F.size("pieces")), lambda i: F.exists(F.slice("cued", i, ADJACENT), lambda x: x)),
        lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(ADJACENT), F.size("pieces") - i + 1)),
                              lambda n: F.array_join(F.slice("pieces", i, n), " "))))
    sentences = F.split(F.regexp_replace(F.regexp_replace("paragraph", SIGNS, ""), r"[\r\n]+", " "), SENTENCE_END)
    segments = paragraphs.withColumn("pieces", pieces).withColumn("cued", F.transform("pieces", has_cue)) \
        .select("path", "mark", "chars", "at", F.posexplode(F.array_distinct(F.concat(runs, sentences))).alias("nth", "segment")) \
        .filter(has_cue(F.col("segment"))) \
        .select("path", "mark", "chars", (F.shiftleft(F.col("at").cast("bigint"), 32) + F.col("nth")).alias("place"), "segment")
    segments = checkpointed(segments.withColumn("found", terms(F.col("segment"))))
    tf = checkpointed(segments.select("path", "mark", "place", F.explode("found").alias("term"))
                      .groupBy("path", "mark", "place", "term").agg(F.count("*").alias("times")))
    rarity = checkpointed(tf.groupBy("term").agg(F.count("*").alias("uses")).join(files_with, "term", "left").select(
        "term", "uses", (F.log((1 + total) / (1 + F.coalesce("files", F.lit(1)))) + 1).alias("idf")))
    # terms of a thousandth of the rows or more, at most 1000, are broadcast: no key of the other join is hot
    hot = F.col("uses") * HOT >= (rarity.agg(F.sum("uses")).first()[0] or 0)
    tf = tf.join(F.broadcast(rarity.filter(hot).drop("uses")), "term", "left")
    tf = tf.filter("idf is not null").unionByName(
        tf.filter("idf is null").drop("idf").join(rarity.filter(~hot).drop("uses"), "term"))
    tf = tf.withColumn("weight", F.col("times") * F.col("idf"))
    norms = tf.groupBy("path", "mark", "place").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = tf.join(F.broadcast(vectors), "term").groupBy("path", "mark", "place", "template", "licence") \
        .agg(F.sum(F.col("weight") * F.col("part")).alias("dot"),
             (F.count_distinct("version") == F.first("versions")).alias("held"))
    best = dots.join(norms, ["path", "mark", "place"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)) \
        .filter(F.col("held") & (F.col("score") >= threshold))
    lengths = segments.select("path", "mark", "place", (F.length("segment") / F.greatest("chars", F.lit(1))).alias("share"))
    own = checkpointed(best.join(lengths, ["path", "mark", "place"]).groupBy("path", "mark").agg(
        F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), "licence")).alias("own"),
        F.max("share").alias("share")))

    folder = F.regexp_replace("path", "/?[^/]*$", "")
    is_file = F.regexp_extract("path", "([^/]*)$", 1).rlike(FILE_NAMES) | (F.col("share") >= STATEMENT)
    given = own.filter(is_file).withColumn("folder", folder).groupBy("folder") \
        .agg(F.min_by("own", F.struct(-F.col("own.score"), "own.licence")).alias("given"))
    folders = rows.select(folder.alias("start")).distinct()
    # every directory meets its ancestors, not every file
    parts = F.split("start", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    climbed = folders.select("start", F.posexplode(F.array_distinct(ancestors)).alias("depth", "folder"))
    nearest = climbed.join(given, "folder").groupBy("start").agg(
        F.max_by(F.struct("folder", "given"), "depth").alias("near"))
    return rows.select("path", "mark", folder.alias("start")).join(own.drop("share"), ["path", "mark"], "left") \
        .join(nearest, "start", "left").select(
        F.col("path").alias(path_column), F.col("own.licence").alias("own_licence"), F.col("own.score").alias("own_score"),
        F.coalesce("own.licence", "near.given.licence").alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own").isNull(), F.col("near.folder")).alias("from_folder"))
