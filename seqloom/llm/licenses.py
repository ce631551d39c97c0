"""License scan by diagonal voting (operator 9), on DataFrame functions only.

All rolling pairs of words of every text are joined, by hash and then by the words themselves, to
the pairs of the license templates. A hit at text place p and template place t votes for diagonal
p - t; neighbouring diagonals (words inserted or left out) are merged into a span. A span is verified:
each template place counts once, at its first hit, and only as far as the hits stand in the template's
order; it counts where enough of the template's pairs are left. A base phrase counts where one diagonal holds
all of its pairs, which is where its words stand consecutively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, small

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrase and label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Opening words of well-known licenses and grants, lower-cased words only, and label.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under a creative commons attribution", "cc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Share of a template's pairs that a span must hold; diagonals at most SHIFT apart are merged.
COVERAGE, SHIFT = 0.8, 3
#: Template pairs that may be broadcast; with more, the join is shuffled.
MAX_BROADCAST_PAIRS = 500_000
_SENTINEL = 0


def template_pairs(spark: SparkSession, base: tuple = BASE, templates: tuple = TEMPLATES) -> DataFrame:
    """One row for each word pair of each template; base phrases have base = true. Phrases need two words at least."""
    rows = [(k, label, is_base, phrase) for k, (phrase, label, is_base) in enumerate([*((*x, True) for x in base), *((*x, False) for x in templates)])]
    values = F.array(*(F.struct(F.lit(k).alias("tid"), F.lit(label).alias("label"), F.lit(b).alias("base"), F.split(F.lit(p), " ").alias("w")) for k, label, b, p in rows))
    told = spark.range(1).select(F.explode(values).alias("t")).select("t.*")
    pairs = told.select("tid", "label", "base", (F.size("w") - 1).alias("n_pairs"), F.posexplode(F.expr("zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w)), (a, b) -> struct(a, b))")).alias("tpos", "p"))
    return pairs.select("tid", "label", "base", "n_pairs", "tpos", F.xxhash64("p.a", "p.b").alias("h"), F.col("p.a").alias("ta"), F.col("p.b").alias("tb"))


def scan_spans(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of (row, doc_id, n_words) with, for each span found, tid, label, base, first_word, end_word, coverage; every row of docs appears (its own entry has tid -1).

    coverage is the share of the template's pairs that the span holds; in the template's order, where it is enough for the span to count.

    docs: doc_id, text (other columns are not read); a null text counts as empty. Words are ASCII
    letters (A-Z lower-cased), digits and everything beyond ASCII. Repeated rows are scanned each on its own.
    """
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(TOKEN), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("w"))
    rolling = "zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, size(w)), (a, b) -> struct(xxhash64(a, b) as h, a, b))"
    # the pairs are made before they are unfolded: otherwise every pair would carry a copy of all words
    paired = rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.expr(f"concat(array(struct({_SENTINEL}L as h, '' as a, '' as b)), {rolling})").alias("pairs"))
    grams = paired.select("row", "doc_id", "n_words", F.posexplode("pairs").alias("pos", "g"))
    # the row's own entry, so that one pass over the texts serves n_words and the hits
    sentinel = pairs.sparkSession.range(1).selectExpr("-1 as tid", "'' as label", "false as base", "0 as n_pairs", "0 as tpos", f"{_SENTINEL}L as h", "'' as ta", "'' as tb")
    known = small(pairs.union(sentinel), MAX_BROADCAST_PAIRS)
    hits = grams.select("row", "doc_id", "n_words", (F.col("pos") - 1).alias("pos"), F.col("g.h").alias("h"), F.col("g.a").alias("a"), F.col("g.b").alias("b")).join(known, "h").where("a = ta and b = tb")
    template = ["row", "doc_id", "n_words", "tid", "label", "base", "n_pairs"]
    votes = hits.groupBy(*template, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_list("tpos").alias("places"))
    in_order = Window.partitionBy("row", "tid").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(in_order) > SHIFT) | (F.col("first") - F.lag("last").over(in_order) > SHIFT + 1)
    merged = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(in_order))
    # each template place once, at its first hit: at most as many as the template has pairs
    single = merged.select(*template, "span", "diagonal", "first", "last", F.explode("places").alias("tpos")).groupBy(*template, "span", "tpos")
    single = single.agg(F.min(F.col("diagonal") + F.col("tpos")).alias("pos"), F.min("first").alias("first"), F.max("last").alias("last"))
    spans = single.groupBy(*template, "span").agg(F.array_sort(F.collect_list(F.struct("tpos", "pos"))).alias("found"), F.min("first").alias("first_word"), (F.max("last") + 1).alias("end_word"))
    enough = F.size("found") >= F.col("n_pairs") * COVERAGE
    kept = F.when(enough, _longest_in_order(F.col("found"))).otherwise(F.size("found"))
    return spans.select("row", "doc_id", "n_words", "tid", "label", "base", F.col("first_word").cast("long").alias("first_word"), F.col("end_word").cast("long").alias("end_word"), (kept / F.greatest("n_pairs", F.lit(1))).alias("coverage"))


def _longest_in_order(found: Column) -> Column:
    """Length of the longest part of found (tpos, pos; by tpos) whose text places ascend, too."""
    longest = lambda ends, pos: F.coalesce(F.array_max(F.transform(F.filter(ends, lambda e: e["pos"] < pos), lambda e: e["n"])), F.lit(0))
    none = F.array().cast("array<struct<pos:int,n:int>>")
    ends = F.aggregate(found, none, lambda ends, x: F.array_append(ends, F.struct(x["pos"].cast("int").alias("pos"), (longest(ends, x["pos"]) + 1).alias("n"))))
    return F.coalesce(F.array_max(F.transform(ends, lambda e: e["n"])), F.lit(0))


def scan_licenses(docs: DataFrame, base: tuple = BASE, templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    n_base counts the places of all base phrases, first_word and last_word are their smallest and
    largest start (null if there is none); labels adds those of the templates' spans; score is the
    largest coverage among what counted, 0 without any.
    """
    spans = scan_spans(docs, template_pairs(docs.sparkSession, base, templates))
    is_base = F.col("base") & (F.col("coverage") >= 1)
    counts = is_base | (~F.col("base") & (F.col("tid") >= 0) & (F.col("coverage") >= COVERAGE))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    found = spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(is_base, F.col("first_word"))).alias("last_word"),
        joined(is_base).alias("base_labels"),
        joined(counts).alias("labels"),
        F.coalesce(F.max(F.when(counts, F.col("coverage"))), F.lit(0.0)).alias("score"),
    )
    return found.drop("row")
