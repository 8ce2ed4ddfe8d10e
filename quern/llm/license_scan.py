"""License scans: diagonal voting of word bigrams against licence templates."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import ascii_lower

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a gram. The shortest phrase has as many.
K = 2
#: Diagonals at most this far apart are one match with words put in or left out.
GAP = 3
#: Share of a template's grams that a match must have; templates of fewer than SHORT grams must have all.
LEAST, SHORT = 0.5, 8

# Phrases and labels that the results must contain, wherever their words stand consecutively.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening words of public licence notices, with their labels.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
)

# A gram of two of these words does not vote for a template.
COMMON = frozenset("a and at by in is it of or that the this to under with you".split())


def positions(phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[tuple]:
    """(template, label, is phrase, family, grams that vote, grams needed, gram, position) for each voting position.

    Templates whose labels begin alike, up to a hyphen, are a family: variants
    of one licence, of which the best fits where several do.
    """
    rows = []
    everything = [(label, text, True) for text, label in sorted(phrases.items())] + [(label, text, False) for label, text in templates]
    for number, (label, text, phrase) in enumerate(everything, 1):
        words = re.findall("[a-z0-9]+", text)
        grams = [(i, words[i : i + K]) for i in range(len(words) - K + 1)]
        grams = [(i, g) for i, g in grams if phrase or not COMMON.issuperset(g)]
        needed = len(grams) if phrase or len(grams) < SHORT else math.ceil(LEAST * len(grams))
        rows += [(number, label, phrase, label.split("-")[0], len(grams), needed, " ".join(g), i) for i, g in grams]
    return rows


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The voting positions, and one row for the mark that ends each document."""
    values = ", ".join(f"({t}, '{label}', {phrase}, '{f}', {n}, {m}, '{gram}', {i})" for t, label, phrase, f, n, m, gram, i in [*rows, (0, "", False, "", 1, 1, "", 0)])
    return spark.sql(f"SELECT xxhash64(tgram) AS h, * FROM VALUES {values} AS v(template, label, phrase, family, grams, needed, tgram, at)")


def scan(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Null text counts as empty: no words, no places, empty labels, score 0.
    Repeated rows and null ids each get their own result; other columns are
    ignored; an empty table gives no rows.

    All bigram hashes of all documents are joined with the template positions,
    a constant table of some 250 rows that is broadcast. Equal grams vote for
    (template, diagonal); a mark at each document's end carries its word count,
    so the texts are read once and only votes are shuffled, gathered beforehand
    where they arise. Diagonals at most GAP apart merge. A span is verified if
    its grams, compared word by word, are those of enough different places of
    the template: LEAST of them, or all of a short template; a phrase needs
    all its grams on one diagonal. Of spans of one family of licences that
    overlap the best stands, so a notice gets the label of its own variant.
    """
    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), NO_WORD), "")
    d = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), words.alias("_w"))
    n = F.size("_w")
    grams = F.slice(
        F.transform("_w", lambda w, i: F.concat_ws(" ", w, F.get("_w", i + 1))), F.lit(1), F.greatest(n - (K - 1), F.lit(0))
    )
    d = d.select("_row", "doc_id", n.cast("long").alias("n_words"), F.concat(grams, F.array(F.lit(""))).alias("_g"))
    d = d.select("_row", "doc_id", "n_words", F.posexplode("_g").alias("pos", "gram"))
    votes = d.withColumn("h", F.xxhash64("gram")).join(F.broadcast(_table(docs.sparkSession, positions(phrases, templates))), "h")
    same = F.col("gram") == F.col("tgram")
    about = ("_row", "doc_id", "n_words", "template", "label", "phrase", "family", "grams", "needed")
    diagonals = (
        votes.groupBy(*about, (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(
            F.collect_set(F.when(same, F.col("at"))).alias("places"),  # no more than the template has
            F.min(F.when(same, F.col("pos"))).alias("first"),
            F.max(F.when(same, F.col("pos"))).alias("last"),
        )
        .repartition("_row")
    )
    by = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(by) > GAP)
    merged = (
        diagonals.withColumn("cluster", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(by))
        .groupBy(*about, "cluster")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("diagonal").alias("diagonal"))
    )
    enough = (F.col("template") > 0) & (F.col("places") >= F.col("needed"))
    covered = F.col("places") / F.col("grams")
    merged = merged.withColumn("rival", F.when(enough & ~F.col("phrase"), F.col("family")))
    along = Window.partitionBy("_row", "rival").orderBy("first", "last", "template")
    before = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    beyond = F.coalesce(F.col("first") > before + (K - 1), F.lit(True)).cast("int")
    merged = merged.withColumn("_beyond", beyond).withColumn("place", F.sum("_beyond").over(along))
    best = covered == F.max(covered).over(Window.partitionBy("_row", "rival", "place"))
    merged = merged.withColumn("found", enough & (F.col("phrase") | best))
    found = F.col("found")
    base = found & F.col("phrase")
    span = F.struct("template", "label", F.col("first").cast("long").alias("first_word"), (F.col("last") + K - 1).cast("long").alias("last_word"), covered.alias("score"))
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return (
        merged.groupBy("_row", "doc_id", "n_words")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
            names(base).alias("base_labels"),
            names(found).alias("labels"),
            F.coalesce(F.max(F.when(found, covered)), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(found, span))).alias("spans"),
        )
        .drop("_row")
    )
