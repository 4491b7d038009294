"""License scans by diagonal voting, in DataFrame functions alone.

Every run of K words of every text is hashed and joined to the places where the templates have that run.
A match votes for a diagonal: its place in the text minus its place in the template.  A template that
stands in the text word for word puts all its votes on one diagonal; a word put in or left out moves
the rest of the votes to a neighbouring one.  Diagonals of one template that lie close together are
merged into a span.  A span is verified by the template's places that it holds, each counted once
however often it stands there; if they are enough, it gives the template's label.

The templates are a fixed list, so the joined table is small whatever the corpus; it is the only
thing broadcast.  Votes are summed before they are dealt out by document.

A missing text is an empty one.  Rows that repeat id and text give as many rows with equal results.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, texts_of

#: What parts words, and the phrases whose exact places are counted, with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Openings of well-known public licences.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-notice"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2-notice"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-notice"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-notice"),
    ("this work is licensed under a creative commons attribution", "cc-notice"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-notice"),
    ("all rights reserved", "all-rights-reserved"),
]
K = 3


def template_table(spark: SparkSession, base: Sequence[tuple[str, str]], own: Sequence[tuple[str, str]]) -> DataFrame:
    """(hash, t, label, base, runs, tpos, t0, t1, t2): a row for each run of K words of each template."""
    rows = []
    for t, (phrase, label) in enumerate([*base, *own]):
        words = re.findall(WORD, phrase)
        if not K <= len(words) < K + 63:
            raise ValueError(f"a template has {K} to {K + 62} words: {phrase!r}")
        rows += [(t, label, t < len(base), len(words) - K + 1, i, *words[i:i + K]) for i in range(len(words) - K + 1)]
    table = spark.createDataFrame(rows, "t int, label string, base boolean, runs int, tpos int, t0 string, t1 string, t2 string")
    return table.select(F.xxhash64("t0", "t1", "t2").alias("hash"), "*")


def scan(docs: DataFrame, base: Sequence[tuple[str, str]] = PHRASES, own: Sequence[tuple[str, str]] = NOTICES,
         near: int = 3, enough: float = 0.6) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per row.

    ``near``: diagonals this close, or closer than a quarter of the template's runs, are one span; ``enough``: the
    share of a template's different runs that gives its label.  score is the largest share found; spans are
    (label, first word, last word, share).
    """
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0))
    text = texts_of(docs).select("doc_id", F.xxhash64("text").alias("th"), F.concat(F.array(F.lit(None).cast("string")), words).alias("w"))
    rest = lambda i: F.slice("w", i, F.greatest(F.size("w"), F.lit(1)))
    # The place before the first word stands for the document itself; a text's runs follow it.
    runs = text.select("doc_id", "th", (F.size("w") - 1).alias("n_words"), F.posexplode(F.arrays_zip(F.col("w").alias("a"), rest(2).alias("b"), rest(3).alias("c"))))
    runs = runs.select("doc_id", "th", "n_words", (F.col("pos") - 1).alias("at"), F.col("col.a").alias("a"), F.col("col.b").alias("b"), F.col("col.c").alias("c"))
    table = F.broadcast(template_table(docs.sparkSession, base, own))
    hit = ((F.xxhash64("a", "b", "c") == F.col("hash")) & (F.col("a") == F.col("t0")) & (F.col("b") == F.col("t1")) & (F.col("c") == F.col("t2")))
    found = runs.join(table, hit, "left").where(F.col("t").isNotNull() | (F.col("at") == -1))
    votes = (found.groupBy("doc_id", "th", "t", (F.col("at") - F.col("tpos")).cast("long").alias("diagonal"))
             .agg(F.count("*").alias("votes"), F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"),
                  F.first("runs").alias("runs"), F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("places"),
                  F.min("at").alias("lo"), F.max("at").alias("hi")))
    doc = Window.partitionBy("doc_id", "th")
    own_t = Window.partitionBy("doc_id", "th", "t").orderBy("diagonal")
    votes = (votes.repartition("doc_id", "th")
             .withColumn("copies", F.max(F.when(F.col("t").isNull(), F.col("votes"))).over(doc))
             .withColumn("votes", (F.col("votes") / F.col("copies")).cast("long"))
             .withColumn("full", F.col("base") & (F.col("votes") == F.col("runs")))
             .withColumn("band", F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(own_t) <= F.greatest(F.lit(near), F.floor(F.col("runs") / 4)), 0).otherwise(1)).over(own_t)))
    bands = votes.groupBy("doc_id", "th", "t", "band").agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.first("label").alias("label"),
        F.sum(F.col("full").cast("long")).alias("n_full"), F.min(F.when(F.col("full"), F.col("diagonal"))).alias("first"),
        F.max(F.when(F.col("full"), F.col("diagonal"))).alias("last"), F.min("lo").alias("lo"), (F.max("hi") + K - 1).alias("hi"),
        F.when(F.col("t").isNull(), 0.0).otherwise(F.bit_count(F.bit_or("places")) / F.first("runs")).alias("share"))
    good = F.col("share") >= enough
    out = bands.groupBy("doc_id", "th").agg(
        F.max("n_words").cast("long").alias("n_words"), F.max("copies").alias("copies"), F.coalesce(F.sum("n_full"), F.lit(0)).cast("long").alias("n_base"),
        F.min("first").alias("first_word"), F.max("last").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("n_full") > 0, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when((F.col("n_full") > 0) | good, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("n_full") > 0, F.lit(1.0)).otherwise(F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(good & F.col("t").isNotNull(), F.struct("label", "lo", "hi", "share")))).alias("spans"))
    # one row for each row read
    return out.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("th", "copies", "copy_")
