"""License scans by diagonal voting.

Every text becomes its rolling word k-gram hashes, and Spark joins all of them with the positions of the same
hashes in license templates (a broadcast table whose size the templates fix). A hit votes for its offset
diagonal, text position less template position. Votes add up by (text, template, diagonal); neighbouring
diagonals, which insertions and deletions part, merge; and a merged span is verified: the words of its template that
lie in matched k-grams must make up a set share. Base phrases are templates too, with two-word grams and
all grams asked for on one diagonal, so each such diagonal is one exact place of the phrase.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, saved
from .words import Words, gram_hash, text_slices

# The base phrases with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Opening sentences of public licenses and common license lines, with their labels.
TEMPLATES = [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2.0"),
    ("Released under the MIT License.", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("Licensed under CC BY 4.0.", "cc-by-4.0"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa-4.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("All rights reserved.", "all-rights-reserved"),
]
GRAM, NEIGHBOUR, SHARE = 3, 4, 0.75
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template_words(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def positions(base: dict[str, str], templates: list[tuple[str, str]], k: int = GRAM) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(gram length, hash, [(template, position)]): base phrases first, with two-word grams, then templates with k-word grams."""
    at: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for t, (text, _) in enumerate([*base.items(), *templates]):
        size = 2 if t < len(base) else k
        words = template_words(text)
        if len(words) < size:
            raise ValueError(f"template of fewer than {size} words: {text!r}")
        for p, h in enumerate(gram_hash(words, size)):
            at.setdefault((size, h - (1 << 64) if h >> 63 else h), []).append((t, p))
    return [(*key, found) for key, found in at.items()]


def scanned(docs: DataFrame, base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, k: int = GRAM, share: float = SHARE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for every row.

    ``spans`` holds the verified spans (label, first and end word, covered share). ``score`` is 1 where a base phrase
    stands, else the largest covered share of any template, 0 without votes. Null texts are empty: no words, null
    positions, empty labels. Rows repeated in doc_id are apart; an empty table gives no rows.
    """
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    bounded_batches(spark)
    every = [*base.items(), *templates]
    facts = spark.createDataFrame([(t, label, len(template_words(words)), t < len(base)) for t, (words, label) in enumerate(every)], "template int, label string, size int, is_base boolean")
    known = spark.createDataFrame(positions(base, templates, k), "k int, hash long, found array<struct<template:int,at:int>>")

    def roll(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                ids = batch.column(0).slice(lo, hi - lo)
                own = row + np.arange(hi - lo)
                row += hi - lo
                yield grams_of(ids, own, np.arange(hi - lo), words.count, np.zeros(hi - lo, np.int64), 0)
                for size in sorted({2, k}):
                    at, gram = words.grams(size)
                    doc = words.doc[at]
                    for cut in range(0, len(at), 1 << 18):
                        part = slice(cut, cut + (1 << 18))
                        yield grams_of(ids, own, doc[part], (at - words.first[doc])[part], gram[part].view(np.int64), size)

    def grams_of(ids, own, doc, at, gram, size):
        columns = [ids.take(pa.array(doc)), pa.array(own[doc]), pa.array(at), pa.array(gram), pa.array(np.full(len(doc), size, np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "at", "hash", "k"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rolled = rows.mapInArrow(roll, "doc_id long, row long, at long, hash long, k int")
    # the left join keeps the one row a text with k = 0, which carries its number of words
    hits = rolled.join(F.broadcast(known), ["k", "hash"], "left").where("k = 0 or found is not null")
    hits = hits.withColumn("f", F.explode(F.when(F.col("k") == 0, F.expr("array(struct(-1 as template, 0 as at))")).otherwise(F.col("found"))))
    votes = hits.groupBy("row", "doc_id", F.col("f.template").alias("template"), F.when(F.col("k") == 0, F.lit(0)).otherwise(F.col("at") - F.col("f.at")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("f.at").alias("matched")
    )  # a diagonal has at most as many votes as its template has grams
    votes = saved(votes, "votes")
    counts = votes.where("template = -1").select("row", "doc_id", F.col("first").alias("n_words"))
    votes = votes.where("template >= 0").join(F.broadcast(facts), "template")

    places = votes.where(F.col("is_base") & (F.col("votes") == F.col("size") - 1)).groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("own")
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOUR) | F.lag("diagonal").over(order).isNull()
    merged = votes.where("not is_base").withColumn("run", F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("row", "template", "label", "size", "run").agg(F.min("first").alias("start"), (F.max("last") + k).alias("end"), F.flatten(F.collect_list("matched")).alias("matched"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("matched", lambda p: F.sequence(p, p + (k - 1))))))
    spans = spans.withColumn("share", covered / F.col("size"))
    spans = spans.groupBy("row").agg(
        F.max("share").alias("best"), F.collect_set(F.when(F.col("share") >= share, F.col("label"))).alias("found"),
        F.array_sort(F.collect_list(F.when(F.col("share") >= share, F.struct("start", "end", "label", "share")))).alias("spans"),
    )
    out = counts.join(places, "row", "left").join(spans, "row", "left")
    none = F.expr("cast(array() as array<string>)")
    own, found = F.coalesce("own", none), F.coalesce("found", none)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(own), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(own, found)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "spans",
    )
