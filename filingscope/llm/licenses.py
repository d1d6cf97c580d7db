"""Operator 2: license scans by diagonal voting.

Template notices are short and fixed, so their word k-grams are a bounded broadcast side.  Every text's rolling k-gram
hashes are joined to the template positions; a hit at text place p and template place t votes for the diagonal p - t.
Votes are counted by text, template and diagonal; neighbouring diagonals (inserted or lost words) merge into one
candidate span, which is verified by the share of template k-grams found in it.  Next to the spans stand the base
phrases: exact places of fixed word sequences.

Cases: null and empty text have no words, no labels and score 0; a text shorter than a k-gram has no diagonal; the
same notice several times in one text gives several spans; repeated rows are scanned alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filingscope.llm.toolkit import map_slices, text_key
from filingscope.llm.words import Words, byte_table, signed

GRAM = 3
#: Diagonals at most this far apart are one span.
NEAR = 3
#: Least share of a template's k-grams that a span must hold.
COVER = 0.5

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Customary short notices of public licenses.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
             "general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


def scan_words(column: pa.Array) -> Words:
    return Words(column, byte_table(lower=True, alphanumeric=True))


def grams(docs: DataFrame) -> DataFrame:
    """(key, grams): the rolling k-gram hashes of every distinct-keyed text, in word order."""

    def fn(batch):
        words = scan_words(batch.column("text"))
        at, hashes = words.runs(GRAM)
        ends = np.searchsorted(words.doc[at], np.arange(batch.num_rows + 1))
        return pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(hashes))],
            names=["key", "grams"])

    return map_slices(docs.select(text_key(F.col("text")).alias("key"), "text").where(F.col("text").isNotNull()), fn,
                      "key binary, grams array<long>")


def template_grams(templates: list[tuple[str, str]]) -> list[tuple[int, int, int]]:
    """(gram hash, template number, place)."""
    words = scan_words(pa.array([t for _, t in templates]))
    at, hashes = words.runs(GRAM)
    return [(int(h), int(words.doc[i]), int(i - words.first[words.doc[i]]))
            for i, h in zip(at.tolist(), hashes.view(np.int64), strict=True)]


def spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(key, label, template, first_word, last_word, cover): the verified notices of every text.

    ``key`` stands for the text (``text_key``); equal texts share their spans.
    """
    spark = docs.sparkSession
    places = template_grams(templates)
    size = spark.createDataFrame([(i, lab, len(set(g for g, t, _ in places if t == i)))
                                  for i, (lab, _) in enumerate(templates)], "template int, label string, size int")
    side = spark.createDataFrame(places, "gram long, template int, place int")
    hits = (grams(docs).select("key", F.posexplode("grams").alias("p", "gram"))
            .join(F.broadcast(side), "gram")  # bounded by the template list
            .select("key", "template", (F.col("p") - F.col("place")).alias("diagonal"), "p", "gram"))
    votes = hits.groupBy("key", "template", "diagonal").agg(
        F.countDistinct("gram").alias("votes"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    row = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(row) > NEAR).cast("int"), F.lit(1))
    merged = (votes.withColumn("new", apart).withColumn("span", F.sum("new").over(row))
              .groupBy("key", "template", "span")
              .agg(F.sum("votes").alias("votes"), F.min("lo").alias("first_word"), F.max("hi").alias("hi")))
    return (merged.join(F.broadcast(size), "template")
            .withColumn("cover", F.least(F.lit(1.0), F.col("votes") / F.col("size")))
            .where(F.col("cover") >= COVER)
            .select("key", "label", "template", "first_word", (F.col("hi") + GRAM - 1).alias("last_word"), "cover"))


def base_places(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, n_base, first_word, last_word, base): exact places of the base phrases in every row."""
    phrases = [(scan_words(pa.array([p])).hash, label) for p, label in PHRASES.items()]

    def fn(batch):
        words = scan_words(batch.column("text"))
        n = len(words)
        hit_at, hit_label = [], []
        for hashes, label in phrases:
            k = len(hashes)
            if n >= k:
                ok = words.doc[:n - k + 1] == words.doc[k - 1:]
                for j, h in enumerate(hashes):
                    ok &= words.hash[j:n - k + 1 + j] == h
                at = np.flatnonzero(ok)
                hit_at += at.tolist()
                hit_label += [label] * len(at)
        rows: dict[int, list] = {}
        for at, label in zip(hit_at, hit_label, strict=True):
            rows.setdefault(int(words.doc[at]), []).append((at, label))
        every = [rows.get(i, []) for i in range(batch.num_rows)]
        begin = words.first.tolist()
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("key"), pa.array(words.counts, pa.int64()),
            pa.array([len(r) for r in every], pa.int64()),
            pa.array([min(r)[0] - b if r else None for r, b in zip(every, begin)], pa.int64()),
            pa.array([max(r)[0] - b if r else None for r, b in zip(every, begin)], pa.int64()),
            pa.array([sorted({x for _, x in r}) for r in every], pa.list_(pa.string()))],
            names=["doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base"])

    return map_slices(docs.select("doc_id", text_key(F.col("text")).alias("key"), "text"), fn,
                      f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, n_words long, n_base long, "
                      "first_word long, last_word long, base array<string>")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: its base places and labels, and the labels and best cover of its verified spans."""
    found = spans(docs).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("cover").alias("cover"))
    none = F.array().cast("array<string>")
    return base_places(docs).join(found, "key", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"))
