"""License scan by diagonal voting over rolling word k-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_words, materialize, rolling, slices_of

#: Phrases that name a license by themselves, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices of public licenses, with their labels. Words only; case and punctuation don't matter.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

#: What names a license. A span of a label must hold, word for word and unbroken, one of those that its template holds.
NAMES = (
    ("gpl", "GNU General Public License"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("apache", "Apache License, Version 2.0"),
    ("mit", "MIT License"),
    ("mit", "this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary"),
    ("isc", "this software for any purpose with or without fee"),
    ("mpl", "Mozilla Public License"),
    ("unlicense", "released into the public domain"),
    ("cc-by", "Creative Commons Attribution 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0"),
    ("cc-by-nd", "Creative Commons Attribution-NoDerivatives 4.0"),
    ("cc-by-nc-sa", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0"),
    ("cc-by-nc-nd", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"),
    ("cc-by-sa", "CC BY-SA 4.0"),
    ("cc-by-nc", "CC BY-NC 4.0"),
    ("cc-by-nd", "CC BY-ND 4.0"),
    ("cc-by-nc-sa", "CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "CC BY-NC-ND 4.0"),
    ("cc0", "waived all copyright and related or neighboring rights"),
)

K, DRIFT, LEAST_COVER = 4, 3, 0.7
BASE = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>"


def phrase_places(hashes: np.ndarray, starts: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) of every place in which the phrase's words stand one after the other in one text."""
    n = max(0, len(hashes) - len(phrase) + 1)
    hit = np.ones(n, dtype=bool)
    for j in range(len(phrase)):
        hit &= hashes[j : j + n] == phrase[j]
    at = np.flatnonzero(hit)
    text = np.searchsorted(starts, at, side="right") - 1
    whole = at + len(phrase) <= starts[text + 1]
    return text[whole], (at - starts[text])[whole]


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wanted = [(word_hashes_of(p), label) for p, label in PHRASES]
    for whole in batches:
        for batch in slices_of(whole):
            hashes, starts = hashed_words(batch.column("text"), "alnum")
            size = batch.num_rows
            n, first, last = np.zeros(size, dtype=np.int64), np.full(size, len(hashes)), np.full(size, -1)
            labels: list[set[str]] = [set() for _ in range(size)]
            for phrase, label in wanted:
                text, at = phrase_places(hashes, starts, phrase)
                np.add.at(n, text, 1)
                np.minimum.at(first, text, at)
                np.maximum.at(last, text, at)
                for t in np.unique(text).tolist():
                    labels[t].add(label)
            none = n == 0
            cols = {
                "n_words": pa.array(np.diff(starts).astype(np.int64)), "n_base": pa.array(n),
                "first_word": pa.array(first.astype(np.int64), mask=none), "last_word": pa.array(last.astype(np.int64), mask=none),
                "base_labels": pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("doc_id", "k1", "k2")} | cols)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices_of(whole):
            hashes, starts = hashed_words(batch.column("text"), "alnum")
            grams = rolling(hashes, K).view(np.int64)
            text = np.searchsorted(starts, np.arange(len(grams)), side="right") - 1
            inside = np.arange(len(grams)) + K <= starts[text + 1]  # a gram doesn't reach into the next text
            sizes = np.maximum(np.diff(starts) - K + 1, 0)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "k1": batch.column("k1"),
                    "k2": batch.column("k2"),
                    "grams": pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams[inside])),
                }
            )


def word_hashes_of(text: str) -> np.ndarray:
    return hashed_words(pa.array([text]), "alnum")[0]


def names_in(words: np.ndarray, label: str, names: tuple[tuple[str, str], ...]) -> list[list[int]]:
    """Positions of each place in a template's words at which one of its label's names stands."""
    whole = np.array([0, len(words)])
    found = []
    for of, name in names:
        phrase = word_hashes_of(name)
        if of == label:
            found += [list(range(at, at + len(phrase))) for at in phrase_places(words, whole, phrase)[1].tolist()]
    return found


def best_of_overlapping(spans: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Of spans of one text that overlap, those that no overlapping one beats.

    A span's worth is twice the words it shares with its template over the words of both, so both a template's missing
    words and words between speak against it; of equals the longer template and then the earlier one in the list wins.
    """
    w = Window.partitionBy(*keys).orderBy("first", "last", "template")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("__fresh", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1)))
    spans = spans.withColumn("__group", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    worth = (2 * F.col("covered") / (F.col("size") + F.col("last") - F.col("first") + 1)).alias("worth")
    one = F.struct(worth, "size", (-F.col("template")).alias("order"), "first", "last", "label")
    groups = spans.groupBy(*keys, "__group").agg(F.collect_list(one).alias("all"))

    def rank(x):
        return F.struct(x["worth"], x["size"], x["order"], -x["first"])

    def beaten(x):
        return F.exists("all", lambda y: (y["first"] <= x["last"]) & (x["first"] <= y["last"]) & (rank(y) > rank(x)))

    return groups.select(*keys, F.explode(F.filter("all", lambda x: ~beaten(x))).alias("x")).select(*keys, "x.first", "x.last", "x.label")


def scan_licenses(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, cover: float = LEAST_COVER,
    names: tuple[tuple[str, str], ...] = NAMES,
) -> DataFrame:
    """License phrases and near-verbatim license notices in every whole text.

    All rolling 4-word hashes of the documents are joined to the positions of the templates'
    (a broadcast of as many rows as the template list has words). Hits vote for (document,
    template, diagonal = word position - template position); neighbouring diagonals, at most
    3 apart, are merged, so a few inserted or missing words don't break a notice; a merged span counts if
    the template words under its hits are at least ``cover`` of the template, the span is no
    longer than one and a half templates, and one diagonal of it holds a whole name of the license (of ``names``; a template
    that holds none of its label's needs none), so words that tell notices apart may be neither missing nor split. Of verified spans that overlap, as those of notices that differ in a word or two do,
    only the one nearest to its template counts.

    A null or empty text has no words; a text of any length is scanned whole; equal rows get equal results; an empty table gives no
    rows; further columns, whatever their names, are ignored. Returns doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels (arrays), score (1 with a phrase, else the best cover, half of it for spans without a label), spans.
    """
    spark = docs.sparkSession
    rows, sizes = [], []
    for t, (label, text) in enumerate(templates):
        words = word_hashes_of(text)
        sizes.append((t, label, len(words), names_in(words, label, names)))
        rows += [(int(h), t, p) for p, h in enumerate(rolling(words, K).view(np.int64))]
    positions = spark.createDataFrame(rows, "gram long, template int, at int")
    sizes_df = spark.createDataFrame(sizes, "template int, label string, size int, places array<array<int>>")

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plain = plain.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(5), "text", "doc_id"))
    base = plain.mapInArrow(_base, f"doc_id long, k1 long, k2 long, {BASE}")

    grams = plain.mapInArrow(_grams, "k1 long, k2 long, grams array<long>")
    hits = grams.select("k1", "k2", F.posexplode("grams").alias("pos", "gram")).join(F.broadcast(positions), "gram")
    diagonals = (
        hits.withColumn("diagonal", F.col("pos") - F.col("at"))
        .groupBy("k1", "k2", "template", "diagonal")
        .agg(F.collect_set("at").alias("ats"))
        .join(F.broadcast(sizes_df.select("template", "places")), "template")
    )
    under = F.flatten(F.transform("ats", lambda a: F.sequence(a, a + K - 1)))
    named = (F.size("places") == 0) | F.exists("places", lambda p: F.size(F.array_except(p, under)) == 0)
    diagonals = diagonals.withColumn("named", named).drop("places")
    w = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > DRIFT).cast("int"), F.lit(0))
    merged = (
        diagonals.withColumn("fresh", fresh)
        .withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("k1", "k2", "template", "island")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
            F.bool_or("named").alias("named"),
            F.min(F.array_min("ats") + F.col("diagonal")).alias("first"),
            (F.max(F.array_max("ats") + F.col("diagonal")) + K - 1).alias("last"),
        )
        .join(F.broadcast(sizes_df.drop("places")), "template")
    )
    covered = F.size(F.array_distinct(under))
    cover_of = F.least(F.lit(1.0), covered / F.col("size"))
    merged = merged.withColumn("cover", cover_of).withColumn(
        "verified", F.col("named") & (F.col("cover") >= cover) & (F.col("last") - F.col("first") + 1 <= 1.5 * F.col("size"))
    )
    merged = materialize(merged.withColumn("covered", covered).drop("ats"), "spans")
    kept = best_of_overlapping(merged.where("verified"), ("k1", "k2")).groupBy("k1", "k2").agg(
        F.collect_set("label").alias("found"), F.array_sort(F.collect_list(F.struct("first", "last", "label"))).alias("spans")
    )
    per_doc = merged.groupBy("k1", "k2").agg(
        F.max(F.col("cover") * F.when(F.col("verified"), 1.0).otherwise(0.5)).alias("best")
    ).join(kept, ["k1", "k2"], "left")
    none = F.array().cast("array<string>")
    joined = base.join(per_doc, ["k1", "k2"], "left")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("found", none))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        "spans",
    )


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
