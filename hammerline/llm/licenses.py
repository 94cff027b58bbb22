"""License scan: exact phrases, and an exact set-similarity join of text blocks with license templates.

A template is a notice, or a paragraph of a license, as the set of its word pairs (two consecutive words),
so words that merely stand in the same line are no match. Texts are read as one sequence of words: line
ends don't matter, wrapped and commented notices are found. A block is a run of template pairs of which
none starts more than ``BREAK`` words after the one before; a block holds a template if it has at least
``containment`` of its pairs.

Pairs are ordered by their frequency over all blocks of the corpus, rarest first. With need =
ceil(containment * size) a template can only be held by a block of at least need pairs (length filter);
their first size - need + 1 pairs share one (prefix filter, on both sides); and at the k-th shared pair,
at place i of the block and j of the template, k and the shorter of the two rests must reach need
(positional filter). What passes is verified on the full sets.

Everything is DataFrame expressions; the broadcast tables hold the template pairs only, a constant.
Edge cases: null or empty text has no word, no label and score 0; a repeated row gives a repeated
result row (labels are those of all rows of the id); rows with a null id get the phrases but no
template label; of templates or blocks with equal containment each counts; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Characters between words of this scan, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Words between two template pairs that end a block.
BREAK = 12

#: Public wording of license notices and paragraphs, by label.
TEMPLATES = [
    ("mit", "MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0", "Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-2.0", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("gpl-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("cc-by", "Creative Commons Attribution License"),
    ("cc-by", "Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "CC BY-NC 4.0"),
    ("cc-by-sa", "CC BY-SA 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike License"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", "BSD License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("mpl-2.0", "Mozilla Public License, version 2.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "rights reserved"),
    ("proprietary", "Unauthorized copying of this file, via any medium is strictly prohibited"),
    ("proprietary", "This document contains confidential and proprietary information"),
]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def phrase_places(text: Column, phrases: dict[str, str] = PHRASES) -> Column:
    """array<struct<at, label>> of the places where a phrase's words stand consecutively."""
    split = {p: p.split() for p in phrases}
    near = "|".join(GAP.replace("\\x3A-\\x60", "\\x3A-\\x40\\x5B-\\x60").join(w) for w in split.values())
    words = F.filter(F.split(lower_ascii(text), GAP), lambda w: w != "")

    def at(w: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            found = None
            for p, parts in split.items():
                hit = x == parts[0]
                for k, word in enumerate(parts[1:], 1):
                    hit = hit & (F.get(w, i + k) == word)
                value = F.struct(i.cast("long").alias("at"), F.lit(phrases[p]).alias("label"))
                found = F.when(hit, value) if found is None else found.when(hit, value)
            return found

        return F.filter(F.transform(w, one), lambda e: e.isNotNull())

    # one array element binds the words, so that they are split once a text and only where a phrase may stand
    bound = F.get(F.transform(F.array(words), at), F.lit(0))
    return F.when(text.rlike(f"(?i)(?:{near})"), bound)


def words_of(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.translate(str.maketrans(UPPER, LOWER))) if w]


def pairs_of(text: str) -> list[str]:
    """Distinct word pairs of a template."""
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in itertools.pairwise(words)})


def blocks_of(text: Column, vocabulary: list[str], gap: int = BREAK) -> Column:
    """array<array<string>>: distinct vocabulary pairs of each block of the text, in order."""
    first, second = (sorted({p.split()[k] for p in vocabulary}) for k in (0, 1))
    words = F.filter(F.split(lower_ascii(text), GAP), lambda w: w != "")

    def hits(w: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            after = F.get(w, i + 1)
            return F.when(x.isin(first) & after.isin(second), F.struct(i.alias("at"), F.concat_ws(" ", x, after).alias("pair")))

        return F.filter(F.transform(w, one), lambda e: e.isNotNull() & e["pair"].isin(vocabulary))

    def cut(h: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when((i == 0) | (x["at"] - F.get(h, i - 1)["at"] > gap), i)), lambda i: i.isNotNull())

    def told(h: Column) -> Column:
        return F.transform(F.array(cut(h)), lambda c: F.transform(c, lambda at, k: F.array_distinct(F.transform(F.slice(h, at + 1, F.coalesce(F.get(c, k + 1), F.size(h)) - at), lambda x: x["pair"]))))

    # one-element arrays bind words and hits, so that they are found once a text
    return F.flatten(F.flatten(F.transform(F.array(words), lambda w: F.transform(F.array(hits(w)), lambda h: F.flatten(told(h))))))


def template_matches(docs: DataFrame, id_col: str, text_col: str, templates: list[tuple[str, str]] = TEMPLATES, containment: float = 0.85) -> DataFrame:
    """id, label, containment of every template that some block of the text holds."""
    spark = docs.sparkSession
    rows = [(i, label, pairs_of(text)) for i, (label, text) in enumerate(templates)]
    rows = [(i, label, pairs, max(1, math.ceil(containment * len(pairs) - 1e-9)), len(pairs)) for i, label, pairs in rows if pairs]
    known = spark.createDataFrame(rows, "template int, label string, template_pairs array<string>, need int, size int")
    vocabulary = sorted({p for _, _, pairs, *_ in rows for p in pairs})
    blocks = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(blocks_of(F.col(text_col), vocabulary)).alias("pairs"))
    held = written(blocks.where(F.size("pairs") >= min((need for *_, need, _ in rows), default=1)), "license-blocks")
    # template pairs only: a constant number of rows
    frequency = held.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("pair"))
    ordered = known.withColumn("pair", F.explode("template_pairs")).join(F.broadcast(frequency), "pair", "left").groupBy("template", "label", "need", "size", "template_pairs").agg(F.sort_array(F.collect_list(order)).alias("sorted"))
    prefix = ordered.select("template", "label", "need", "size", "template_pairs", F.posexplode("sorted").alias("j", "entry")).where(F.col("j") <= F.col("size") - F.col("need")).select("template", "label", "need", "size", "template_pairs", "j", F.col("entry.pair").alias("pair"))
    distinct = held.dropDuplicates(["id", "pairs"])
    placed = distinct.select("id", "pairs", F.explode("pairs").alias("pair")).join(F.broadcast(frequency), "pair")
    placed = placed.withColumn("i", F.row_number().over(W.partitionBy("id", "pairs").orderBy("n", "pair")) - 1)
    length = F.size("pairs")
    met = placed.join(F.broadcast(prefix), "pair").where((length >= F.col("need")) & (F.col("i") <= length - F.col("need")))
    shared_so_far = F.row_number().over(W.partitionBy("id", "pairs", "template").orderBy("j"))
    reach = met.withColumn("reach", shared_so_far + F.least(length - F.col("i"), F.col("size") - F.col("j")) - 1)
    reaching = reach.groupBy("id", "pairs", "template", "label", "need", "size", "template_pairs").agg(F.min("reach").alias("reach")).where(F.col("reach") >= F.col("need"))
    shared = F.size(F.array_intersect("pairs", "template_pairs"))
    return reaching.where(shared >= F.col("need")).groupBy("id", "label").agg(F.max(shared / F.col("size")).alias("containment")).withColumnRenamed("id", id_col)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, containment: float = 0.85) -> DataFrame:
    """id, n_words, places, labels array and score of every row."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = rows.select("id", F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"), F.coalesce(phrase_places(text), F.expr("cast(array() as array<struct<at:bigint,label:string>>)")).alias("places"))
    found = template_matches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", templates, containment)
    found = found.groupBy("id").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    joined = base.join(found, "id", "left")
    labels = F.array_sort(F.array_union(F.array_distinct(F.col("places.label")), F.coalesce("more", F.expr("cast(array() as array<string>)"))))
    return joined.select(F.col("id").alias(id_col), "n_words", "places", labels.alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
