"""License scans by diagonal voting: word k-grams are joined with template positions, votes are counted along diagonals.

All in DataFrame operations: a document's k-grams become rows, a broadcast join finds the templates' positions, and what a
document and a template have in common in order lies on one diagonal (place in the document less place in the template).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import written

#: Base phrases and their labels (fixed values).
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Passages of well-known license texts and notices, label and wording; the method finds them also with words changed, added or lost.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Released under the MIT License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                 "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                 "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
            "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
             "published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
              "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
                  "or distribute this software, either in source code form or as a compiled binary, for any purpose"),
)
GRAM = 3


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Runs of letters and digits; split is faster than extraction, and leaves empty ends where the text begins or ends with others."""
    return F.filter(F.split(lowered(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def grams(words: Column, size: int = GRAM) -> Column:
    """Rolling ``size``-grams with their place, as an array of (place, gram)."""
    def roll(own):
        last = F.size(own) - size
        return F.filter(F.transform(own, lambda w, i: F.when(i <= last, F.struct(
            i.alias("place"), F.concat_ws(" ", w, *[F.get(own, i + k) for k in range(1, size)]).alias("gram")))), lambda g: g.isNotNull())
    # One element holds the words, so that they are split once and not once for each place.
    return F.flatten(F.transform(F.array(words), roll))


def template_grams(spark, templates) -> DataFrame:
    """``template``, ``label``, ``base``, ``length`` (words), ``at`` and the gram with its hash."""
    rows = [(k, label, base, text) for k, (label, text, base) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, text string").withColumn("words", words_of(F.col("text")))
    return (table.select("template", "label", "base", F.size("words").alias("length"), F.explode(grams(F.col("words"))).alias("g"))
            .select("template", "label", "base", "length", F.col("g.place").alias("at"), F.xxhash64("g.gram").alias("hash"), F.col("g.gram").alias("wording")))


def matches(docs: DataFrame, doc_id: str, text: str, templates) -> DataFrame:
    """Each hit of a template's k-gram in a text: key of the text, template, place and position in the template.

    A text is named by its id and a hash of 128 bits, so that repeated rows count once. Hashes are joined, and wordings compared,
    so that no hit is owed to a collision. Templates are a fixed, small table.
    """
    spark = docs.sparkSession
    keys = docs.select(F.col(f"`{doc_id}`").alias("id"), F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")).alias("name"),
                       F.explode(grams(words_of(F.col(f"`{text}`")))).alias("g"))
    rows = keys.select("id", "name", F.col("g.place").alias("place"), F.col("g.gram").alias("gram"), F.xxhash64("g.gram").alias("hash"))
    return rows.join(F.broadcast(template_grams(spark, templates)), "hash").where("gram = wording").drop("hash", "gram", "wording").distinct()


def all_templates(phrases=PHRASES, templates=TEMPLATES):
    return [(label, phrase, True) for phrase, label in phrases] + [(label, text, False) for label, text in templates]


def spans(hits: DataFrame, drift: int = 4, gap: int = 12, least: float = 0.5) -> DataFrame:
    """Verified spans: ``id``, ``name``, ``template``, ``label``, ``base``, ``first`` and ``last`` word, ``share`` of the template found.

    Votes are counted by diagonal. Neighbouring diagonals of a template (at most ``drift`` apart: words added or lost) merge, and where
    their places lie more than ``gap`` words apart they part to spans. A span of a base phrase is verified if one diagonal has all its k-grams; one
    of another template if at least ``least`` of the template's words are in k-grams found there.
    """
    key = ["id", "name", "template"]
    votes = hits.withColumn("diagonal", F.col("place") - F.col("at"))
    base = (votes.where("base").groupBy(*key, "label", "base", "length", "diagonal")
            .agg(F.count("*").alias("votes")).where(F.col("votes") == F.col("length") - GRAM + 1)
            .select(*key, "label", "base", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("length") - 1).alias("last"), F.lit(1.0).alias("share")))
    # Sorted by diagonal, a new band begins on a far one; sorted by place, a new span of the band begins after a gap. So hits on far
    # diagonals (wording that a template has twice) do not come between those of a span.
    across, along = Window.partitionBy(*key).orderBy("diagonal", "place"), Window.partitionBy(*key, "band").orderBy("place", "at")
    walked = (votes.where("not base").withColumn("far", F.when(F.col("diagonal") - F.lag("diagonal").over(across) <= drift, 0).otherwise(1))
              .withColumn("band", F.sum("far").over(across))
              .withColumn("new", F.when(F.col("place") - F.lag("place").over(along) <= gap, 0).otherwise(1)).withColumn("span", F.sum("new").over(along)))
    found = (walked.groupBy(*key, "label", "base", "length", "band", "span")
             .agg(F.min("place").alias("first"), (F.max("place") + GRAM - 1).alias("last"),
                  F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + GRAM - 1))))).alias("words")))
    return base.unionByName(found.withColumn("share", F.col("words") / F.col("length")).where(F.col("share") >= least)
                            .select(*key, "label", "base", "first", "last", "share"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES, drift: int = 4, gap: int = 12,
         least: float = 0.5) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_words``, ``spans`` (label, base, first, last, share), sorted by place.

    Null and empty texts have no words and no spans. Repeated rows give the same result each; a null id is an id like any other.
    Documents without a hit take no part in the voting; the texts themselves are never shuffled.
    """
    # Hits are few; written once, they serve the phrases and the passages without a second scan of the texts.
    hits = written(matches(docs, doc_id, text, all_templates(phrases, templates)), "hits")
    found = spans(hits, drift, gap, least)
    lists = found.groupBy("id", "name").agg(F.sort_array(F.collect_list(F.struct("first", "last", "label", "base", "share"))).alias("spans"))
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")).alias("_name"),
                      F.size(words_of(F.col(f"`{text}`"))).cast("long").alias("n_words"))
    joined = own.join(lists, own["doc_id"].eqNullSafe(lists["id"]) & (own["_name"] == lists["name"]), "left")
    return joined.select("doc_id", "n_words", F.coalesce("spans", F.array().cast(lists.schema["spans"].dataType)).alias("spans"))
