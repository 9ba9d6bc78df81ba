"""Licence scan: a positional rare-token index over licence templates.

A template is a run of words. Of its mandatory phrase, the two words that the fewest texts hold are its
postings. A text's places of the rarer one are looked up; the other must stand where the same start puts
it, and the words around then verify the mandatory phrase and count the rest of the template. Base
templates are their phrase alone.

Null and empty texts have no words, no places and score 0. Repeated rows get one result each; a label
found often counts once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.positional import contexts, word_counts

#: Label, words. The phrase is the template.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Label, words of the notice, mandatory phrase within them.
OWN = (
    ("gpl-3.0", "gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2", "gnu general public license version 2"),
    (
        "gpl-or-later",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        "gnu general public license as published by the free software foundation",
    ),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "apache license version 2 0",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0", "creative commons cc0 1 0 universal", "cc0 1 0 universal"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "may be used to endorse or promote products derived from this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "in no event will the authors be held liable for any damages",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "eclipse public license v 2 0", "eclipse public license"),
    ("boost", "boost software license version 1 0", "boost software license"),
    ("artistic", "the artistic license 2 0", "artistic license"),
)
#: Words around a place that are looked at: no template is longer.
REACH = 40


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, base, words, phrase, at): at is the phrase's place within the words."""
    rows = []
    for label, words, phrase, base in [*((a, b, b, True) for a, b in BASE), *((*x, False) for x in OWN)]:
        w, p = words.split(), phrase.split()
        at = next(i for i in range(len(w)) if w[i : i + len(p)] == p)
        rows.append((len(rows), label, base, w, p, at))
    return spark.createDataFrame(rows, "template int, label string, base boolean, words array<string>, phrase array<string>, at int")


def postings(listed: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(template, token, offset, second, second_offset): the two rarest words of each phrase, over all texts."""
    vocabulary = listed.select(F.explode("phrase").alias("word")).distinct()
    counts = word_counts(docs, text, vocabulary, vocabulary.count())
    placed = listed.select("template", "at", F.posexplode("phrase").alias("i", "word")).join(F.broadcast(counts), "word", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "word", (F.col("i") + F.col("at")).alias("offset"))))
    two = placed.groupBy("template").agg(order.alias("p")).select("template", F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"))
    return two.select("template", F.col("a.word").alias("token"), F.col("a.offset").alias("offset"), F.col("b.word").alias("second"), F.col("b.offset").alias("second_offset"))


def license_scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs.

    score: the largest share of a template's words that stand in place around a verified phrase."""
    spark = docs.sparkSession
    listed = templates(spark)
    # as many rows as the templates have postings, a fixed number
    index = [tuple(r) for r in postings(listed, docs, text).collect()]
    posted = spark.createDataFrame(index, "template int, token string, offset int, second string, second_offset int")
    base = stored(contexts(docs, posted.select("token").distinct(), REACH, key=key, text=text), "licences")
    met = (
        base.where(F.size("found") > 0)
        .select("doc_id", "text_hash", F.inline("found"))
        .withColumnRenamed("word", "token")
        .join(F.broadcast(posted), "token")
        .withColumn("start", F.col("pos") - F.col("offset"))
        .where(F.get("near", F.col("start") + F.col("second_offset") - F.col("first")) == F.col("second"))
        .join(F.broadcast(listed), "template")
    )
    # the template may begin before the text: words before it are missing, not the phrase
    phrase_at = F.col("start") + F.col("at") - F.col("first")
    verified = met.where(phrase_at >= 0).where(F.slice("near", phrase_at + 1, F.size("phrase")) == F.col("phrase"))
    in_place = F.size(F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get(F.col("words"), i).eqNullSafe(F.get(F.col("near"), F.col("start") - F.col("first") + i))))
    found = (
        verified.withColumn("share", in_place / F.size("words"))
        .groupBy("doc_id", "text_hash")
        .agg(
            # rows that agree in id and text bring the same places
            F.size(F.collect_set(F.when(F.col("base"), F.struct("template", "start")))).alias("n_base"),
            F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("share").alias("score"),
        )
        .withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})
    )
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    return base.where("part = 0").select("doc_id", "text_hash", "n_words").join(found, same, "left").select(
        "doc_id",
        "text_hash",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
