"""License scans by diagonal voting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import alnum_words, gram_hashes, word_hashes


@dataclass(frozen=True)
class Template:
    """A text to look for. It is found where ``coverage`` of its k-grams stand in order, on diagonals that are
    ``slack`` words apart in all at most; a phrase has full coverage and no slack."""

    label: str
    text: str
    coverage: float = 0.6
    slack: int = 4

    @property
    def is_phrase(self) -> bool:
        return self.coverage >= 1.0


PHRASES = (Template("mit", "mit license", 1.0, 0), Template("apache", "apache license", 1.0, 0), Template("gpl", "general public license", 1.0, 0))

#: Opening sentences of well-known licenses and notices.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    Template("cc", "This work is licensed under a Creative Commons Attribution International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", 1.0),
    Template("mit", "Released under the MIT License", 1.0),
    Template("proprietary", "All rights reserved", 1.0),
)
K = 2


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """Rolling word k-grams of the templates and their positions; as many rows as the templates have words."""
    rows = [(i, t.label, t.text, t.is_phrase and t.slack == 0, float(t.coverage), t.slack) for i, t in enumerate(templates)]
    t = spark.createDataFrame(rows, "template int, label string, body string, phrase boolean, coverage double, slack int").withColumn("w", alnum_words(F.col("body")))
    t = t.withColumn("h", word_hashes(F.col("w"))).select("template", "label", "phrase", "coverage", "slack", "w", "h", (F.size("w") - (K - 1)).alias("n_grams"), F.explode_outer(F.sequence(F.lit(0), F.size("w") - K)).alias("at"))
    return t.select("template", "label", "phrase", "coverage", "slack", "n_grams", "at", F.xxhash64(*[F.get("h", F.col("at") + j) for j in range(K)]).alias("gram"), *[F.get("w", F.col("at") + j).alias(f"t{j}") for j in range(K)])


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find templates in whole texts.

    Every rolling k-gram hash of every text is joined to the template positions (a table of fixed
    size, hence broadcast) and compared word by word. A match votes for the diagonal text position
    minus template position; a diagonal and those up to ``slack`` words after it form a span, so its
    length is bounded. A span is verified in order: a template position counts if its first place in the span
    comes after that of the position before it. It holds if enough positions count.

    One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word (places of
    phrases), base_labels, labels (distinct, sorted, comma-joined; empty without any) and score, the
    best coverage of a span that holds, else 0. Null text has no words. Rows that agree in id and
    text give the same result as often as they occur. Other columns are not carried.
    """
    spark, c = docs.sparkSession, F.col
    grams = F.broadcast(template_grams(spark, templates))
    key = ["doc_id", "text_hash"]
    d = docs.select(c(id_col).alias("doc_id"), F.xxhash64(c(text_col)).alias("text_hash"), alnum_words(c(text_col).cast("string")).alias("w"))
    d = d.withColumn("h", word_hashes(c("w"))).select(*key, "w", gram_hashes("h", K).alias("g"))
    # Position -1 stands for the document itself and matches nothing.
    d = d.select(*key, "w", "g", F.explode_outer(F.sequence(F.lit(-1), F.size("g") - 1)).alias("p")).withColumn("own", F.get("g", c("p")))
    votes = d.join(grams, c("own") == c("gram"), "left").where(c("template").isNotNull() | (c("p") < 0))
    same = c("p") < 0
    for_all = F.lit(True)
    for j in range(K):
        for_all &= F.get("w", c("p") + j) == c(f"t{j}")
    votes = votes.where(same | for_all).withColumn("n_words", F.when(same, F.size("w")).cast("long"))
    votes = votes.groupBy(*key, "template", "label", "phrase", "coverage", "slack", "n_grams", (c("p") - c("at")).alias("diagonal")).agg(F.collect_set("at").alias("voted"), F.max("n_words").alias("n_words"), F.sum((c("p") < 0).cast("long")).alias("copies"))
    # Each diagonal with those up to slack words further on: all that an occurrence that starts there can use.
    near = Window.partitionBy(*key, "template").orderBy("diagonal").rangeBetween(0, max([0, *(t.slack for t in templates)]))
    spans = votes.withColumn("near", F.collect_list(F.struct("diagonal", "voted")).over(near))
    near = F.filter("near", lambda x: x["diagonal"] <= c("diagonal") + c("slack"))
    places = F.array_sort(F.flatten(F.transform(near, lambda x: F.transform(x["voted"], lambda at: F.struct(at.alias("at"), (x["diagonal"] + at).alias("p"))))))
    none = F.struct(F.lit(-1).alias("at"), F.lit(-(1 << 62)).cast("long").alias("p"), F.lit(0).alias("n"))

    def follow(acc: Column, x: Column) -> Column:
        """The first place of each template position counts if it comes after that of the position before."""
        nxt = F.struct(x["at"].alias("at"), x["p"].cast("long").alias("p"), (acc["n"] + (x["p"] > acc["p"]).cast("int")).alias("n"))
        return F.when(x["at"] == acc["at"], acc).otherwise(nxt)

    spans = spans.withColumn("covered", F.when(c("template").isNotNull(), F.aggregate(places, none, follow)["n"]).otherwise(0)).withColumn("start", c("diagonal").cast("long"))
    share = c("covered") / c("n_grams")
    holds = c("template").isNotNull() & (share >= c("coverage"))
    base = holds & c("phrase")
    joined = lambda labels: F.array_join(F.sort_array(labels), ",")
    out = spans.groupBy(*key).agg(
        F.max("n_words").alias("n_words"), F.sum(F.when(base, 1).otherwise(0)).cast("long").alias("n_base"), F.min(F.when(base, c("start"))).alias("first_word"), F.max(F.when(base, c("start"))).alias("last_word"),
        joined(F.collect_set(F.when(base, c("label")))).alias("base_labels"), joined(F.collect_set(F.when(holds, c("label")))).alias("labels"), F.coalesce(F.max(F.when(holds, share)), F.lit(0.0)).alias("score"), F.max("copies").cast("int").alias("copies"),
    )
    return out.withColumn("copies", F.explode_outer(F.sequence(F.lit(1), c("copies")))).drop("text_hash", "copies")
