"""Operator 4, license scans [native]: diagonal voting of rolling word k-gram hashes.

Every k-gram of a text is hashed and joined to the places it has in the templates, a table bounded by the fixed template
list and checked for size before it is broadcast. A hit at text word p and template word t votes for the diagonal p - t;
votes are summed by diagonal, diagonals at most `drift` apart merge, and a merged span is verified by the share of the
template's k-grams that it holds (equal words, not only equal hashes). A phrase is met where one diagonal has all its
k-grams; a license text where a span holds `similarity` of them.

Null text: no words. Texts of fewer than k words hold nothing. Places that overlap all count. Rows are kept apart by a
key of their own, so null and repeated ids keep a row each. Very long texts cost their words. No rows: no rows. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arrears.llm.linededup import lower_ascii

K = 3
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_TEMPLATE_ROWS = 100_000

# Phrases with their labels, then license texts (opening or characteristic words) with theirs.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "no copyright reserved under cc0 public domain dedication"),
]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), BREAK, -1), "")


def templates(phrases: list[tuple[str, str]], texts: list[tuple[str, str]], k: int = K) -> list[tuple[int, str, bool, int, int, str]]:
    """(template, label, whether a phrase, its k-grams, place, k-gram)."""
    out = []
    for n, (label, text) in enumerate([*phrases, *texts]):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        if len(words) < k:
            raise ValueError(f"{text!r} has fewer than {k} words")
        grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        out += [(n, label, n < len(phrases), len(grams), i, g) for i, g in enumerate(grams)]
    if len(out) > MAX_TEMPLATE_ROWS:
        raise ValueError(f"{len(out)} template rows; over {MAX_TEMPLATE_ROWS} they should not be broadcast")
    return out


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, texts=TEXTS, k: int = K, drift: int = 2) -> DataFrame:
    """A row for each text (template null) and for each merged span: row, doc_id, n_words, template, label, phrase, start, stop, found, grams."""
    spark = docs.sparkSession
    known = spark.createDataFrame(templates(phrases, texts, k), "template int, label string, phrase boolean, grams int, t int, gram string")
    known = F.broadcast(known.select(F.xxhash64("gram").alias("h"), F.col("gram").alias("same"), "template", "label", "phrase", "grams", "t"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("w"))
    gram = lambda i: F.concat_ws(" ", *[F.get("w", i + j) for j in range(k)])
    grams = F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(0), F.size("w") - k), gram)).otherwise(F.array().cast("array<string>"))
    rows = rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), grams)).alias("p", "gram"))
    rows = rows.join(known, (F.xxhash64("gram") == F.col("h")) & (F.col("gram") == F.col("same")), "left")
    rows = rows.where("template is not null or p = 0").repartition("row")
    rows = rows.withColumn("diagonal", F.col("p") - 1 - F.col("t"))
    votes = rows.groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "grams", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.collect_set("t").alias("ts"), F.min("p").alias("lo"), F.max("p").alias("hi")
    )
    order = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("phrase") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > drift, F.lit(True))
    votes = votes.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order))
    merged = votes.groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "grams", "span").agg(
        F.min("diagonal").cast("long").alias("diagonal"), (F.min("lo") - 1).cast("long").alias("start"), (F.max("hi") - 1 + k).cast("long").alias("stop"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("found"),
    )
    return merged


def scan(docs: DataFrame, *, similarity: float = 0.8, **kw) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each text."""
    found = spans(docs, **kw)
    share = F.coalesce(F.col("found") / F.col("grams"), F.lit(0.0))
    base = F.coalesce(F.col("phrase") & (share == 1), F.lit(False))
    met = base | F.coalesce(~F.col("phrase") & (share >= similarity), F.lit(False))
    joined = lambda of: F.array_join(F.array_sort(F.collect_set(F.when(of, F.col("label")))), ",")
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).alias("first_word"), F.max(F.when(base, F.col("diagonal"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(met).alias("labels"),
        F.coalesce(F.max(F.when(met, share)), F.lit(0.0)).alias("score"),
    ).drop("row")
