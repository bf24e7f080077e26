"""Samples by a portable hash (§2.15): deterministic, without replacement, stable under repartitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears.operators.ranking import per_group


def stratified(df: DataFrame, by: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """N rows of each class, those with the smallest MD5 of key and seed."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))
    return per_group(df.withColumn("_h", h), [by], [F.col("_h").asc(), F.col(key).asc()], k=n).drop("_h")


def augment(text: Column, key: Column, mode: str = "delete") -> Column:
    """The text without one word, or with two neighbours swapped, at a place that a hash of the key picks."""
    words = F.split(text, " ")
    n = F.size(words)
    at = F.pmod(F.xxhash64(key), F.greatest(n - (1 if mode == "swap" else 0), F.lit(1))).cast("int")
    if mode == "delete":
        return F.array_join(F.concat(F.slice(words, F.lit(1), at), F.slice(words, at + 2, n)), " ")
    swapped = F.concat(F.slice(words, F.lit(1), at), F.slice(words, at + 2, F.lit(1)), F.slice(words, at + 1, F.lit(1)), F.slice(words, at + 3, n))
    return F.when(n > 1, F.array_join(swapped, " ")).otherwise(text)
