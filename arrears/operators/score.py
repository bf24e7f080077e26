"""Effort, interest, relevance and rank (§2.12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears.functions import patterns as P


def file_metrics(commit_files: DataFrame, as_of: Column) -> DataFrame:
    """Churn, age in whole days since the first commit, distinct contributors of each file (hash, file, ts, author)."""
    return commit_files.groupBy("file").agg(
        F.count(F.lit(1)).alias("churn"),
        F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(F.min("ts"))) / 86400).alias("age_days"),
        F.countDistinct("author").alias("contributors"),
    )


def resolution_time(debt_type: Column, length: Column, churn: Column, age: Column, contributors: Column) -> Column:
    """R3."""
    base = F.lit(P.BASE_TIME_DEFAULT)
    for name, hours in P.BASE_TIME.items():
        base = F.when(debt_type == name, hours).otherwise(base)
    factor = F.when(churn > 50, 0.8).otherwise(1.0) * F.when(age > 365, 1.2).otherwise(1.0) * F.when(contributors > 5, 1.1).otherwise(1.0)
    return base * (1 + F.log10(length + 1) / 3) * factor


def effort(df: DataFrame, rt: str = "rt", fm: str = "churn", lam: float = P.LAMBDA, out: str = "effort") -> DataFrame:
    """Lambda RT / max RT + (1 - lambda) FM / max FM, the maxima over the rows given (a zero maximum counts as 1)."""
    top = df.agg(F.coalesce(F.nullif(F.max(rt), F.lit(0.0)), F.lit(1.0)).alias("_rt"), F.coalesce(F.nullif(F.max(fm).cast("double"), F.lit(0.0)), F.lit(1.0)).alias("_fm"))
    s = lam * F.col(rt) / F.col("_rt") + (1 - lam) * F.coalesce(F.col(fm), F.lit(0)) / F.col("_fm")
    return df.crossJoin(F.broadcast(top)).select(*df.columns, s.alias(out))  # one row


def developer_counts(commit_files: DataFrame) -> DataFrame:
    """Dev, file, mods, total."""
    own = commit_files.groupBy(F.col("author").alias("dev"), "file").agg(F.count(F.lit(1)).alias("mods"))
    total = own.groupBy("dev").agg(F.sum("mods").alias("total"))
    return own.join(total, "dev")


def interest(mods: Column, total: Column) -> Column:
    """R6."""
    return F.least(F.lit(1.0), mods / F.greatest(F.lit(10.0), 0.1 * total))


def relevance(direct: Column, neighbour: Column, dev_interest: Column) -> Column:
    """R7, D6."""
    return F.least(F.lit(1.0), 0.5 * direct.cast("int") + 0.3 * neighbour.cast("int") + 0.2 * F.coalesce(dev_interest, F.lit(0.0)))


def rank_score(sir: Column, rel: Column, effort_: Column, fix: Column, weights: tuple[float, ...] = P.RANK_WEIGHTS) -> Column:
    """Missing scores are 0."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    a, b, c, d = weights
    return a * zero(sir) + b * zero(rel) + c * (1 - zero(effort_)) + d * zero(fix)


def commit_rank(items: DataFrame, commit_files: DataFrame, edges: DataFrame, interests: DataFrame, *, weights: tuple[float, ...] = P.RANK_WEIGHTS) -> DataFrame:
    """The items (node, file, sir, effort, fix) that a commit (author, files as rows) concerns, with rel > 0 and their rank score.

    Direct: the commit touches the item's file; neighbour: it touches a neighbour's; interest: its author's in the file.
    """
    touched = commit_files.select("hash", "author", "file").distinct()
    direct = items.join(touched, "file").select("hash", "author", "node", F.lit(1).alias("direct"), F.lit(0).alias("near"), F.lit(0.0).alias("i"))
    near = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    near = items.select(F.col("node").alias("other"), "file").join(touched, "file").select("hash", "author", "other").distinct().join(near, F.col("other") == F.col("src"))
    near = near.select("hash", "author", F.col("dst").alias("node"), F.lit(0).alias("direct"), F.lit(1).alias("near"), F.lit(0.0).alias("i"))
    keen = touched.select("hash", "author").distinct().join(interests, F.col("author") == F.col("dev")).join(items.select("node", "file"), "file")
    keen = keen.select("hash", "author", "node", F.lit(0).alias("direct"), F.lit(0).alias("near"), interest(F.col("mods"), F.col("total")).alias("i"))
    parts = direct.union(near).union(keen).groupBy("hash", "author", "node").agg(F.max("direct").alias("direct"), F.max("near").alias("near"), F.max("i").alias("i"))
    parts = parts.withColumn("rel", relevance(F.col("direct"), F.col("near"), F.col("i"))).where("rel > 0")
    return parts.join(items, "node").withColumn("score", rank_score(F.col("sir"), F.col("rel"), F.col("effort"), F.col("fix"), weights))
