"""Positions, top-k and as-of choices (§2.7, §2.8) that keep rows spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from arrears.operators.components import Scratch


def positions(df: DataFrame, order: list[Column], *, out: str = "position") -> DataFrame:
    """Row numbers from 1 over all rows. Range partitions count for themselves; one count a partition reaches the driver."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = Scratch(spark).save(rows, "positions")
    part = F.shiftright("_id", 33)
    counts = sorted(map(tuple, rows.groupBy(part.alias("p")).count().collect()))
    base, n = [], 0
    for p, c in counts:
        base.append((p, n))
        n += c
    bases = spark.createDataFrame(base, T.StructType([T.StructField("_p", T.LongType()), T.StructField("_base", T.LongType())]))
    within = F.col("_id") - F.shiftleft(part, 33) + 1
    return rows.join(F.broadcast(bases), part == F.col("_p")).select(*df.columns, (within + F.col("_base")).alias(out))


def per_group(df: DataFrame, group: list[str], order: list[Column], *, k: int = 1, out: str | None = None) -> DataFrame:
    """The first k rows of each group. Spark keeps k a group before the shuffle too."""
    name = out or "_k"
    kept = df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)
    return kept if out else kept.drop(name)


def percentile_positions(df: DataFrame, order: list[Column], *, out: str = "percentile") -> DataFrame:
    """(position - 1) / (n - 1), 0 for a single row."""
    placed = positions(df, order, out="_pos")
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    return placed.crossJoin(F.broadcast(n)).select(*df.columns, ((F.col("_pos") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).alias(out))
