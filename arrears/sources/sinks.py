"""Sinks (§2.2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank(c: Column, form: Column) -> Column:
    return F.when(c.isNull(), "").otherwise(form)


def export_csv(items: DataFrame) -> DataFrame:
    """K2: eight columns; sir to three places, confidence as a percentage to one, blank where unknown."""
    return items.select(
        "id", "file", "line", "content", F.coalesce("debt_type", F.lit("")).alias("debt_type"), blank(F.col("sir"), F.format_string("%.3f", "sir")).alias("sir"),
        blank(F.col("confidence"), F.format_string("%.1f", F.col("confidence") * 100)).alias("confidence"), F.coalesce("hash", F.lit("")).alias("commit"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """K5."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    """K1, K4."""
    df.write.mode("overwrite").json(path)


def store_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K3: overwrites the graph tables; long texts cut to 500 and 1000; edges by type, so that a filter prunes."""
    cut = {"content": 500, "description": 1000}
    nodes.select(*[F.substring(c, 1, cut[c]).alias(c) if c in cut else F.col(c) for c in nodes.columns]).write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def replay_rows(df: DataFrame) -> DataFrame:
    """K6: ids joined by `;`, nulls blank, flags 0 or 1."""
    flags = [c for c, t in df.dtypes if t == "boolean"]
    return df.select(
        *[F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c).cast("int").alias(c) if c in flags else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c, t in df.dtypes]
    )


def viz(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K7, K8: one JSON row a node or edge."""
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("json")).union(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("*")).alias("json")))


def top_items(nodes: DataFrame, n: int = 100) -> DataFrame:
    """K9, O4, O5."""
    return nodes.orderBy(F.desc("sir"), "id").limit(n)


def summary(df: DataFrame, title: str) -> str:
    """A short text of a small result table."""
    rows = df.limit(100).collect()
    return "\n".join([title, *("  " + ", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows)])
