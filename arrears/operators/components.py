"""Tables written to the shared folder, to cut lineage, and connected components over edge tables."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, on one machine, one of our own where that is unset (as in tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (path or "file:///tmp/checkpoints").rstrip("/")


class Scratch:
    """Tables written to the shared folder, to cut lineage: lost executors cost a re-read, never a recomputation.

    Tables are dropped when `drop` or `end` is called, by `release`, or when the driver ends.
    """

    alive: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/arrears-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[str] = []
        self.alive.append(self)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:04d}-{name}"

    def save(self, df: DataFrame, name: str, *, codec: str = "snappy") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._arrears_path = path
        return out

    def bucketed(self, df: DataFrame, name: str, *keys: str, buckets: int | None = None) -> DataFrame:
        """As save, but dealt and sorted by `keys`, so that joins on them need no shuffle of this table."""
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path, table = self.path(name), f"arrears_{uuid.uuid4().hex}"
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
        self.tables.append(table)
        out = self.spark.table(table)
        out._arrears_path, out._arrears_table = path, table
        return out

    def drop(self, df_or_path: DataFrame | str | None) -> None:
        path = df_or_path if isinstance(df_or_path, str) else getattr(df_or_path, "_arrears_path", None)
        if table := getattr(df_or_path, "_arrears_table", None):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self.tables.remove(table)
        if path:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)

    def end(self) -> None:
        """Drops all its tables: for when what was made of them is written."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables.clear()
        self.drop(self.root)
        self.alive.remove(self)

    @classmethod
    def release(cls, but: list[Scratch]) -> None:
        """Ends all but those named."""
        for one in [x for x in cls.alive if x not in but]:
            one.end()


@atexit.register
def _end_all() -> None:
    for one in list(Scratch.alive):
        try:
            one.end()
        except Exception:  # noqa: BLE001  the session has ended already
            pass


def hang(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and, for each, the smallest node they reach: roots hang on smaller ones, then all jump to theirs."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while ((one := root[x]) != (two := root[y])).any():
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while ((up := root[root]) != root).any():
            root = up
    return nodes, nodes[root]


def contracted(edges: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """The edges (a, b), of whole numbers, with those of each task, `chunk` at a time, replaced by stars around smallest nodes."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            node, low = hang(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in "ab"))
            own = node != low
            return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(low[own])], ["a", "b"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return edges.mapInArrow(stars, "a long, b long")


def stars(edges: DataFrame) -> bool:
    """Whether every node of `edges` (a, b) either hangs on one other or has others hanging on it: the steps change nothing then."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return nodes.where("up > 1 or (up = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, *, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b), component being the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each step hangs neighbours onto the smallest
    known one, O(log^2 n) rounds, never more edges than at the start. Each task replaces the edges it has by stars first, so
    that small or chain-shaped inputs settle at once, and the rounds end when stars are left. Each round is written to the
    shared folder. A hub's edges meet only in a join, which Spark may split, and in a min(), which is combined before the
    shuffle.
    Empty input gives an empty result; self-loops and repeated edges count for nothing.
    """
    short = contracted if [t for _, t in edges.select("a", "b").dtypes] == ["bigint", "bigint"] else lambda x: x
    edges = short(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    edges = scratch.save(short(edges.distinct()), "edges")
    for _ in range(max_rounds):
        if stars(edges):
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        large = scratch.save(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b")))
        small = scratch.save(short(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), "small")
        scratch.drop(large)
        scratch.drop(edges)
        edges = small
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
