"""What the operators share: tables, tables written to the shared folder, dense offsets and connected components."""

from __future__ import annotations

import gc
import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.operators.components import Scratch, connected_components, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget_shuffles(spark: SparkSession) -> None:
    """Shuffle files of queries that are done go now: Spark removes them once the driver holds their plans no more."""
    gc.collect()
    spark._jvm.System.gc()


def worker_cache() -> dict:
    """A dict that lives as long as this Python worker; functions sent by value have no module state of their own."""
    return sys.modules.setdefault("_arrears_worker_cache", types.ModuleType("_arrears_worker_cache")).__dict__


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_rows(df: DataFrame) -> DataFrame:
    """df with each row packed as the one column `row`, so that no column added later clashes with its own."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"))


def unpacked(rows: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The packed rows' columns, and the added ones; a column that has an added one's name gives way to it."""
    own = [c for c in columns if c.lower() not in {a.lower() for a in added}]
    rows = rows.select("row", F.struct(F.lit(0).alias("none_"), *[v.alias(k) for k, v in added.items()]).alias("added"))
    return rows.select(*[F.col("row")[c].alias(c) for c in own], *[F.col("added")[k].alias(k) for k in added])


def row_keyed(df: DataFrame, name: str = "_row") -> DataFrame:
    """Adds a key of the row itself, so null and repeated ids keep their rows apart. Stable for one scan only: save before using it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def running_starts(df: DataFrame, size_col: str, order: list[str], scratch: Scratch, *, out: str = "at") -> tuple[DataFrame, int]:
    """df with the sum of size_col over all rows that come before in `order`, and the total.

    Rows are range-sorted, so equal keys need a last column that tells them apart if none may pile up in one task. Only one
    number a partition reaches the driver.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql import types as T

    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def local(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(size_col).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = at + np.cumsum(sizes)
            cols = [*batch.columns, pa.array(ends - sizes), pa.array(np.full(len(sizes), part, np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "_at", "_part"])
            at = int(ends[-1]) if len(ends) else at

    schema = T.StructType([*df.schema.fields, T.StructField("_at", T.LongType()), T.StructField("_part", T.IntegerType())])
    rows = scratch.save(ranged.mapInArrow(local, schema), "starts")
    sums = sorted((r._part, r.n) for r in rows.groupBy("_part").agg(F.sum(size_col).alias("n")).collect())
    base, total = [], 0
    for part, n in sums:
        base.append((part, total))
        total += n
    bases = scratch.spark.createDataFrame(base, "_part int, _base long")  # a row a partition
    return rows.join(F.broadcast(bases), "_part").select(*df.columns, (F.col("_at") + F.col("_base")).alias(out)), total
