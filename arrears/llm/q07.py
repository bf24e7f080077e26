"""Query op7: documents packed along a Hilbert curve; not expressible in SQL (tests check the round trip)."""

from pyspark.sql import DataFrame, SparkSession

from arrears.llm import packing
from arrears.llm._common import table


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
