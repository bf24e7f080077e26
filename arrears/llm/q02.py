"""Query op2: SimHash fingerprints and components. XXH64 is not a DuckDB function, so tests hold it to brute force."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm import simhash
from arrears.llm._common import table


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
