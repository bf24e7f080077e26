"""Query op8: documents with pseudonyms for personal data. SHA-256 Feistel rounds have no plain SQL; tests hold it to brute force."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm import pii
from arrears.llm._common import table

KEY = "pseudonym-key"  # a query has no secret to keep; give the operator one of your own


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=KEY)
    return out.select("doc_id", F.col("_n_found").alias("n_found"), F.col("_kinds").alias("kinds"), F.col("_text").alias("text"))
