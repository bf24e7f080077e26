"""Query op1: the language of every document; not expressible in SQL (tests hold it to held-out accuracy)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm import langid
from arrears.llm._common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.train_rows(docs))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out().alias("held_out"), F.col("_langid.lang_pred"), F.col("_langid.score"), F.col("_langid.rejected"))
