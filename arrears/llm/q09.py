"""Query op9: documents' token ids in training order, written to shards and read back; tests check the round trip."""

from pyspark.sql import DataFrame, SparkSession

from arrears.llm import trainorder
from arrears.llm._common import Scratch, table


def op9_trainorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    index, layout = trainorder.materialise(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch.path("shards"), scratch=scratch)
    return trainorder.read_back(index, layout)
