"""Query op5: embedding near-duplicates; the oracle multiplies all pairs of a label."""

from pyspark.sql import DataFrame, SparkSession

from arrears.llm import neardup_vectors
from arrears.llm._common import table


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS r FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE a.r > 0 AND b.r > 0 AND list_inner_product(a.e, b.e) / (a.r * b.r) >= 0.93),
c(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a),
m AS (SELECT a, min(b) AS component_id FROM c GROUP BY a),
d AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON v.vec_id = m.a LEFT JOIN d ON v.vec_id = d.a
"""
