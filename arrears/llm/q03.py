"""Query op3: every page archived, then read back from the archives."""

from pyspark.sql import DataFrame, SparkSession

from arrears.llm import warc
from arrears.llm._common import Scratch, table


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    folder = scratch.path("archives")
    index = scratch.save(warc.write(table(spark, sf_dir, "pages"), folder), "index")
    return warc.read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS low FROM p GROUP BY html)
SELECT p.page_id, strlen(p.html) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT) >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN p.page_id = f.low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> f.low THEN f.low END AS refers_to
FROM p JOIN f ON p.html = f.html
"""
