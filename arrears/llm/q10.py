"""Query op10: the documents that hold a benchmark item, and where. The oracle looks at all windows, without fingerprints."""

from pyspark.sql import DataFrame, SparkSession

from arrears.llm import decontam
from arrears.llm._common import table


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "similarity")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ig AS (SELECT item_id, len(w) AS size, t, list_aggregate(w[t + 1 : t + 5], 'string_agg', ' ') AS gram FROM iw, LATERAL (SELECT unnest(range(greatest(len(w) - 4, 1))) AS t) WHERE len(w) > 0),
im AS (SELECT item_id, gram, count(*) AS m FROM ig GROUP BY ALL),
it AS (SELECT item_id, sum(m) AS n FROM im GROUP BY ALL),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dg AS (SELECT doc_id, p, list_aggregate(w[p + 1 : p + 5], 'string_agg', ' ') AS gram FROM dw, LATERAL (SELECT unnest(range(len(w) - 4)) AS p)),
st AS (SELECT DISTINCT doc_id, size, greatest(p - t, 0) AS start FROM dg JOIN ig USING (gram)),
wg AS (SELECT st.doc_id, st.size, st.start, dg.gram, count(*) AS m FROM st JOIN dg ON st.doc_id = dg.doc_id AND dg.p >= st.start AND dg.p <= st.start + st.size - 5 GROUP BY ALL),
wt AS (SELECT doc_id, size, start, sum(m) AS n FROM wg GROUP BY ALL),
sh AS (SELECT wg.doc_id, wg.size, wg.start, im.item_id, sum(least(wg.m, im.m)) AS shared FROM wg JOIN im USING (gram) JOIN iw ON iw.item_id = im.item_id AND len(iw.w) = wg.size GROUP BY ALL),
si AS (SELECT sh.doc_id, sh.item_id, sh.start, sh.size, shared / (wt.n + it.n - shared) AS similarity FROM sh JOIN wt USING (doc_id, size, start) JOIN it USING (item_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS k FROM si WHERE similarity >= 0.8)
SELECT best.doc_id, item_id, start, least(size, len(dw.w) - start) AS n_words, similarity FROM best JOIN dw USING (doc_id) WHERE k = 1
"""
