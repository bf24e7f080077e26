"""Query op4: license phrases and texts in every document."""

from pyspark.sql import DataFrame, SparkSession

from arrears.llm import licenses
from arrears.llm._common import table


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


_ROWS = ", ".join(f"({n}, '{label}', {phrase}, {grams}, {t}, '{gram}')" for n, label, phrase, grams, t, gram in licenses.templates(licenses.PHRASES, licenses.TEXTS))
SQL = rf"""
WITH known(template, label, phrase, grams, t, gram) AS (VALUES {_ROWS}),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(len(w) - 2)) AS p, w FROM w WHERE len(w) >= 3),
h AS (SELECT doc_id, template, label, phrase, grams, t, p, p - t AS diagonal FROM (SELECT doc_id, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS gram FROM g) JOIN known USING (gram)),
d AS (SELECT DISTINCT doc_id, template, phrase, diagonal FROM h),
e AS (SELECT *, phrase OR coalesce(diagonal - lag(diagonal) OVER o > 2, true) AS apart FROM d WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
f AS (SELECT *, sum(apart::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM e),
m AS (SELECT h.doc_id, h.label, h.phrase, h.grams, f.span, h.template, min(h.diagonal) AS diagonal, count(DISTINCT h.t) / h.grams AS share
      FROM h JOIN f ON h.doc_id = f.doc_id AND h.template = f.template AND h.diagonal = f.diagonal GROUP BY h.doc_id, h.label, h.phrase, h.grams, f.span, h.template),
r AS (SELECT *, phrase AND share = 1 AS base, (phrase AND share = 1) OR (NOT phrase AND share >= 0.8) AS met FROM m)
SELECT w.doc_id, len(w.w) AS n_words, count(*) FILTER (WHERE r.base) AS n_base,
       min(r.diagonal) FILTER (WHERE r.base) AS first_word, max(r.diagonal) FILTER (WHERE r.base) AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT r.label) FILTER (WHERE r.base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT r.label) FILTER (WHERE r.met)), ','), '') AS labels,
       coalesce(max(r.share) FILTER (WHERE r.met), 0.0)::DOUBLE AS score
FROM w LEFT JOIN r ON w.doc_id = r.doc_id GROUP BY w.doc_id, w.w
"""
