"""Driver queries over text: scans, patterns, classes, ids, context, similarity."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.functions import text as X
from arrears.operators import joins, ranking
from arrears.sources.files import lines, table

WORDS = ["license", "token", "password", "version", "public", "the", "with"]
CLASSES = {"Legal": ["license", "licensed", "public"], "Secret": ["password", "token", "@"], "Plain": ["the ", "die ", "el ", "le "]}
PART_CLASSES = {"Metal": ["steel", "tin", "copper", "nickel", "brass"], "Large": ["large", "economy"], "Small": ["small", "medium"]}


def doc_lines(spark: SparkSession, d: str, context: int | None = None) -> DataFrame:
    return lines(table(spark, d, "documents"), "text", "doc_id", "source", "lang", context=context)


def sid_quick(spark, d):
    found = doc_lines(spark, d).where(F.col("content").rlike(X.alternation(WORDS[:5])))
    typed = found.withColumn("debt_type", X.classify(F.col("content"), CLASSES, "Other"))
    return typed.groupBy("source", "debt_type").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


def scan_lines(spark, d):
    return doc_lines(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("content")).alias("n_chars"), F.max("line").alias("longest"))


def lexical_filter(spark, d):
    return doc_lines(spark, d).where(F.col("content").rlike(X.alternation(WORDS[:5]))).select("doc_id", "line", F.lower(X.first_match(F.col("content"), WORDS[:5])).alias("word"))


def first_pattern_match(spark, d):
    hit = doc_lines(spark, d).withColumn("ordinal", X.first_by_ordinal(F.col("content"), WORDS))
    return hit.where("ordinal is not null").groupBy("ordinal").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def pattern_flags(spark, d):
    flagged = table(spark, d, "documents").select("lang", X.explicit(F.col("text"), WORDS[:2]).alias("e"), X.explicit(F.col("text"), WORDS[2:5]).alias("i"))
    n = lambda c: F.sum(c.cast("int")).cast("long")
    return flagged.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), n(F.col("e")).alias("explicit"), n(F.col("i")).alias("implicit"), n(F.col("e") | F.col("i")).alias("either"))


def type_cascade(spark, d):
    name = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, d, "part").select("p_brand", X.classify(name, PART_CLASSES).alias("kind")).groupBy("p_brand", "kind").count().withColumnRenamed("count", "n")


def comment_ids(spark, d):
    file = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return doc_lines(spark, d).select(X.content_id(file, F.col("line"), F.col("content")).alias("id"), X.line_id(file, F.col("line"), F.md5("content")).alias("line_id"))


def context_window(spark, d):
    return doc_lines(spark, d, 2).select("doc_id", "line", F.md5("context").alias("context_md5"), F.length("context").alias("n"))


def tri_state_threshold(spark, d):
    v = F.col("value")
    state = F.when(v.isNull(), "unknown").when(v >= 50, "yes").otherwise("no")
    return table(spark, d, "events").groupBy("event_type", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def levenshtein_best(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    return joins.best_similarity(part, ["p_brand", "p_size"], "p_partkey", "p_name").select("p_partkey", F.round("best", 6).alias("best"))


def top_lines(spark, d):
    counts = doc_lines(spark, d).groupBy("source", "content").agg(F.count(F.lit(1)).alias("n"))
    return ranking.per_group(counts.where("content <> ''"), ["source"], [F.desc("n"), F.asc("content")], k=3, out="place").select("source", "place", "n", F.md5("content").alias("line_md5"))


QUERIES = {f.__name__: f for f in (sid_quick, scan_lines, lexical_filter, first_pattern_match, pattern_flags, type_cascade, comment_ids, context_window, tri_state_threshold, levenshtein_best, top_lines)}

_L = "SELECT doc_id, source, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS content, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line FROM documents"


def _re(words, ci="(?i)"):
    return rf"'{ci}\b({'|'.join(words)})\b'"


def _case(text, classes, default):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in ws) + f" THEN '{c}'" for c, ws in classes.items()) + f" ELSE '{default}' END"


ORACLES = {
    "sid_quick": f"SELECT source, {_case('content', CLASSES, 'Other')} AS debt_type, count(*) AS n, min(line) AS first_line FROM ({_L}) WHERE regexp_matches(content, {_re(WORDS[:5])}) GROUP BY ALL",
    "scan_lines": f"SELECT source, count(*) AS n_lines, sum(length(content))::BIGINT AS n_chars, max(line) AS longest FROM ({_L}) GROUP BY source",
    "lexical_filter": f"SELECT doc_id, line, lower(regexp_extract(content, {_re(WORDS[:5])}, 1)) AS word FROM ({_L}) WHERE regexp_matches(content, {_re(WORDS[:5])})",
    "first_pattern_match": "SELECT ordinal, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, CASE "
    + " ".join(f"WHEN regexp_matches(content, {_re([w])}) THEN {i}" for i, w in enumerate(WORDS, 1)) + f" END AS ordinal FROM ({_L})) WHERE ordinal IS NOT NULL GROUP BY ordinal",
    "pattern_flags": f"SELECT lang, count(*) AS total, sum(e::INT)::BIGINT AS explicit, sum(i::INT)::BIGINT AS implicit, sum((e OR i)::INT)::BIGINT AS either FROM (SELECT lang, regexp_matches(text, {_re(WORDS[:2])}) AS e, regexp_matches(text, {_re(WORDS[2:5])}) AS i FROM documents) GROUP BY lang",
    "type_cascade": f"SELECT p_brand, {_case(chr(39).join(['p_name || ', ' ', ' || p_type']), PART_CLASSES, 'Other')} AS kind, count(*) AS n FROM part GROUP BY ALL",
    "comment_ids": f"SELECT 'satd-' || substr(md5(source || '/' || doc_id || ':' || line || ':' || content), 1, 12) AS id, source || '/' || doc_id || '-' || line || '-' || substr(md5(content), 1, 7) AS line_id FROM ({_L})",
    "context_window": f"WITH l AS ({_L}) SELECT doc_id, line, md5(c) AS context_md5, length(c) AS n FROM (SELECT doc_id, line, string_agg(content, chr(10)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS c FROM l)",
    "tri_state_threshold": "SELECT event_type, CASE WHEN value IS NULL THEN 'unknown' WHEN value >= 50 THEN 'yes' ELSE 'no' END AS state, count(*) AS n FROM events GROUP BY ALL",
    "levenshtein_best": "SELECT a.p_partkey, round(max(CASE WHEN a.p_name = b.p_name THEN 1.0 ELSE 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) END), 6) AS best FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey GROUP BY a.p_partkey",
    "top_lines": f"SELECT source, place, n, md5(content) AS line_md5 FROM (SELECT source, content, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, content) AS place FROM ({_L}) WHERE content <> '' GROUP BY source, content) WHERE place <= 3",
}
