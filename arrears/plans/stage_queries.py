"""Driver queries over the stages and helpers: detection with its verdicts, levels, parsers, logs, chains, matching, streams, sinks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrears.functions import patterns as P
from arrears.functions import text as X
from arrears.operators import evalstats as E
from arrears.operators import graph, joins, score
from arrears.operators.components import Scratch
from arrears.plans import pipeline
from arrears.plans.graph_queries import _CH, _E, _H, _SIM, commit_files, edges, similar_parts
from arrears.plans.text_queries import _L, WORDS, _case, _re, doc_lines
from arrears.sources import files as S
from arrears.sources import sinks
from arrears.sources.files import table
from arrears.streaming import commits as stream

LEADS = ["# // ", "# // TODO: ", "# // a workaround, not ideal: "]
EXT = {"en": ".js", "de": ".py", "fr": ".rb"}


def _files(spark, d):
    """Documents as source files: each line becomes a comment, every third document's with a marker, every third one's with a phrase."""
    ext = F.lit("")
    for lang, e in EXT.items():
        ext = F.when(F.col("lang") == lang, e).otherwise(ext)
    lead = F.element_at(F.array(*[F.lit(x) for x in LEADS]), (F.col("doc_id") % 3 + 1).cast("int"))
    marked = F.concat(lead, F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.concat(F.lit("\n"), lead)))
    return table(spark, d, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), ext).alias("file"), ext.alias("ext"), marked.alias("text"))


def detect_flags(spark, d):
    """Candidates by the words, the local scorer's verdict at the threshold as a flag, no row dropped."""
    found = pipeline.detect(pipeline.candidates(_files(spark, d), WORDS, context=0), quick=False, transparent=True)
    return found.select("file", "line", F.lower("matched_pattern").alias("word"), "is_actual", F.round("confidence", 6).alias("confidence"), "debt_type", "id")


def detect_accepted(spark, d):
    found = pipeline.detect(pipeline.candidates(_files(spark, d), WORDS, context=0), quick=False)
    return found.groupBy("debt_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("confidence"), 6).alias("best"))


def replay_classes(spark, d):
    own = S.lines(_files(spark, d), "text", "file", "ext").withColumn("comment", X.is_replay_comment(F.col("content"), F.col("ext")))
    return own.groupBy("ext", "comment", X.classify(F.col("content"), P.EVAL_CLASSES, P.EVAL_DEFAULT_CLASS).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def detection_levels(spark, d):
    """Lines that a scan at each level would take, by language."""
    own = S.lines(_files(spark, d), "text", "file").withColumn("language", X.language(F.col("file")))
    n = lambda level, how, name: F.sum(F.col("content").rlike(X.alternation(how(level))).cast("long")).alias(name)
    return own.groupBy("language").agg(
        F.count(F.lit(1)).alias("lines"), n("basic", X.scanned, "basic_scan"), n("basic", X.listed, "basic_list"), n("comprehensive", X.listed, "full_list"),
        F.sum(X.explicit(F.col("content"), P.MARKERS_RE).cast("long")).alias("markers"),
    )


def diff_summaries(spark, d):
    diff = F.concat(F.lit("+++ file\n+"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n-")))
    return table(spark, d, "documents").select("doc_id", F.md5(X.diff_summary(diff, 600)).alias("summary_md5"))


def answers_parsed(spark, d):
    size, upper = F.col("p_size").cast("string"), F.col("p_partkey") % 2 == 0
    verdict = F.concat(F.when(upper, "CLASSIFICATION: TRUE").otherwise("classification: false"), F.lit("\nConfidence: "), size, F.col("p_partkey").cast("string"))
    level = F.concat(F.lit("Assessment:"), F.element_at(F.array(*[F.lit(x) for x in (" high", " PARTIAL", "LOW", " none")]), (F.col("p_partkey") % 4 + 1).cast("int")))
    plan = F.concat(F.lit("WHY_NOW: "), F.col("p_name"), F.lit("\nSTEPS:\n1. "), F.col("p_type"), F.lit("\n2. test\nBENEFITS:\n- "), F.col("p_brand"), F.lit("\nRISKS:\n1. none\nPRIORITY: high"))
    v, f, p = X.parse_classification(verdict), X.parse_fix_potential(level), X.parse_plan(plan)
    return table(spark, d, "part").select(
        "p_partkey", v["is_satd"].alias("is_satd"), F.round(v["confidence"], 6).alias("confidence"), f["level"].alias("level"), f["value"].alias("value"),
        p["why_now"].alias("why_now"), F.array_join(p["steps"], "|").alias("steps"), F.array_join(p["benefits"], "|").alias("benefits"), F.array_join(p["risks"], "|").alias("risks"), p["priority"].alias("priority"),
    )


def log_commits(spark, d):
    """Orders written as a log of headers and file names, and read back as commits."""
    key = F.col("o_orderkey")
    head = table(spark, d, "orders").select(
        (key % 64).alias("source"), F.concat(F.lpad(key.cast("string"), 15, "0"), F.lit("-0")).alias("n"),
        F.concat_ws("|", F.md5(key.cast("string")), F.col("o_custkey").cast("string"), F.lit("a@b.c"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("o_orderpriority")).alias("value"),
    )
    rest = table(spark, d, "lineitem").select((F.col("l_orderkey") % 64).alias("source"), F.concat(F.lpad(F.col("l_orderkey").cast("string"), 15, "0"), F.lit("-1")).alias("n"), F.concat(F.lit("src/"), F.col("l_partkey").cast("string")).alias("value")).distinct()
    known = table(spark, d, "orders").select(F.concat(F.lpad(key.cast("string"), 15, "0"), F.lit("-1")).alias("n"))
    got = S.parse_log(head.union(rest.join(known, "n", "left_semi").select("source", "n", "value")))
    return got.select("hash", "author", "email", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "message", F.array_join("files", ",").alias("files"))


def grep_rows(spark, d):
    row = F.concat_ws(":", F.concat(F.lit("C"), F.lit(":/src/"), F.col("p_brand")), F.col("p_partkey").cast("string"), F.concat(F.col("p_name"), F.lit(": x")))
    r = S.parse_grep(row)
    return table(spark, d, "part").select(r["file"].alias("file"), X.base_name(r["file"]).alias("base"), X.folder(r["file"]).alias("folder"), r["line"].alias("line"), r["content"].alias("content"))


def blamed_lines(spark, d):
    """Parts as found lines; the ones returned by an order have that order's hash, the others none."""
    found = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"))
    own = table(spark, d, "lineitem").where("l_returnflag = 'R'").join(found.withColumnRenamed("line", "l_partkey"), "l_partkey")
    blame = own.groupBy("file", F.col("l_partkey").alias("line")).agg(F.max(F.col("l_orderkey")).cast("string").alias("hash"), F.max("l_shipdate").cast("timestamp").alias("ts"))
    return S.with_blame(found, blame).groupBy("file", (F.col("hash") == "untracked").alias("untracked")).agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last"))


def commits_after(spark, d):
    """Orders within three months after a snapshot: their number and mean days since, by priority."""
    at = F.lit("1995-03-01").cast("timestamp")
    own = S.commits_after(table(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp")), at, 3)
    return own.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(X.days_between(F.col("ts"), at)), 6).alias("days"))


def last_definition(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return joins.last_definition(ev, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def touched_neighbours(spark, d):
    """Whether a neighbour of a part was ever returned, as a column of every part."""
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("other"))
    near = graph.neighbours(similar_parts(spark, d)).join(back, "other", "left_semi")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_brand")
    return joins.exists(parts, near, "node", "touched").groupBy("p_brand", "touched").agg(F.count(F.lit(1)).alias("n"))


def all_components(spark, d):
    """Every part with its component, those without an edge too."""
    return graph.components(similar_parts(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("node")))


def neighbour_map(spark, d):
    return graph.neighbours(edges(spark, d)).groupBy((F.col("node") % 10).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node").alias("nodes"), F.sum("other").alias("s"))


def chain_totals(spark, d):
    e = similar_parts(spark, d)
    return graph.chain_totals(e, graph.components(e)).select("chain", "edges", F.round("total_weight", 6).alias("total_weight"))


def chain_files(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("file"))
    return graph.chain_files(graph.components(similar_parts(spark, d)), items).select(F.col("component").alias("first_node"), "length", F.array_join("files", ",").alias("files"))


def mean_chain_length(spark, d):
    return graph.mean_length(graph.chains(similar_parts(spark, d)))


def chain_of_node(spark, d):
    """All parts of the chain that holds the smallest part with an edge."""
    e = similar_parts(spark, d)
    first = e.agg(F.min(F.least("src", "dst")).alias("n")).first().n
    return graph.chain_members(graph.components(e), F.lit(first)).select("node")


def edge_ends(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_name", "p_size")
    return graph.described(similar_parts(spark, d), nodes, "p_name", "p_size").select("src", "dst", "src_p_name", "dst_p_name", "src_p_size", "dst_p_size")


def outgoing_edges(spark, d):
    nodes = table(spark, d, "nation").select((F.col("n_nationkey") * 10 + 2).alias("node")).union(table(spark, d, "supplier").select(F.col("s_suppkey") * 10 + 1))
    got = graph.outgoing(nodes, edges(spark, d))
    return got.select("node", F.size("out").alias("n"), F.array_join(F.transform("out", lambda x: F.concat_ws(":", x["dst"].cast("string"), x["type"])), ",").alias("out"))


def bottleneck_reach(spark, d):
    return graph.path_features(edges(spark, d), mode="max_edge").select("node", F.round("reach", 6).alias("reach"))


def matching_by_type(spark, d):
    """Even documents as detections, those of quality as truth, on the same line only."""
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("file"), F.col("doc_id").alias("line"), "doc_id", F.coalesce("lang", F.lit("none")).alias("kind"))
    truth = docs.join(table(spark, d, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id")
    m = E.matching(docs.where("doc_id % 2 = 0"), truth.select(docs.columns), "file", "line", "doc_id", "kind", 0)
    return m.select("kind", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _marked(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang")), "doc_id")


def agreement_cells(spark, d):
    return E.agreement_cells(_marked(spark, d), F.col("quality") == 1, F.col("toxic") == 0, ["lang"])


def consensus_match(spark, d):
    named = lambda c: F.when(F.col(c) == 1, " SATD ").otherwise("non-satd").alias(c)
    return E.consensus(_marked(spark, d).select("doc_id", "lang", named("quality"), named("toxic")), "quality", "toxic")


def truth_stats(spark, d):
    return E.truth_stats(_marked(spark, d), "quality", "lang").select("lang", "n", "positive", F.round("share", 6).alias("share"), F.col("all").cast("int").alias("all"))


def edge_precision(spark, d):
    verdict = F.element_at(F.array(*[F.lit(x) for x in ("valid", "plausible", "invalid")]), (F.col("p_size") % 3 + 1).cast("int"))
    return E.edge_precision(table(spark, d, "part").select(verdict.alias("verdict")), "verdict").select(F.round("strict", 6).alias("strict"), F.round("lenient", 6).alias("lenient"))


def chain_targets(spark, d):
    """Share of rows in each class against a target of a third, and how well the counts agree."""
    share = E.distribution(table(spark, d, "lineitem"), "l_returnflag").withColumn("target", F.lit(100 / 3))
    got = E.within(share, "pct", "target", 10.0)
    return got.select("l_returnflag", "n", "ok", F.round(E.count_accuracy(F.col("pct"), F.col("target")), 6).alias("accuracy"))


def kappa_interval(spark, d):
    return E.bootstrap_kappa(table(spark, d, "labels"), "quality", "toxic")


def replay_sink(spark, d):
    """Rows as the replay's sink writes them, to CSV and read again."""
    scratch = Scratch(spark)
    path = scratch.path("csv")
    rows = table(spark, d, "part").select("p_partkey", F.array("p_brand", "p_type").alias("chain"), (F.col("p_size") > 25).alias("early"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("note"))
    sinks.write_csv(sinks.replay_rows(rows), path)
    return S.csv(spark, path).select("p_partkey", "chain", "early", F.coalesce("note", F.lit("")).alias("note"))


def export_rows(spark, d):
    part = table(spark, d, "part")
    items = part.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"), F.col("p_name").alias("content"), F.col("p_type").alias("debt_type"),
        F.when(F.col("p_size") % 3 > 0, F.col("p_size") / 50).alias("sir"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") / 50).alias("confidence"), F.lit(None).cast("string").alias("hash"),
    )
    return sinks.export_csv(items)


def _stream(spark, rows, schema, scratch):
    """A stream of two batches, the earlier half first, each written by as many tasks as hold it. The later half has no more files
    than the earlier one, so that no batch mixes them. Where they part is not exact, which nothing depends on."""
    folder = scratch.path("stream")
    middle = next(iter(rows.approxQuantile("n", [0.5], 0.01)), 0)
    rows.where(F.col("n") <= middle).drop("n").write.mode("append").parquet(folder)
    files = max(1, len(spark.read.schema(schema).parquet(folder).inputFiles()))
    rows.where(F.col("n") > middle).drop("n").coalesce(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def stream_window(spark, d):
    """Events as commits of ten repositories: how many lie in the window of the last 50 at each, and the oldest there."""
    scratch = Scratch(spark)
    rows = table(spark, d, "events").select((F.col("user_id") % 10).alias("repo"), F.col("event_id").alias("hash"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("n"))
    counted = stream.count_window(_stream(spark, rows, rows.drop("n").schema, scratch))
    out, schema = scratch.path("window"), counted.schema
    stream.run_available(counted, lambda df, n: df.write.mode("append").parquet(out), scratch.path("state"))
    return spark.read.schema(schema).parquet(out)


def stream_rank(spark, d):
    """Orders arrive as commits and each batch is ranked over the parts it concerns, by direct and neighbouring files."""
    scratch = Scratch(spark)
    own = commit_files(spark, d).groupBy("hash", "author", "ts").agg(F.array_sort(F.collect_set("file")).alias("files"))
    rows = own.select("hash", "author", F.col("ts").cast("timestamp").alias("ts"), "files", F.col("hash").cast("double").alias("n"))
    items = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("file"), (F.col("p_size") / 64).alias("sir"), (F.col("p_size") % 8 / 8).alias("effort"), F.lit(0.5).alias("fix"))
    near, nobody = similar_parts(spark, d), spark.createDataFrame([], "dev bigint, file bigint, mods bigint, total bigint")
    out = scratch.path("ranked")

    def rank(df, n):
        ranked = score.commit_rank(items, S.commit_files(df), near, nobody)
        ranked.select("hash", "node", "rel", "score").write.mode("append").parquet(out)

    seen = stream.distinct_commits(_stream(spark, rows, rows.drop("n").schema, scratch), late="36500 days")
    stream.run_available(seen, rank, scratch.path("state"))
    schema = T.StructType([T.StructField(c, t) for c, t in (("hash", T.LongType()), ("node", T.LongType()), ("rel", T.DoubleType()), ("score", T.DoubleType()))])
    return spark.read.schema(schema).parquet(out).select("hash", "node", F.round("rel", 6).alias("rel"), F.round("score", 6).alias("score"))


_ALL = (
    detect_flags, detect_accepted, replay_classes, detection_levels, diff_summaries, answers_parsed, log_commits, grep_rows, blamed_lines, commits_after, last_definition,
    touched_neighbours, all_components, neighbour_map, chain_totals, chain_files, mean_chain_length, chain_of_node, edge_ends, outgoing_edges, bottleneck_reach, matching_by_type,
    agreement_cells, consensus_match, truth_stats, edge_precision, chain_targets, kappa_interval, replay_sink, export_rows, stream_window, stream_rank,
)
QUERIES = {f.__name__: f for f in _ALL}


def _sum(column, patterns, literal):
    """How many of the patterns a text holds."""
    return " + ".join(f"regexp_matches({column}, '(?i)\\b({(X.escape(p) if literal else p).replace(chr(39), chr(39) * 2)})\\b')::INT" for p in patterns)


def _any(patterns):
    return "'(?i)\\b(" + "|".join(X.escape(p).replace("'", "''") for p in patterns) + ")\\b'"


_LEAD = "(['" + "', '".join(LEADS) + "'])[doc_id % 3 + 1]"
_EXT = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXT.items()) + " ELSE '' END"
_FL = f"""fl AS (SELECT file, ext, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line
FROM (SELECT coalesce(source, 'none') || '/' || doc_id || {_EXT} AS file, {_EXT} AS ext, {_LEAD} || replace(coalesce(text, ''), chr(10), chr(10) || {_LEAD}) AS text FROM documents))"""
_CL = lambda c, classes, default: _case(c, {k: [w.replace("'", "''") for w in v] for k, v in classes.items()}, default)
_DT = f"""{_FL}, c AS (SELECT file, line, content, lower(regexp_extract(content, {_any(WORDS)}, 1)) AS word, {_sum('content', P.EXPLICIT_RE, False)} AS e, {_sum('content', P.IMPLICIT_RE, False)} AS i FROM fl WHERE regexp_matches(content, {_any(WORDS)})),
dt AS (SELECT file, line, word, round(CASE WHEN e > 0 THEN least(1.0, 0.8 + 0.05 * least(e, 4)) WHEN i > 0 THEN 0.6 + 0.05 * least(i, 4) ELSE 0.2 END, 6)::DOUBLE AS confidence, e + i > 0 AS satd,
{_CL("(content || ' ' || content)", P.CLASSES, P.DEFAULT_CLASS)} AS debt_type, 'satd-' || substr(md5(file || ':' || line || ':' || content), 1, 12) AS id FROM c)"""
_MK = "mk AS (SELECT labels.doc_id, coalesce(lang, 'none') AS lang, quality, toxic FROM labels JOIN documents USING (doc_id))"
_FI = "fi AS (SELECT DISTINCT l_orderkey AS hash, l_partkey AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
ORACLES = {
    "detect_flags": f"WITH {_DT} SELECT file, line, word, satd AND confidence >= 0.7 AS is_actual, confidence, debt_type, id FROM dt",
    "detect_accepted": f"WITH {_DT} SELECT debt_type, count(*) AS n, max(confidence) AS best FROM dt WHERE satd AND confidence >= 0.7 GROUP BY debt_type",
    "replay_classes": f"WITH {_FL} SELECT ext, ext <> '' AS comment, {_CL('content', P.EVAL_CLASSES, P.EVAL_DEFAULT_CLASS)} AS kind, count(*) AS n FROM fl GROUP BY ALL",
    "detection_levels": f"""WITH {_FL}, l AS (SELECT CASE ext WHEN '.js' THEN 'javascript' WHEN '.py' THEN 'python' ELSE 'generic' END AS language, content FROM fl)
      SELECT language, count(*) AS lines, sum(regexp_matches(content, {_any(['TODO', 'FIXME', *P.IMPLICIT])})::INT)::BIGINT AS basic_scan, sum(regexp_matches(content, {_any(['TODO', 'FIXME'])})::INT)::BIGINT AS basic_list,
      sum(regexp_matches(content, {_any(P.ALL)})::INT)::BIGINT AS full_list, sum(regexp_matches(content, {_re(P.MARKERS_RE)})::INT)::BIGINT AS markers FROM l GROUP BY language""",
    "diff_summaries": """WITH t AS (SELECT doc_id, '+++ file' || chr(10) || '+' || replace(coalesce(text, ''), chr(10), chr(10) || '-') AS diff FROM documents),
      k AS (SELECT doc_id, diff, list_filter(string_split(diff, chr(10)), lambda x: NOT starts_with(x, '+++') AND NOT starts_with(x, '---')) AS rows FROM t)
      SELECT doc_id, md5(CASE WHEN length(diff) <= 600 THEN diff ELSE list_reduce(list_prepend('', rows), lambda a, x: CASE WHEN length(a) + length(x) + 1 <= 600 THEN a || x || chr(10) ELSE a END) || '... (truncated)' END) AS summary_md5 FROM k""",
    "answers_parsed": """SELECT p_partkey, p_partkey % 2 = 0 AS is_satd, least(100, (p_size || '' || p_partkey)::BIGINT) / 100 AS confidence, ['HIGH', 'PARTIAL', 'LOW', 'LOW'][p_partkey % 4 + 1] AS level, ([1.0, 0.5, 0.0, 0.0][p_partkey % 4 + 1])::DOUBLE AS value,
      p_name AS why_now, p_type || '|test' AS steps, p_brand AS benefits, 'none' AS risks, 'HIGH' AS priority FROM part""",
    "log_commits": f"WITH {_FI}, g AS (SELECT hash, string_agg('src/' || file, ',' ORDER BY 'src/' || file) AS files FROM fi GROUP BY hash) SELECT md5(o_orderkey::VARCHAR) AS hash, o_custkey::VARCHAR AS author, 'a@b.c' AS email, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts, o_orderpriority AS message, coalesce(files, '') AS files FROM orders LEFT JOIN g ON o_orderkey = hash",
    "grep_rows": "SELECT 'C:/src/' || p_brand AS file, p_brand AS base, 'C:/src' AS folder, p_partkey::INT AS line, p_name || ': x' AS content FROM part",
    "blamed_lines": "WITH r AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT p_brand AS file, l_partkey IS NULL AS untracked, count(*) AS n, max(p_partkey) AS last FROM part LEFT JOIN r ON l_partkey = p_partkey GROUP BY ALL",
    "commits_after": "SELECT o_orderpriority, count(*) AS n, round(avg(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-03-01')) / 86400000000, 6) AS days FROM orders WHERE o_orderdate > TIMESTAMP '1995-03-01' AND epoch_us(o_orderdate) <= epoch_us(TIMESTAMP '1995-03-01') + 7890048000000 GROUP BY o_orderpriority",
    "last_definition": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1",
    "touched_neighbours": f"WITH {_SIM}, b AS (SELECT src AS x, dst AS y FROM sp UNION SELECT dst, src FROM sp), t AS (SELECT DISTINCT x FROM b WHERE y IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')) SELECT p_brand, x IS NOT NULL AS touched, count(*) AS n FROM part LEFT JOIN t ON x = p_partkey GROUP BY ALL",
    "all_components": f"WITH RECURSIVE {_CH} SELECT p_partkey AS node, coalesce(first_node, p_partkey) AS component FROM part LEFT JOIN m ON node = p_partkey",
    "neighbour_map": f"WITH {_E}, n AS (SELECT src AS node, dst AS other FROM e UNION SELECT dst, src FROM e) SELECT node % 10 AS kind, count(*) AS n, count(DISTINCT node) AS nodes, sum(other)::BIGINT AS s FROM n GROUP BY kind",
    "chain_totals": f"WITH RECURSIVE {_CH} SELECT first_node AS chain, count(*) AS edges, round(sum(w), 6)::DOUBLE AS total_weight FROM sp JOIN m ON src = node GROUP BY first_node",
    "chain_files": f"WITH RECURSIVE {_CH} SELECT first_node, count(*) AS length, string_agg(DISTINCT p_type || '/' || p_size, ',' ORDER BY p_type || '/' || p_size) AS files FROM m JOIN part ON node = p_partkey GROUP BY first_node",
    "mean_chain_length": f"WITH RECURSIVE {_CH} SELECT count(*) AS chains, coalesce(round(avg(n), 2), 0) AS mean_length FROM (SELECT count(*) AS n FROM m GROUP BY first_node)",
    "chain_of_node": f"WITH RECURSIVE {_CH} SELECT node FROM m WHERE first_node = (SELECT min(first_node) FROM m)",
    "edge_ends": f"WITH {_SIM} SELECT src, dst, a.p_name AS src_p_name, b.p_name AS dst_p_name, a.p_size AS src_p_size, b.p_size AS dst_p_size FROM sp JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey",
    "outgoing_edges": f"WITH {_E}, n AS (SELECT n_nationkey * 10 + 2 AS node FROM nation UNION ALL SELECT s_suppkey * 10 + 1 FROM supplier) SELECT node, count(src)::INT AS n, coalesce(string_agg(dst || ':' || type, ',' ORDER BY dst, type), '') AS out FROM n LEFT JOIN e ON src = node GROUP BY node",
    "bottleneck_reach": f"""WITH {_E}, {_H}, p AS (SELECT src, dst, w FROM h UNION ALL SELECT a.src, b.dst, greatest(a.w, b.w) FROM h a JOIN h b ON a.dst = b.src), q AS (SELECT src, dst, max(w) AS w FROM p GROUP BY ALL),
      n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, round(coalesce(sum(w), 0), 6)::DOUBLE AS reach FROM n LEFT JOIN q ON src = node GROUP BY node""",
    "matching_by_type": """WITH t AS (SELECT coalesce(lang, 'none') AS kind, doc_id % 2 = 0 AS f, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS t FROM documents),
      c AS (SELECT kind, count(*) FILTER (f AND t) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (t AND NOT f) AS fn FROM t WHERE f OR t GROUP BY kind)
      SELECT kind, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1 FROM c""",
    "agreement_cells": f"""WITH {_MK}, b AS (SELECT lang, quality = 1 AS a, toxic = 0 AS b FROM mk) SELECT lang, count(*) AS n, count(*) FILTER (a) AS a_yes, count(*) FILTER (b) AS b_yes, count(*) FILTER (a AND b) AS both_yes, count(*) FILTER (NOT a AND NOT b) AS both_no,
      count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, round(avg((a = b)::INT), 4) AS observed FROM b GROUP BY lang""",
    "consensus_match": f"WITH {_MK} SELECT doc_id, lang, CASE quality WHEN 1 THEN 'satd' ELSE 'non-satd' END AS quality, CASE toxic WHEN 1 THEN 'satd' ELSE 'non-satd' END AS toxic, (quality = 1) = (toxic = 1) AS match FROM mk",
    "truth_stats": f"WITH {_MK} SELECT lang, count(*) AS n, sum(quality)::BIGINT AS positive, round(avg(quality), 6) AS share, grouping(lang)::INT AS all FROM mk GROUP BY CUBE (lang)".replace("AS all", 'AS "all"'),
    "edge_precision": "SELECT round(avg((p_size % 3 = 0)::INT), 6) AS strict, round(avg((p_size % 3 < 2)::INT), 6) AS lenient FROM part",
    "chain_targets": "WITH c AS (SELECT l_returnflag, count(*) AS n, 100 * count(*) / sum(count(*)) OVER () AS pct FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, n, abs(pct - 100 / 3) <= 10 AS ok, round(least(pct, 100 / 3) / greatest(pct, 100 / 3), 6)::DOUBLE AS accuracy FROM c",
    "replay_sink": "SELECT p_partkey::VARCHAR AS p_partkey, p_brand || ';' || p_type AS chain, (p_size > 25)::INT::VARCHAR AS early, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS note FROM part",
    "export_rows": "SELECT p_partkey::VARCHAR AS id, p_brand AS file, p_size AS line, p_name AS content, p_type AS debt_type, CASE WHEN p_size % 3 > 0 THEN printf('%.3f', p_size / 50) ELSE '' END AS sir, CASE WHEN p_size % 4 > 0 THEN printf('%.1f', p_size / 50 * 100) ELSE '' END AS confidence, '' AS commit FROM part",
    "stream_window": "SELECT user_id % 10 AS repo, event_id AS hash, row_number() OVER w AS index, least(50, row_number() OVER w)::INT AS in_window, first_value(event_id) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS oldest FROM events WINDOW w AS (PARTITION BY user_id % 10 ORDER BY ts, event_id)",
    "stream_rank": f"""WITH {_SIM}, {_FI}, nb AS (SELECT src, dst FROM sp UNION SELECT dst, src FROM sp),
      z AS (SELECT hash, file AS node, 1 AS d, 0 AS n FROM fi UNION ALL SELECT hash, dst, 0, 1 FROM fi JOIN nb ON file = src), y AS (SELECT hash, node, 0.5 * max(d) + 0.3 * max(n) AS rel FROM z GROUP BY hash, node)
      SELECT hash, node, rel::DOUBLE AS rel, round(0.4 * p_size / 64 + 0.3 * rel + 0.15 * (1 - p_size % 8 / 8) + 0.075, 6)::DOUBLE AS score FROM y JOIN part ON node = p_partkey""",
}
