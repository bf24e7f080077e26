"""Driver queries over evaluation statistics, replay, sampling, streaming and detectors."""

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from arrears.operators import evalstats as E
from arrears.operators import joins, models, ranking, replay, sampling
from arrears.operators.components import Scratch
from arrears.plans.graph_queries import commit_files
from arrears.sources.files import table
from arrears.streaming import commits as stream


def prf1(spark, d):
    lab = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    c = E.confusion(lab, F.col("quality") == 1, F.col("toxic") == 0, ["lang"])
    return c.select("lang", "tp", "fp", "fn", "tn", *[x.alias(n) for x, n in zip([F.round(c, 6) for c in E.prf(F.col("tp"), F.col("fp"), F.col("fn"))], ("precision", "recall", "f1"), strict=True)])


def micro_macro(spark, d):
    lab = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    m = E.micro_macro(E.confusion(lab, F.col("quality") == 1, F.col("toxic") == 0, ["lang"]))
    return m.select("kind", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def cohen_kappa(spark, d):
    return E.cohen_kappa(table(spark, d, "labels"), "quality", "toxic").select("n", *[F.round(c, 6).alias(c) for c in ("p_o", "p_e", "kappa")])


def _ranks(spark, d):
    sold = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("sold"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal").join(sold, "s_suppkey", "left").withColumn("sold", F.coalesce("sold", F.lit(0)))
    s = ranking.positions(s, [F.desc("s_acctbal"), F.asc("s_suppkey")], out="a")
    return ranking.positions(s, [F.desc("sold"), F.asc("s_suppkey")], out="b")


def spearman(spark, d):
    return E.spearman(_ranks(spark, d), "a", "b").select("n", F.round("rho", 6).alias("rho"))


def kendall(spark, d):
    return E.kendall(_ranks(spark, d), "a", "b").select("n", F.round("tau", 6).alias("tau"))


def kendall_ties(spark, d):
    s = table(spark, d, "part").select("p_size", F.floor(F.col("p_retailprice") / 50).alias("price"))
    return E.kendall(s, "p_size", "price").select("n", F.round("tau", 6).alias("tau"))


def _orders_ranked(spark, d):
    """Each customer's parts by how often they were bought: a ranking; the last order's parts: what was addressed."""
    files = commit_files(spark, d)
    counts = files.groupBy(F.col("author").alias("dev"), F.col("file").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    ranked = ranking.per_group(counts, ["dev"], [F.desc("n"), F.asc("id")], k=2_000_000_000, out="rank")
    last = ranking.per_group(files.select("author", "hash", "ts").distinct(), ["author"], [F.desc("ts"), F.desc("hash")])
    return ranked, files.join(last.select("author", "hash"), ["author", "hash"]).select(F.col("author").alias("dev"), F.col("file").alias("id"))


def hit_at_k_mrr(spark, d):
    ranked, done = _orders_ranked(spark, d)
    h = E.hits(ranked, done, ["dev"], "id").join(table(spark, d, "customer").select(F.col("c_custkey").alias("dev"), "c_mktsegment"), "dev")
    m = E.mrr(h, ["c_mktsegment"])
    return m.select("c_mktsegment", "n_events", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_3", "hit_at_5", "hit_at_10", "mrr")])


def co_removal(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_brand")
    items = part.select(F.col("p_type").alias("grp"), "p_brand", F.col("p_partkey").alias("id"), F.col("p_size").alias("at"))
    events = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).alias("day"))
    return replay.co_removal_band(items, events, "grp", ["p_brand"], "at", 1).select("grp", "pairs", F.col("removed").cast("long").alias("removed"), F.round("rate", 6).alias("rate"))


def totals_rollup(spark, d):
    part = table(spark, d, "part").select("p_type", F.lit(1).cast("long").alias("n"), F.col("p_size").cast("long").alias("size"))
    return replay.totals(part, "p_type", ["n", "size"])


def lead_time(spark, d):
    files = commit_files(spark, d).select("hash", "ts", F.col("file").alias("id")).join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("rank")), ["hash", "id"])
    months = files.withColumn("index", F.year("ts") * 12 + F.month("ts"))
    events = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("index"))
    lead = replay.lead_time(months, events, top=2)
    return lead.select("id", "seen", "done", "early")


def addressed_events(spark, d):
    """Each turn of a role and its next one as before and after states of a file; sentences of the earlier one are the instances."""
    conv = table(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), "role").alias("file"), "conv_id", "turn", F.explode(F.split(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), r"\. ")).alias("text"))  # ASCII, as DuckDB measures bytes
    turns = conv.select("file", "turn").distinct().withColumn("then", F.lead("turn").over(W.partitionBy("file").orderBy("turn"))).where("then is not null")
    hash_of = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("hash")
    before = conv.join(turns, ["file", "turn"]).select(hash_of, "file", "text")
    after = conv.withColumnRenamed("turn", "then").join(turns, ["file", "then"]).select(hash_of, "file", "text")
    inst = before.select(F.md5(F.concat_ws("|", "file", "text")).alias("id"), "file", F.col("text").alias("content")).distinct()
    return replay.addressed(inst, before, after).select("hash", "id", "reason", F.round("best", 6).alias("best"))


def _replayed(spark, d):
    """Parts as items of a hundred projects, orders as commits, the first return of a part as what addresses it."""
    project = (F.col("l_partkey") % 100).alias("project")
    li = table(spark, d, "lineitem").select(project, "l_orderkey", (F.col("l_partkey") % 3000).cast("string").alias("file"), F.col("l_partkey").alias("id"), "l_returnflag")
    made = li.select("project", "l_orderkey").distinct().join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    made = made.select("project", "l_orderkey", (F.row_number().over(W.partitionBy("project").orderBy("o_orderdate", "l_orderkey")) - 1).cast("long").alias("index"))
    li = li.join(made, ["project", "l_orderkey"])
    items = table(spark, d, "part").select(
        (F.col("p_partkey") % 100).alias("project"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("place"), (F.col("p_partkey") % 3000).cast("string").alias("file"),
        F.col("p_type").alias("chain"), (F.col("p_size") / 64).alias("sir"), (F.floor(F.col("p_retailprice")) % 32 / 32).alias("effort"),
    )
    return items, li.select("project", "index", "file"), li.where("l_returnflag = 'R'").select("project", "id", "index")


def replay_hits(spark, d):
    return replay.replay_hits(*_replayed(spark, d))


def co_removal_control(spark, d):
    events = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).alias("day"))
    items = table(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_type").alias("chain"))
    return replay.co_removal_control(items, events, "grp").select("grp", "pairs", "removed", F.round("rate", 6).alias("rate"))


def quantity_spread(spark, d):
    return E.spread(table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("q")), "q", ["l_returnflag"]).select(
        "l_returnflag", "n", "least", "greatest", F.round("mean", 6).alias("mean"), "median", "commonest"
    )


def label_outcomes(spark, d):
    found = table(spark, d, "labels").where("quality = 1").select("doc_id")
    truth = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return E.outcomes(found, truth, ["doc_id"])


def word_overlap(spark, d):
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    return table(spark, d, "part").select("p_partkey", F.round(E.overlap(words("p_name"), words("p_type")), 6).alias("share"))


def event_deltas(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_type", (F.col("event_id") % 2).alias("half"))
    counts = lambda h: ev.where(F.col("half") == h).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return E.deltas(counts(0), counts(1), ["user_id", "event_type"], "n")


def histogram_pct(spark, d):
    return E.distribution(table(spark, d, "documents"), "lang", ["source"]).select("source", "lang", "n", F.round("pct", 6).alias("pct"))


def stratified_sample(spark, d):
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 20)


def rating_summary(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", ((F.col("l_quantity").cast("int") - 1) % 5 + 1).alias("rating"))
    r = E.likert(li, "rating", ["l_returnflag"])
    return r.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("share_high", 6).alias("share_high"))


def disagreements(spark, d):
    lab = table(spark, d, "labels").withColumn("good", 1 - F.col("toxic"))
    return E.disagreements(lab, "quality", "good", 1).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


def greedy_match(spark, d):
    part = table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("file"), F.col("p_size").alias("line"), "p_partkey", "p_retailprice")
    found, truth = part.where("p_retailprice < 940"), part.where("p_retailprice >= 940")
    return joins.greedy_match(found, truth, "file", "line", "p_partkey", 2)


def bootstrap_ci(spark, d):
    r = table(spark, d, "labels").agg(F.avg(F.col("quality").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n")).first()
    return E.bootstrap_rate(spark, r.rate or 0.0, r.n)


def fisher(spark, d):
    rows = {r.toxic: r for r in table(spark, d, "labels").groupBy("toxic").agg(F.avg(F.col("quality").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n")).collect()}  # two rows
    p = E.fisher_one_sided(rows[0].n, rows[0].rate, rows[1].n, rows[1].rate) if len(rows) == 2 else 1.0
    return spark.createDataFrame([(round(p, 6),)], "p double")


def stream_commit_rank(spark, d):
    """Events as a stream of commits, taken in file order: running counts by user and type after the last batch."""
    events = table(spark, d, "events")
    scratch = Scratch(spark)
    folder, out = scratch.path("events"), scratch.path("counts")
    parts = events.select(F.col("event_id").alias("hash"), F.col("user_id").alias("author"), F.col("ts").cast("timestamp").alias("ts"), F.array("event_type").alias("files"))
    parts.repartitionByRange(4, "ts").write.parquet(folder)
    rows = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    seen = stream.developer_counts(stream.distinct_commits(rows, late="36500 days"))
    stream.run_available(seen, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out), scratch.path("state"), mode="update")
    schema = T.StructType([*seen.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(out).groupBy("author", "file").agg(F.max_by("mods", "batch").alias("mods"))


def word_graph(spark, d):
    g = models.word_graph(table(spark, d, "benchmark"), "item_id")
    rounded = [F.round(c, 6).alias(c) for c in ("degree_mean", "degree_std", "density", "clustering", "coverage")]
    return g.select("item_id", "nodes", "edges", "degree_max", "components", *rounded)


def _labelled(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").where("text is not null")
    return models.split(rows.select("doc_id", "text", F.col("quality").cast("double").alias("label")), "doc_id")


def _scored(detector, train, test):
    c = E.confusion(detector.train(train).detect(test), F.col("is_satd"), F.col("label") == 1)
    return c.select("tp", "fp", "fn", "tn", *E.prf(F.col("tp"), F.col("fp"), F.col("fn")))


def detector_lr(spark, d):
    return _scored(models.logistic(), *_labelled(spark, d))


def detector_rf(spark, d):
    return _scored(models.forest(20), *_labelled(spark, d))


_F = (replay_hits, co_removal_control, quantity_spread, label_outcomes, word_overlap, event_deltas, prf1, micro_macro, cohen_kappa, spearman, kendall, kendall_ties, hit_at_k_mrr, co_removal, totals_rollup, lead_time, addressed_events, histogram_pct, stratified_sample, rating_summary, disagreements,
    greedy_match, bootstrap_ci, fisher, stream_commit_rank, word_graph, detector_lr, detector_rf,
)
QUERIES = {f.__name__: f for f in _F}

_CM = "cm AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fp, count(*) FILTER (quality <> 1 AND toxic = 0) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 0) AS tn FROM labels JOIN documents USING (doc_id) GROUP BY lang)"
_PRF = "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"
_RK = "rk AS (SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS a, row_number() OVER (ORDER BY coalesce(sold, 0) DESC, s_suppkey) AS b FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS sold FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey)"
_CF = "cf AS (SELECT DISTINCT l_orderkey AS hash, l_partkey AS file, o_custkey AS author, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
ORACLES = {
    "prf1": f"WITH {_CM} SELECT lang, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT *, {_PRF} FROM cm)",
    "micro_macro": f"WITH {_CM} SELECT 'macro' AS kind, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM (SELECT {_PRF} FROM cm) UNION ALL SELECT 'micro', round(precision, 6), round(recall, 6), round(f1, 6) FROM (SELECT {_PRF} FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cm))",
    "cohen_kappa": "WITH t AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS p_o, avg((quality = 1)::INT) * avg((toxic = 1)::INT) + avg((quality = 0)::INT) * avg((toxic = 0)::INT) AS p_e FROM labels) SELECT n, round(p_o, 6) AS p_o, round(p_e, 6) AS p_e, round((p_o - p_e) / (1 - p_e), 6) AS kappa FROM t",
    "spearman": f"WITH {_RK} SELECT count(*) AS n, round(1 - 6 * sum((a - b) * (a - b))::DOUBLE / (count(*)::DOUBLE * (count(*) * count(*) - 1)), 6) AS rho FROM rk",
    "kendall": f"WITH {_RK} SELECT (SELECT count(*) FROM rk) AS n, round(avg(sign((x.a - y.a) * (x.b - y.b))), 6) AS tau FROM rk x JOIN rk y ON x.a < y.a",
    "kendall_ties": "WITH rk AS (SELECT row_number() OVER () AS i, p_size AS a, floor(p_retailprice / 50) AS b FROM part) SELECT (SELECT count(*) FROM rk) AS n, round(avg(sign(x.a - y.a) * sign(x.b - y.b)), 6) AS tau FROM rk x JOIN rk y ON x.i < y.i",
    "hit_at_k_mrr": f"""WITH {_CF}, r AS (SELECT author, file, row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, file) AS rank FROM cf GROUP BY author, file),
      l AS (SELECT author, file FROM (SELECT author, file, dense_rank() OVER (PARTITION BY author ORDER BY ts DESC, hash DESC) AS k FROM cf) WHERE k = 1),
      h AS (SELECT author, min(rank) AS f FROM l JOIN r USING (author, file) GROUP BY author)
      SELECT c_mktsegment, count(*) AS n_events, round(avg((f <= 1)::INT), 6) AS hit_at_1, round(avg((f <= 3)::INT), 6) AS hit_at_3, round(avg((f <= 5)::INT), 6) AS hit_at_5, round(avg((f <= 10)::INT), 6) AS hit_at_10, round(avg(1 / f), 6) AS mrr FROM h JOIN customer ON c_custkey = author GROUP BY c_mktsegment""",
    "co_removal": """WITH f AS (SELECT l_partkey AS id, min(date_diff('day', DATE '1990-01-01', l_shipdate::DATE)) AS day FROM lineitem GROUP BY l_partkey),
      p AS (SELECT a.p_type AS grp, a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) <= 1)
      SELECT grp, count(*) AS pairs, sum(coalesce((abs(x.day - y.day) <= 30)::INT, 0))::BIGINT AS removed, round(avg(coalesce((abs(x.day - y.day) <= 30)::INT, 0)), 6) AS rate FROM p LEFT JOIN f x ON x.id = a LEFT JOIN f y ON y.id = b GROUP BY grp""",
    "totals_rollup": "SELECT CASE WHEN grouping(p_type) = 1 THEN 'ALL' ELSE p_type END AS p_type, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY ROLLUP (p_type)",
    "lead_time": """WITH m AS (SELECT l_partkey AS id, l_linenumber AS rank, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      s AS (SELECT id, min(i) AS seen FROM m WHERE rank <= 2 GROUP BY id), e AS (SELECT l_partkey AS id, min(year(l_shipdate) * 12 + month(l_shipdate))::INT AS done FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)
      SELECT id, seen, done, done - seen >= 5 AS early FROM s JOIN e USING (id)""",
    "addressed_events": r"""WITH c AS (SELECT conv_id || '/' || role AS file, conv_id, turn, unnest(string_split(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), '. ')) AS text FROM conversations),
      n AS (SELECT file, turn, lead(turn) OVER (PARTITION BY file ORDER BY turn) AS later FROM (SELECT DISTINCT file, turn FROM c)),
      b AS (SELECT DISTINCT conv_id || '/' || c.turn AS hash, c.file, c.text FROM c JOIN n ON c.file = n.file AND c.turn = n.turn WHERE later IS NOT NULL),
      a AS (SELECT DISTINCT conv_id || '/' || n.turn AS hash, c.file, c.text FROM c JOIN n ON c.file = n.file AND c.turn = n.later),
      s AS (SELECT b.hash, md5(b.file || '|' || b.text) AS id, max(CASE WHEN substr(a.text, 1, 500) = substr(b.text, 1, 500) THEN 1.0 WHEN a.text = '' OR b.text = '' THEN 0.0
        ELSE 1 - levenshtein(substr(a.text, 1, 500), substr(b.text, 1, 500)) / greatest(length(substr(a.text, 1, 500)), length(substr(b.text, 1, 500))) END) AS best FROM b JOIN a USING (hash, file) GROUP BY ALL)
      SELECT hash, id, CASE WHEN best < 0.2 THEN 'removed' ELSE 'modified' END AS reason, round(best, 6) AS best FROM s WHERE best < 0.5""",
    "replay_hits": """WITH o AS (SELECT DISTINCT l_partkey % 100 AS project, l_orderkey FROM lineitem),
      c AS (SELECT project, l_orderkey, row_number() OVER (PARTITION BY project ORDER BY o_orderdate, l_orderkey) - 1 AS i FROM o JOIN orders ON o_orderkey = l_orderkey),
      f AS (SELECT DISTINCT project, i, l_partkey % 3000 AS file FROM lineitem l JOIN c ON c.l_orderkey = l.l_orderkey AND c.project = l.l_partkey % 100),
      e AS (SELECT project, l_partkey AS id, min(i) AS done FROM lineitem l JOIN c ON c.l_orderkey = l.l_orderkey AND c.project = l.l_partkey % 100 WHERE l_returnflag = 'R' GROUP BY ALL),
      p AS (SELECT p_partkey % 100 AS project, p_partkey AS id, p_partkey % 3000 AS file, p_type AS chain, p_size / 64.0::DOUBLE AS sir, floor(p_retailprice) % 32 / 32.0::DOUBLE AS effort FROM part),
      t AS (SELECT DISTINCT e.project, done AS i FROM e JOIN p ON e.project = p.project AND e.id = p.id),
      w AS (SELECT t.project, t.i, f.file, sum(f.i - greatest(t.i - 50, 0) + 1)::DOUBLE AS steps, bool_or(f.i = t.i - 1) AS latest FROM t JOIN f ON f.project = t.project AND f.i < t.i AND f.i >= t.i - 50 GROUP BY ALL),
      m AS (SELECT project, i, max(steps) AS most FROM w GROUP BY ALL), h AS (SELECT DISTINCT w.project, w.i, p.chain FROM w JOIN p ON w.project = p.project AND w.file = p.file WHERE latest),
      l AS (SELECT t.project, t.i, p.id, coalesce(done = t.i, false) AS hit, coalesce(steps, 0) AS recency, -effort AS effort, sir,
        CASE WHEN t.i = 0 THEN sir ELSE 0.4::DOUBLE * sir + 0.3::DOUBLE * coalesce(steps / most, 0) + 0.15::DOUBLE * (1 - effort) + 0.15::DOUBLE * CASE WHEN latest THEN 1.0 WHEN h.chain IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE END AS full_
        FROM t JOIN p ON p.project = t.project LEFT JOIN e ON e.project = p.project AND e.id = p.id LEFT JOIN w ON w.project = t.project AND w.i = t.i AND w.file = p.file
        LEFT JOIN m ON m.project = t.project AND m.i = t.i LEFT JOIN h ON h.project = t.project AND h.i = t.i AND h.chain = p.chain WHERE done IS NULL OR done >= t.i),
      s AS (SELECT project, i, id, hit, unnest(['recency', 'effort', 'sir', 'full']) AS strategy, unnest([recency, effort, sir, full_]) AS score FROM l),
      r AS (SELECT *, row_number() OVER (PARTITION BY project, i, strategy ORDER BY score DESC, id) AS rank FROM s)
      SELECT project, i AS index, strategy, min(rank) AS first_rank FROM r WHERE hit GROUP BY ALL""",
    "co_removal_control": """WITH f AS (SELECT l_partkey AS id, min(date_diff('day', DATE '1990-01-01', l_shipdate::DATE)) AS day FROM lineitem GROUP BY l_partkey),
      p AS (SELECT a.p_brand AS grp, abs(x.day - y.day) <= 30 AS near FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type <> b.p_type AND a.p_partkey < b.p_partkey LEFT JOIN f x ON x.id = a.p_partkey LEFT JOIN f y ON y.id = b.p_partkey),
      n AS (SELECT grp, count(*) AS pairs, sum(coalesce(near, false)::INT)::BIGINT AS removed FROM p GROUP BY grp)
      SELECT grp, coalesce(pairs, 0) AS pairs, coalesce(removed, 0) AS removed, round(coalesce(removed / pairs, 0), 6) AS rate FROM (SELECT DISTINCT p_brand AS grp FROM part) LEFT JOIN n USING (grp)""",
    "quantity_spread": """WITH v AS (SELECT l_returnflag, l_quantity::DOUBLE AS q FROM lineitem), c AS (SELECT l_returnflag, q, count(*) AS n FROM v GROUP BY l_returnflag, q),
      m AS (SELECT l_returnflag, q AS commonest FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, q) AS k FROM c) WHERE k = 1)
      SELECT v.l_returnflag, count(*) AS n, min(v.q) AS least, max(v.q) AS greatest, round(avg(v.q), 6) AS mean, median(v.q) AS median, any_value(m.commonest) AS commonest
      FROM v JOIN m ON v.l_returnflag = m.l_returnflag GROUP BY v.l_returnflag""",
    "label_outcomes": """WITH f AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), t AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en')
      SELECT coalesce(f.doc_id, t.doc_id) AS doc_id, CASE WHEN f.doc_id IS NULL THEN 'missed' WHEN t.doc_id IS NULL THEN 'spurious' ELSE 'matched' END AS outcome FROM f FULL JOIN t ON f.doc_id = t.doc_id""",
    "word_overlap": """WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)
      SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS share FROM w""",
    "event_deltas": """SELECT user_id, event_type, count(*) FILTER (WHERE event_id % 2 = 0) AS before, count(*) FILTER (WHERE event_id % 2 = 1) AS after,
      count(*) FILTER (WHERE event_id % 2 = 1) - count(*) FILTER (WHERE event_id % 2 = 0) AS change FROM events GROUP BY ALL""",
    "histogram_pct": "SELECT source, lang, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS pct FROM documents GROUP BY source, lang",
    "stratified_sample": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) AS k FROM documents) WHERE k <= 20",
    "rating_summary": "SELECT l_returnflag, count(*) AS n, round(avg(r), 6) AS mean, round(avg((r >= 4)::INT), 6) AS share_high FROM (SELECT l_returnflag, (l_quantity::INT - 1) % 5 + 1 AS r FROM lineitem) GROUP BY l_returnflag",
    "disagreements": "SELECT CASE WHEN quality = 1 THEN 'FP' ELSE 'FN' END AS kind, count(*) AS n, min(doc_id) AS first FROM labels WHERE quality <> 1 - toxic GROUP BY kind",
    "stream_commit_rank": "SELECT user_id AS author, event_type AS file, count(*) AS mods FROM events GROUP BY ALL",
    "word_graph": r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda v: regexp_full_match(v, '[a-z]+')) AS a FROM benchmark),
      x AS (SELECT item_id, unnest(a) AS w, unnest(range(len(a))) AS p FROM w),
      e AS (SELECT DISTINCT s.item_id, least(s.w, t.w) AS a, greatest(s.w, t.w) AS b FROM x s JOIN x t ON s.item_id = t.item_id AND t.p - s.p BETWEEN 1 AND 3),
      d AS (SELECT item_id, w, count(*) AS g FROM (SELECT item_id, a AS w FROM e UNION ALL SELECT item_id, b FROM e) GROUP BY ALL),
      f AS (SELECT item_id, a AS w, b AS o FROM e WHERE a <> b UNION ALL SELECT item_id, b, a FROM e WHERE a <> b), k AS (SELECT item_id, w, count(*) AS k FROM f GROUP BY ALL),
      t AS (SELECT p.item_id, p.w, count(*) AS t FROM f p JOIN f q ON p.item_id = q.item_id AND p.w = q.w AND p.o < q.o JOIN f r ON r.item_id = p.item_id AND r.w = p.o AND r.o = q.o GROUP BY ALL),
      n AS (SELECT item_id, w, count(*) AS times FROM x GROUP BY ALL),
      j AS (SELECT n.item_id, times, coalesce(g, 0) AS g, CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END AS c FROM n LEFT JOIN d USING (item_id, w) LEFT JOIN k USING (item_id, w) LEFT JOIN t USING (item_id, w))
      SELECT item_id, count(*) AS nodes, (sum(g) // 2)::BIGINT AS edges, max(g) AS degree_max, 1 AS components, round(avg(g), 6) AS degree_mean, round(stddev_pop(g), 6) AS degree_std, round(count(*) / sum(times), 6) AS coverage,
      round(CASE WHEN count(*) > 2 THEN avg(c) ELSE 0 END, 6) AS clustering, round(CASE WHEN count(*) > 1 THEN sum(g) / (count(*) * (count(*) - 1)) ELSE 0 END, 6) AS density FROM j GROUP BY item_id""",
}
