"""The stages end to end (§3.1): detect, relate, score, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.functions import judge
from arrears.functions import patterns as P
from arrears.functions import text as X
from arrears.operators import graph, ranking, relate, score
from arrears.operators.components import Scratch
from arrears.sources.files import commit_files, last_commits, lines, tree


def candidates(files: DataFrame, patterns: list[str] = P.ALL, *, context: int = 5) -> DataFrame:
    """Comment lines that hold a pattern, with the lines around them."""
    rows = lines(files, "text", "file", "ext", context=context)
    found = rows.where(F.col("content").rlike(X.alternation(patterns)) & X.is_comment(F.col("content"), F.col("ext")))
    return found.withColumn("matched_pattern", X.first_match(F.col("content"), patterns))


def detect(found: DataFrame, *, tau: float = P.TAU, quick: bool = True, transparent: bool = False, scorer=judge.local) -> DataFrame:
    """Confidence, type and id. quick takes every candidate; otherwise the scorer's verdict at tau, inclusive.
    transparent keeps all rows and leaves the verdict as a flag."""
    verdict = scorer(F.col("content"), F.col("context"))
    rows = found.select("*", F.explode(F.array(verdict)).alias("_v"))  # one verdict a row, however often it is read below
    accepted = F.lit(True) if quick else F.col("_v.is_satd") & (F.col("_v.confidence") >= tau)
    rows = rows.withColumn("is_actual", accepted).withColumn("confidence", F.col("_v.confidence")).drop("_v")
    rows = rows.withColumn("debt_type", X.classify(F.concat_ws(" ", "content", "context"))).withColumn("id", X.content_id(F.col("file"), F.col("line"), F.col("content")))
    return rows if transparent else rows.where("is_actual")


def numbered(items: DataFrame) -> DataFrame:
    """node numbers from 1 by file and line; no task orders all rows."""
    return ranking.positions(items, [F.asc("file"), F.asc("line")], out="node")


def analyze(spark: SparkSession, root: str, *, tau: float = P.TAU, quick: bool = True, k: int = P.MAX_HOPS, weights: tuple = P.SIR_WEIGHTS, commits: DataFrame | None = None) -> dict[str, DataFrame]:
    """I4: items with scores and ranks, edges, chains of a source tree.

    commits (hash, author, ts, files) gives effort its history, as of the newest of them, relevance to the newest of them, and
    a further table: the items that each of the last commits concerns, with their scores. Without it history counts as none.
    """
    files, scratch = tree(spark, root), Scratch(spark)
    items = scratch.save(numbered(detect(candidates(files), tau=tau, quick=quick)), "items")  # both are read many times below
    edges = scratch.save(relate.discover(files, items.select("node", "file", "line"), k=k), "edges")
    scored = graph.sir(edges, items.select("node"), weights, max_path_hops=k)
    items = scratch.save(items.join(scored, "node", "left"), "scored")
    length = F.length("content") + F.length("context")
    history = ["churn", "age_days", "contributors"]
    if commits is None:
        items = items.select("*", *[F.lit(0).alias(c) for c in history])
    else:
        touched = commit_files(commits)
        newest = touched.agg(F.max("ts").alias("_newest"))
        own = score.file_metrics(touched.crossJoin(F.broadcast(newest)), F.max("_newest"))  # one row
        items = items.join(own, "file", "left").select(*items.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in history])
    items = score.effort(items.withColumn("rt", score.resolution_time(F.col("debt_type"), length, *[F.col(c) for c in history])))
    out = {"edges": edges, "chains": graph.chains(edges, scored.select("node", "sir"))}
    if commits is None:
        items = items.withColumn("rel", F.lit(0.0))
    else:
        last = commit_files(last_commits(commits))
        ranked = score.commit_rank(items.select("node", "file", "sir", "effort", F.lit(0.0).alias("fix")), last, edges, score.developer_counts(touched))
        out["ranking"] = ranked.select("hash", "node", "rel", "score")
        head = last_commits(commits, 1).select("hash")
        items = items.join(ranked.join(F.broadcast(head), "hash").select("node", "rel"), "node", "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))
    items = items.withColumn("rank_score", score.rank_score(F.col("sir"), F.col("rel"), F.col("effort"), F.lit(0.0)))
    return {"items": items} | out
