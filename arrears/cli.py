"""Commands (§2.18): sid, ird, sir, analyze, export; results are folders of Parquet, JSON or CSV."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from arrears.functions import patterns as P
from arrears.operators import graph, relate
from arrears.plans import pipeline
from arrears.sources import sinks
from arrears.sources.files import commits, tree


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="arrears")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("sid", "ird", "sir", "analyze"):
        p = sub.add_parser(name)
        p.add_argument("-r", "--repo", required=name in ("sid", "ird", "analyze"))
        p.add_argument("-i", "--input")
        p.add_argument("-o", "--output", required=True)
        p.add_argument("-t", "--threshold", type=float, default=P.TAU)
        p.add_argument("--quick", action="store_true")
        p.add_argument("-c", "--commits", help="a JSON table of commits: hash, author, email, ts, message, files")
        p.add_argument("-k", "--hops", type=int, default=P.MAX_HOPS)
        for flag, w in zip(("alpha", "beta", "gamma"), P.SIR_WEIGHTS, strict=True):
            p.add_argument(f"-{flag[0]}", f"--{flag}", type=float, default=w)
    p = sub.add_parser("export")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-f", "--format", choices=["json", "csv", "graph"], default="json")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("arrears").getOrCreate()
    if a.command == "sid":
        pipeline.numbered(pipeline.detect(pipeline.candidates(tree(spark, a.repo)), tau=a.threshold, quick=a.quick)).write.mode("overwrite").parquet(f"{a.output}/items")
    elif a.command == "ird":
        items = spark.read.parquet(f"{a.input}/items")
        relate.discover(tree(spark, a.repo), items.select("node", "file", "line"), k=a.hops).write.mode("overwrite").parquet(f"{a.output}/edges")
    elif a.command == "sir":
        edges = spark.read.parquet(f"{a.input}/edges")
        graph.sir(edges, weights=(a.alpha, a.beta, a.gamma), max_path_hops=a.hops).write.mode("overwrite").parquet(f"{a.output}/scores")
    elif a.command == "analyze":
        known = commits(spark, a.commits) if a.commits else None
        for name, df in pipeline.analyze(spark, a.repo, tau=a.threshold, quick=a.quick, k=a.hops, weights=(a.alpha, a.beta, a.gamma), commits=known).items():
            df.write.mode("overwrite").parquet(f"{a.output}/{name}")
    else:
        items = spark.read.parquet(f"{a.input}/items")
        if a.format == "json":
            sinks.write_json(items, a.output)
        elif a.format == "csv":
            from pyspark.sql import functions as F

            known = items if "hash" in items.columns else items.withColumn("hash", F.lit(None).cast("string"))
            sinks.write_csv(sinks.export_csv(known), a.output)
        else:
            sinks.store_graph(items, spark.read.parquet(f"{a.input}/edges"), a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
