"""Levels of detection, parsers of paths, features of word graphs, intervals: against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from arrears.functions import patterns as P
from arrears.functions import text as X
from arrears.operators import evalstats, graph, models


def test_levels():
    assert X.scanned("basic", implicit=False) == ["TODO", "FIXME"]
    assert X.scanned("basic", custom=["mine"]) == ["TODO", "FIXME", *P.IMPLICIT, "mine"]
    assert X.listed("standard", custom=["mine"]) == [*P.EXPLICIT, "mine"]
    assert X.listed("comprehensive") == P.ALL and X.listed("comprehensive", implicit=False) == P.EXPLICIT
    with pytest.raises(ValueError, match="level"):
        X.scanned("all")


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.TSX",), ("c.pyi",), ("a/b.c/d",)], "p string")
    got = [tuple(r) for r in df.select(X.language(F.col("p")), X.base_name(F.col("p")), X.folder(F.col("p"))).collect()]
    assert got == [("typescript", "c.TSX", "a/b"), ("python", "c.pyi", ""), ("generic", "d", "a/b.c")]


def test_word_graph(spark):
    # a-b-c are a triangle within three places; the second `a` is three places on: a loop; d hangs on b, c and a
    df = spark.createDataFrame([(1, "a b c a d"), (2, ""), (3, "x9 é_y"), (4, "one"), (5, None)], "id int, text string")
    got = {r.id: r for r in models.word_graph(df, "id").collect()}
    assert set(got) == {1, 4}
    assert (got[1].nodes, got[1].edges, got[1].components) == (4, 7, 1) and got[1].clustering == 1.0 and got[1].coverage == 0.8
    assert got[1].degree_max == 5 and abs(got[1].density - 14 / 12) < 1e-12
    assert (got[4].nodes, got[4].edges, got[4].clustering, got[4].coverage) == (1, 0, 0.0, 1.0)


def test_chains_without_edges(spark):
    none = spark.createDataFrame([], "src long, dst long, type string, weight double")
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    assert [r.out for r in graph.outgoing(nodes, none).orderBy("node").collect()] == [[], []]
    assert tuple(graph.mean_length(spark.createDataFrame([], "length long")).first()) == (0, 0.0)
    assert graph.chain_totals(none, spark.createDataFrame([], "node long, component long")).count() == 0


def test_matching_keeps_kinds_apart(spark):
    found = spark.createDataFrame([("f", 1, 1, "x"), ("f", 2, 2, "y"), (None, 9, 3, "z")], "file string, line int, n int, kind string")
    truth = spark.createDataFrame([("f", 3, 1, "x"), ("f", 2, 2, "x")], "file string, line int, n int, kind string")
    got = {r.kind: (r.tp, r.fp, r.fn) for r in evalstats.matching(found, truth, "file", "line", "n", "kind").collect()}
    assert got == {"x": (1, 0, 1), "y": (0, 1, 0), "z": (0, 1, 0)}


def test_kappa_interval_holds_kappa(spark):
    df = spark.range(900).select((F.col("id") % 3 > 0).alias("a"), (F.col("id") % 9 > 1).alias("b"))
    kappa = evalstats.cohen_kappa(df, "a", "b").first().kappa
    ci = evalstats.bootstrap_kappa(df, "a", "b").first()
    assert ci.lower < kappa < ci.upper and ci.upper - ci.lower < 0.2
