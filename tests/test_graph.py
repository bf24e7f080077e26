import itertools
import random

import pytest
from pyspark.sql import functions as F

from arrears.operators import graph, joins

DDL = "src long, dst long, type string, weight double, hops int"


def frame(spark, edges):
    return spark.createDataFrame([(a, b, "call", w, 1) for a, b, w in edges], DDL)


def features(spark, edges, **kw):
    return {r.node: (round(r.chain_len, 9), round(r.reach, 9)) for r in graph.path_features(frame(spark, edges), **kw).collect()}


def brute(edges, mode="additive"):
    heavy = {}
    for a, b, w in edges:
        heavy[a, b] = max(w, heavy.get((a, b), 0))
    nodes = {x for e in heavy for x in e}
    out = {}
    for s in nodes:
        length, best, stack = 0.0, {}, [(s, (s,), 0.0, 0.0)]
        while stack:
            at, seen, w, top = stack.pop()
            for (a, b), x in heavy.items():
                if a != at:
                    continue
                length = max(length, w + x)
                if b not in seen:
                    best[b] = max(best.get(b, 0.0), w + x if mode == "additive" else max(top, x))
                    stack.append((b, (*seen, b), w + x, max(top, x)))
        out[s] = (round(length, 9), round(sum(best.values()), 9))
    return out


GOLDEN = [(1, 2, 0.8), (1, 3, 0.7), (2, 3, 0.6), (4, 5, 0.9)]


def test_goldens(spark):
    got = {r.node: r for r in graph.sir(frame(spark, GOLDEN)).collect()}
    assert {n: (round(r.fanout, 6), round(r.chain_len, 6), round(r.reach, 6), round(r.sir, 6)) for n, r in got.items()} == {
        1: (1.5, 1.4, 2.2, 1.0), 2: (0.6, 0.6, 0.6, 0.37039), 3: (0, 0, 0, 0), 4: (0.9, 0.9, 0.9, 0.555584), 5: (0, 0, 0, 0)}
    chains = {r.first_node: (r.length, round(r.total_weight, 6)) for r in graph.chains(frame(spark, GOLDEN)).collect()}
    assert chains == {1: (3, 2.1), 4: (2, 0.9)}
    worked = [(1, 2, 0.85), (1, 2, 0.76), (1, 3, 0.85), (1, 3, 0.76)]
    got = {r.node: r for r in graph.sir(frame(spark, worked)).collect()}
    assert (round(got[1].fanout, 6), got[1].chain_len, got[1].reach, got[1].sir, got[2].sir) == (3.22, 0.85, 1.7, 1.0, 0.0)


def test_cycles_and_self_loops(spark):
    assert features(spark, [(1, 2, 0.8), (2, 3, 0.7), (3, 1, 0.6)]) == {1: (2.1, 2.3), 2: (2.1, 2.0), 3: (2.1, 2.0)}
    assert features(spark, [(1, 1, 0.5)]) == {1: (0.5, 0.0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    edges = [(a, b, rnd.randrange(1, 16) / 16) for a, b in itertools.product(range(6), repeat=2) if rnd.random() < 0.3]
    assert features(spark, edges) == brute(edges)
    assert features(spark, edges, mode="max_edge") == brute(edges, "max_edge")


def test_components_with_singletons(spark):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "node long")
    got = {r.node: r.component for r in graph.components(frame(spark, [(1, 2, 1.0), (3, 2, 1.0), (5, 6, 1.0)]), nodes).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


def test_reach_and_shortest_paths(spark):
    e = frame(spark, [(1, 2, 0.5), (2, 3, 0.5), (3, 1, 0.5), (3, 4, 0.25), (1, 4, 1.0)])
    assert {(r.src, r.dst): r.hops for r in graph.bounded_reach(e, 2).collect()} == {(1, 2): 1, (2, 3): 1, (3, 1): 1, (3, 4): 1, (1, 4): 1, (1, 3): 2, (2, 1): 2, (2, 4): 2, (3, 2): 2}
    got = {r.dst: (r.hops, r.weight, list(r.nodes)) for r in graph.shortest_paths(e, spark.createDataFrame([(2,)], "src long")).collect()}
    assert got == {3: (1, 0.5, [2, 3]), 1: (2, 1.0, [2, 3, 1]), 4: (2, 0.75, [2, 3, 4])}


def test_merge_and_greedy(spark):
    e = spark.createDataFrame([(1, 2, "call", 0.8, 2), (1, 2, "data", 0.7, 1)], DDL)
    r = joins.merge_relationships(e).first()
    assert (r.types, r.strength, r.hop_count, len(r.edges)) == (["call", "data"], 0.8, 1, 2)
    found = spark.createDataFrame([("f", 10, 0), ("f", 12, 1), ("f", 40, 2), ("g", 1, 3)], "file string, line int, n int")
    truth = spark.createDataFrame([("f", 14, 0), ("f", 9, 1), ("f", 45, 2)], "file string, line int, n int")
    assert {(r.found, r.truth) for r in joins.greedy_match(found, truth, "file", "line", "n").collect()} == {(0, 0), (1, 1), (2, 2)}


def test_band_sums_equal_those_over_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice("pq"), rng.randrange(80), rng.randrange(9)) for _ in range(150)] + [(None, 1, 1), ("p", None, 2), ("p", 5, None), ("r", 4, 4)]
    df = spark.createDataFrame(rows, "k string, o long, at int")
    want = joins.pairs_within(df, "k", "o", "at", 2).groupBy(F.col("a_k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b_o") - F.col("a_o")).alias("s"))
    assert {tuple(r) for r in joins.band_sums(df, "k", "o", "at", 2).collect()} == {tuple(r) for r in want.collect()} != set()


@pytest.mark.parametrize("width", [0, 3])
def test_greedy_match_across_spans_takes_few_groups(spark, width):
    """Rows far apart share a task's call; stretches over the end of a span stay whole."""
    rng = random.Random(width)
    spots = lambda: [("pq"[i % 2], rng.choice([rng.randrange(60), 4096 * (width + 1) + rng.randrange(-20, 20), 10**6 + rng.randrange(30)]), i) for i in range(150)]
    found, truth = spots(), spots()
    want, used = set(), set()
    for k, at, n in found:
        m = next((m for q, other, m in truth if q == k and abs(at - other) <= width and (k, m) not in used), None)
        if m is not None:
            used.add((k, m))
            want.add((k, n, m))
    ddl = "file string, line int, n long"
    got = joins.greedy_match(spark.createDataFrame(found, ddl), spark.createDataFrame(truth, ddl), "file", "line", "n", width)
    assert {tuple(r) for r in got.collect()} == want
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert windows and not [x for x in windows if " at#" in x]


def test_neighbours_read_edges_once(spark):
    rows = [(1, 2), (2, 1), (1, 2), (3, 3), (2, 4)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    got = graph.neighbours(edges)
    assert sorted(map(tuple, got.collect())) == sorted({x for a, b in rows for x in ((a, b), (b, a))})
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
