"""The replay in closed form gives what a loop over commits gives."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from arrears.operators import replay

ITEMS = "project string, id long, place long, file string, chain string, sir double, effort double"


def looped(items, commits, events, window):
    out = {}
    for project in {x[0] for x in items}:
        own = sorted([x for x in items if x[0] == project], key=lambda x: (x[2], x[1]))
        first = {}
        for p, i, at in sorted(events, key=lambda e: e[2]):
            if p == project:
                first.setdefault(i, at)
        files = [{f for p, at, f in commits if p == project and at == n} for n in range(12)]
        gone = set()
        for n in range(12):
            hit = {x[1] for x in own if first.get(x[1]) == n}
            if hit:
                recent = files[max(0, n - window) : n]
                steps = {}
                for k, touched in enumerate(recent):
                    for f in touched:
                        steps[f] = steps.get(f, 0) + k + 1
                chain = lambda x: x[4] or x[1]
                near = {chain(x) for x in own if recent and x[3] in recent[-1]}

                def full(x):
                    if not recent:
                        return x[5] or 0.0
                    fix = 1.0 if x[3] in recent[-1] else 0.5 if chain(x) in near else 0.0
                    return 0.4 * (x[5] or 0.0) + 0.3 * steps.get(x[3], 0) / max(steps.values(), default=1) + 0.15 * (1 - (x[6] or 0.0)) + 0.15 * fix

                orders = {"recency": lambda x: -steps.get(x[3], 0), "effort": lambda x: 9.0 if x[6] is None else x[6], "sir": lambda x: -(x[5] or 0.0), "full": lambda x: -round(full(x), 9)}
                for name, key in orders.items():
                    ranked = sorted([x for x in own if x[1] not in gone], key=key)
                    out[project, n, name] = next(r for r, x in enumerate(ranked, 1) if x[1] in hit)
            gone |= hit
    return out


@pytest.mark.parametrize("window", [3, 50])
def test_hits(spark, window):
    rng = random.Random(window)
    items = [(p, i, i // 2, f"f{rng.randrange(6)}", rng.choice([None, "x", "y"]), rng.choice([None, 0.1, 0.37, 0.9]), rng.choice([None, 0.2, 0.55])) for p in "pq" for i in range(14)]
    commits = [(p, n, f"f{rng.randrange(8)}") for p in "pq" for n in range(12) for _ in range(2)] + [("p", 0, "f1")] * 2
    events = [(p, rng.randrange(16), rng.randrange(12)) for p in "pq" for _ in range(12)] + [("p", 3, 0)]
    got = replay.replay_hits(
        spark.createDataFrame(items, ITEMS), spark.createDataFrame(commits, "project string, index long, file string"), spark.createDataFrame(events, "project string, id long, index long"), window=window
    ).collect()
    assert {(r.project, r["index"], r.strategy): r.first_rank for r in got} == looped(items, commits, events, window)


def test_hits_form_no_rows_of_items_and_commits(spark):
    """A project of n items, each addressed by a commit of its own: rows shuffled grow with n, not with its square."""
    n = 400
    items = spark.range(n).selectExpr("'p' as project", "id", "id as place", "concat('f', id % 7) as file", "concat('c', id % 5) as chain", "id % 11 / 16 as sir", "id % 13 / 16 as effort")
    got = replay.replay_hits(items, spark.range(n).selectExpr("'p' as project", "id as index", "concat('f', id % 7) as file"), spark.range(n).selectExpr("'p' as project", "id", "id as index"))
    assert got.count() == 4 * n
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    joined = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in joined.splitlines() if "Join" in line and "done#" in line and ">=" in line]


def test_hits_of_nothing(spark):
    none = [spark.createDataFrame([], s) for s in (ITEMS, "project string, index long, file string", "project string, id long, index long")]
    assert replay.replay_hits(*none).count() == 0


def test_control_counts_all_pairs_of_different_chains(spark):
    rng = random.Random(5)
    items = [(rng.choice("pq"), i, rng.choice([None, "x", "y"])) for i in range(40)] + [("r", 99, None)]
    days = {i: rng.randrange(90) for i in range(0, 40, 2)}
    got = replay.co_removal_control(
        spark.createDataFrame(items, "project string, id long, chain string"), spark.createDataFrame([(i, d + late) for i, d in days.items() for late in (0, 7)], "id long, day int")
    ).collect()
    pairs = [(a, b) for a, b in combinations(items, 2) if a[0] == b[0] and (a[2] or a[1]) != (b[2] or b[1])]
    near = [(a, b) for a, b in pairs if a[1] in days and b[1] in days and abs(days[a[1]] - days[b[1]]) <= 30]
    for r in got:
        n, m = (sum(a[0] == r.project for a, _ in x) for x in (pairs, near))
        assert (r.pairs, r.removed, r.rate) == (n, m, m / n if n else 0.0)
    assert {r.project for r in got} == {"p", "q", "r"}


def test_co_removal_by_counts_equals_that_over_pairs(spark):
    """Also with two rows of one id and with nulls; no self-join of the items."""
    from arrears.operators import joins

    rng = random.Random(11)
    items = [(rng.choice("pq"), rng.choice("xy"), rng.randrange(50), rng.randrange(6)) for _ in range(120)] + [(None, "x", 60, 1), ("p", None, 61, 1), ("p", "x", None, 1), ("p", "x", 62, None), ("r", "x", 70, 1), ("r", "x", 70, 2)]
    items = spark.createDataFrame(items, "grp string, brand string, id long, at int")
    events = spark.createDataFrame([(i, rng.randrange(90)) for i in range(0, 50, 2) for _ in range(2)], "id long, day int")
    pairs = joins.pairs_within(items.where("brand is not null").withColumn("k", F.concat_ws("/", "grp", "brand")).where("grp is not null"), "k", "id", "at", 1)
    want = replay.co_removal(pairs.select(F.col("a_grp").alias("grp"), F.col("a_id").alias("a"), F.col("b_id").alias("b")), events)
    got = replay.co_removal_band(items, events, "grp", ["brand"], "at", 1)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} != set()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("abs(") == 0
