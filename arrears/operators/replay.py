"""Retrospective replay (§3.3, R5, R9, R10, E13-E15) in closed form: no loop over commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arrears.functions import patterns as P
from arrears.functions.text import similarity


def mean_gap(commit_files: DataFrame) -> DataFrame:
    """Per file the commits, and the mean of positive gaps in days between consecutive ones."""
    own = W.partitionBy("file").orderBy("ts", "hash")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (micros - F.lag(micros).over(own)) / 86_400_000_000
    rows = commit_files.withColumn("gap", gap)
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("churn"), F.avg(F.when(F.col("gap") > 0, F.col("gap"))).alias("gap_days"))


def recency(commit_files: DataFrame, index: int, window: int = 50) -> DataFrame:
    """Per file the sum of (i + 1) / n over the window's commits that touch it, i = 0 the oldest. Needs (index, file)."""
    last = commit_files.where((F.col("index") < index) & (F.col("index") >= index - window))
    first, n = max(0, index - window), min(index, window)
    return last.groupBy("file").agg(F.sum(F.col("index") - first + 1).alias("steps")).select("file", (F.col("steps") / F.lit(max(n, 1))).alias("recency"))


def addressed(instances: DataFrame, before: DataFrame, after: DataFrame, *, keep: float = 0.5, gone: float = 0.2) -> DataFrame:
    """Instances (id, file, content) whose line is in the commit's before-lines (hash, file, text) and not in its
    after-lines: best similarity >= keep is a cosmetic change (not addressed), < gone a removal, else a modification. New files have no before-lines."""
    had = instances.join(before.select("hash", "file", F.col("text").alias("content")).distinct(), ["file", "content"])
    lost = had.join(after.select("hash", "file", F.col("text").alias("content")).distinct(), ["hash", "file", "content"], "left_anti")
    best = lost.join(after.select("hash", "file", F.col("text").alias("other")), ["hash", "file"], "left")
    best = best.groupBy("hash", "id").agg(F.coalesce(F.max(similarity(F.col("content"), F.col("other"))), F.lit(0.0)).alias("best"))
    return best.where(F.col("best") < keep).withColumn("reason", F.when(F.col("best") < gone, "removed").otherwise("modified"))


def open_at(instances: DataFrame, events: DataFrame, index: str = "index") -> DataFrame:
    """Instances not addressed before each index: first addressed index is null or not smaller."""
    first = events.groupBy("id").agg(F.min(index).alias("first_index"))
    return instances.join(first, "id", "left")


def replay_hits(items: DataFrame, commit_files: DataFrame, events: DataFrame, *, window: int = 50, weights: tuple[float, ...] = P.RANK_WEIGHTS, blocks: int = 4) -> DataFrame:
    """For every commit that addresses items, the first rank of one of these in each of four orders of the items still open.

    items (project, id, place, file, chain, sir, effort; null chain: one of its own; null sir: 0; null effort: last by effort,
    0 in the full order), commit_files (project, index, file; index from 0 without gaps), events (project, id, index; the first one
    of an item counts, unknown items do not). Orders: recency (of the item's file, in the window before the commit), effort (least first), sir, full
    (the weighted sum with the recency over its maximum, and 1 for a file of the latest commit, 0.5 if the item's chain has
    one); without a commit before it, full is the order by sir. Ties go by place, then id. Result: project, index, strategy, first_rank.
    Only event commits are ranked. A project's commits are cut into `blocks` stretches, each of which gets the items once, so that what
    is shuffled and kept grows as the items and commits do; no row of an item and a commit is ever written.
    """
    never = F.lit(2**63 - 1)
    done = events.groupBy("project", "id").agg(F.min(F.col("index").cast("long")).alias("done"))
    chain = F.coalesce(F.col("chain").cast("string"), F.concat(F.lit("/"), F.col("id").cast("string")))
    rows = items.join(done, ["project", "id"], "left").select(
        "project", "id", "place", F.col("file").cast("string").alias("file"), chain.alias("chain"), F.coalesce(F.col("sir").cast("double"), F.lit(0.0)).alias("sir"),
        F.col("effort").cast("double").alias("effort"), F.coalesce("done", never).alias("done"),
    )
    known = done.join(items.select("project", "id"), ["project", "id"], "left_semi")
    ends = known.groupBy("project").agg((F.max("done") + 1).alias("_n")).where("_n is not null")
    block = lambda c: F.least(F.floor(c * blocks / F.col("_n")), F.lit(blocks - 1)).cast("int")
    rows = rows.join(ends, "project").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    at = F.col("index").cast("long")
    touched = commit_files.select("project", at.alias("at"), F.col("file").cast("string").alias("file")).join(ends, "project").where("at < _n - 1")
    touched = touched.select("*", F.explode(F.sequence(block(F.col("at") + 1), block(F.least(F.col("at") + window, F.col("_n") - 1)))).alias("_b"))
    names = ("recency", "effort", "sir", "full")
    project, index = (items.schema["project"].dataType.simpleString(), events.schema["index"].dataType.simpleString())

    def ranked(key, own, commits):
        return first_ranks(key[0], own[(own.done * blocks // own["_n"]).clip(upper=blocks - 1) == key[1]].done.unique() if len(own) else [], own, commits, window, weights, names)

    rows = rows.groupBy("project", "_b").cogroup(touched.select("project", "_b", "at", "file").groupBy("project", "_b"))
    ranks = rows.applyInPandas(ranked, f"project {project}, index {index}, " + ", ".join(f"{n} long" for n in names))
    return ranks.unpivot(["project", "index"], list(names), "strategy", "first_rank")


def first_ranks(project, indexes, items, commits, window: int, weights: tuple[float, ...], names: tuple[str, ...]):
    """The ranks of replay_hits at some commits of one project, from all its items and the commits that lie in their windows."""
    import numpy as np
    import pandas as pd

    wa, wb, wc, wd = weights
    items = items.sort_values(["place", "id"], na_position="first", kind="stable")
    n, done, out = len(items), items.done.to_numpy(), []
    files, named = pd.factorize(pd.concat([items.file, commits.file], ignore_index=True))
    nf = len(named)
    file, touched = np.where(files[:n] < 0, nf, files[:n]), np.where(files[n:] < 0, nf + 1, files[n:])  # a null file is no item's
    chain, chains = pd.factorize(items.chain)
    pairs = np.unique(file.astype(np.int64) * (len(chains) + 1) + chain)
    pair_file, pair_chain = pairs // (len(chains) + 1), pairs % (len(chains) + 1)
    pair_at = np.searchsorted(pair_file, np.arange(nf + 3))
    seen = np.unique(commits["at"].to_numpy().astype(np.int64) * (nf + 2) + touched)
    seen_at, seen_file = seen // (nf + 2), seen % (nf + 2)
    sir, effort = items.sir.to_numpy(), items.effort.to_numpy(dtype=float, na_value=np.nan)
    lacks = items.effort.isna().to_numpy()
    orders = {"effort": np.where(lacks, np.inf, effort), "sir": -sir}
    place = {}  # of each item in the orders that do not change
    for name, key in orders.items():
        place[name] = np.empty(n, np.int64)
        place[name][np.lexsort((np.arange(n), key))] = np.arange(n)
    by_file = np.argsort(file, kind="stable")
    start = np.searchsorted(file[by_file], np.arange(nf + 3))
    in_file = np.empty(n, np.int64)
    in_file[by_file] = np.arange(n)
    base, rest = wa * sir, wc * (1 - np.where(lacks, 0.0, effort))
    by_done = np.argsort(done, kind="stable")
    indexes = np.sort(np.asarray(indexes, dtype=np.int64))
    indexes = indexes[indexes < 2**63 - 1]
    if not len(indexes):
        return pd.DataFrame([], columns=["project", "index", *names], dtype=object)
    first, last = np.searchsorted(done[by_done], indexes), np.searchsorted(done[by_done], indexes, side="right")
    is_open = done >= indexes[0]
    opened = {name: np.empty(n, bool) for name in place}
    for name, p in place.items():
        opened[name][p] = is_open
    open_file = is_open[by_file]
    many = np.bincount(file[is_open], minlength=nf + 2)
    gain, near, closed, live = np.zeros(nf + 2), np.zeros(len(chains) + 1), 0, None
    for i, lo, hi in zip(indexes.tolist(), first, last, strict=True):
        hit = by_done[lo:hi]
        got = {name: int(np.count_nonzero(opened[name][: place[name][hit].min()])) + 1 for name in place}
        begin = max(i - window, 0)
        a, z = np.searchsorted(seen_at, (begin, i))
        used, inverse = np.unique(seen_file[a:z], return_inverse=True)
        steps = np.bincount(inverse, weights=seen_at[a:z] - begin + 1, minlength=len(used))
        own = np.zeros(len(hit))
        if len(used):
            k = np.minimum(np.searchsorted(used, file[hit]), len(used) - 1)
            own = np.where(used[k] == file[hit], steps[k], 0.0)
        top = own.max()
        best = hit[own == top].min()
        before = lambda f: int(np.count_nonzero(open_file[start[f] : start[f] + np.searchsorted(by_file[start[f] : start[f + 1]], best)]))  # noqa: B023, E731
        ahead = int(many[used[steps > top]].sum())
        if top > 0:
            ahead += sum(before(f) for f in used[steps == top])
        else:
            ahead += int(np.count_nonzero(is_open[:best])) - sum(before(f) for f in used)
        got["recency"] = ahead + 1
        if i == 0:
            got["full"] = got["sir"]
        else:
            if live is None or closed * 8 > len(live):
                live, closed = by_file[open_file], 0
                live_base, live_rest, live_file, live_chain, alive = base[live], rest[live], file[live], chain[live], np.ones(len(live), bool)
                live_start, live_at = np.searchsorted(live_file, np.arange(nf + 3)), np.full(n, -1)
                live_at[live] = np.arange(len(live))
            latest = seen_file[np.searchsorted(seen_at, i - 1) : z]
            gain[used] = wb * (steps / steps.max()) if len(used) else 0.0
            close = np.concatenate([pair_chain[pair_at[f] : pair_at[f + 1]] for f in latest]) if len(latest) else np.empty(0, np.int64)
            near[close] = wd * 0.5
            fix = near[live_chain]
            for f in latest:
                fix[live_start[f] : live_start[f + 1]] = wd * 1.0
            score = gain[live_file]
            score += live_base  # the sum in the order of rank_score
            score += live_rest
            score += fix
            gain[used], near[close] = 0.0, 0.0
            score[np.isnan(score)] = -np.inf
            mine = score[live_at[hit]]
            top = mine.max()
            best = hit[mine == top].min()
            ties = live[(score == top) & alive]
            got["full"] = int(np.count_nonzero((score > top) & alive)) + int(np.count_nonzero(ties < best)) + 1
        out.append((project, i, *[got[x] for x in names]))
        is_open[hit], open_file[in_file[hit]] = False, False
        for name, p in place.items():
            opened[name][p[hit]] = False
        many -= np.bincount(file[hit], minlength=nf + 2)
        if live is not None:
            alive[live_at[hit]], closed = False, closed + len(hit)
    return pd.DataFrame(out, columns=["project", "index", *names]).astype({"project": object})


def co_removal_control(items: DataFrame, events: DataFrame, by: str = "project", days: int = 30) -> DataFrame:
    """The rate of co_removal over all pairs of items of different chains, exactly and without forming pairs, instead of over a sample.

    items (by, id, chain), ids being unique; events (id, day), the first one counts. Pairs within `days` are counted by day: of
    all items of a group, less those of one chain. Result: by, pairs, removed, rate (0 without pairs).
    """
    day = events.groupBy("id").agg(F.min("day").alias("day"))
    rows = items.select(by, "id", F.coalesce(F.col("chain").cast("string"), F.concat(F.lit("/"), F.col("id").cast("string"))).alias("chain")).join(day, "id", "left")

    def counted(keys: list[str]) -> DataFrame:
        later = W.partitionBy(*keys).orderBy("day").rangeBetween(1, days)
        daily = rows.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("n"))
        daily = daily.withColumn("then", F.when(F.col("day").isNotNull(), F.coalesce(F.sum(F.when(F.col("day").isNotNull(), F.col("n"))).over(later), F.lit(0))))
        near = F.when(F.col("day").isNotNull(), F.expr("n * (n - 1) div 2") + F.col("n") * F.col("then")).otherwise(0)
        return daily.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(near).alias("near")).select(*keys, F.expr("n * (n - 1) div 2").alias("pairs"), "near")

    within = counted([by, "chain"]).groupBy(by).agg(F.sum("pairs").alias("own_pairs"), F.sum("near").alias("own_near"))
    both = counted([by]).join(within, by).select(by, (F.col("pairs") - F.col("own_pairs")).alias("pairs"), (F.col("near") - F.col("own_near")).alias("removed"))
    return both.withColumn("rate", F.when(F.col("pairs") > 0, F.col("removed") / F.col("pairs")).otherwise(0.0))


def co_removal(pairs: DataFrame, events: DataFrame, days: float = 30.0) -> DataFrame:
    """Per group, pairs (grp, a, b), how many have both ends addressed (id, day) within `days`, and the rate."""
    first = events.groupBy("id").agg(F.min("day").alias("day"))
    both = pairs.join(first.select(F.col("id").alias("a"), F.col("day").alias("da")), "a", "left").join(first.select(F.col("id").alias("b"), F.col("day").alias("db")), "b", "left")
    near = F.coalesce((F.abs(F.col("da") - F.col("db")) <= days).cast("int"), F.lit(0))
    return both.groupBy("grp").agg(F.count(F.lit(1)).alias("pairs"), F.sum(near).alias("removed")).withColumn("rate", F.col("removed") / F.col("pairs"))


def co_removal_band(items: DataFrame, events: DataFrame, by: str, keys: list[str], at: str, width: int, days: int = 30) -> DataFrame:
    """co_removal over the pairs of items of one group and equal keys that are at most `width` apart, counted without forming pairs.

    items (by, keys, id, at), `at` an integer; events (id, day), the first one counts. Two rows of one id are no pair. Each item
    goes to the places up to `width` from its own; at its own place it meets all that are near, so that every pair counts twice.
    """
    first = events.groupBy("id").agg(F.min("day").alias("day"))
    own = [by, *keys]
    rows = items.select(*own, "id", F.col(at).cast("long").alias("_at")).where(" and ".join(f"{c} is not null" for c in [*own, "id", "_at"])).join(first, "id", "left")

    def counted(rows: DataFrame, own: list[str]) -> DataFrame:
        daily = rows.groupBy(*own, "_at", "day").agg(F.count(F.lit(1)).alias("_c"))
        daily = daily.select("*", F.explode(F.sequence(F.col("_at") - width, F.col("_at") + width)).alias("_to"))
        daily = daily.groupBy(*own, "_to", "day").agg(F.sum("_c").alias("_c"), F.sum(F.when(F.col("_at") == F.col("_to"), F.col("_c")).otherwise(0)).alias("_own"))
        near = F.sum("_c").over(W.partitionBy(*own, "_to").orderBy("day").rangeBetween(-days, days))
        met = daily.withColumn("_near", F.when(F.col("day").isNotNull(), F.col("_own") * near).otherwise(0))
        met = met.groupBy(*own, "_to").agg(F.sum("_c").alias("_all"), F.sum("_own").alias("_own"), F.sum("_near").alias("_near"))
        return met.groupBy(by).agg(F.sum(F.col("_own") * F.col("_all")).alias("pairs"), F.sum("_near").alias("removed"))

    total = counted(rows, own)  # each row with itself too, as in the rows of one id
    twice = rows.join(rows.groupBy(*own, "id").count().where("count > 1").select(*own, "id"), [*own, "id"], "left_semi")
    single = rows.join(twice.select(*own, "id").distinct(), [*own, "id"], "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("pairs"), F.count("day").alias("removed"))
    same = single.unionByName(counted(twice, [*own, "id"])).groupBy(by).agg(F.sum("pairs").alias("_pairs"), F.sum("removed").alias("_removed"))
    out = total.join(same, by).select(by, F.expr("(pairs - _pairs) div 2").alias("pairs"), F.expr("(removed - _removed) div 2").alias("removed"))
    return out.where("pairs > 0").withColumn("rate", F.col("removed") / F.col("pairs"))


def lead_time(ranked: DataFrame, events: DataFrame, *, top: int = 5, lead: int = 5) -> DataFrame:
    """Per item the first index in the top, the index it was addressed at, and whether the lead is long enough."""
    first = ranked.where(F.col("rank") <= top).groupBy("id").agg(F.min("index").alias("seen"))
    done = events.groupBy("id").agg(F.min("index").alias("done"))
    return first.join(done, "id").withColumn("lead", F.col("done") - F.col("seen")).withColumn("early", F.col("lead") >= lead)


def totals(df: DataFrame, by: str, measures: list[str], label: str = "ALL") -> DataFrame:
    """A row a group and one for all."""
    sums = df.rollup(by).agg(*[F.sum(m).alias(m) for m in measures], F.grouping(by).alias("_all"))
    return sums.withColumn(by, F.when(F.col("_all") == 1, label).otherwise(F.col(by).cast("string"))).drop("_all")
