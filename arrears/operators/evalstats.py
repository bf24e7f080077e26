"""Evaluation statistics (§2.14)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """E1."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def confusion(df: DataFrame, predicted: Column, truth: Column, by: list[str] | None = None) -> DataFrame:
    """A14."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return df.groupBy(*(by or [])).agg(n(predicted & truth)("tp"), n(predicted & ~truth)("fp"), n(~predicted & truth)("fn"), n(~predicted & ~truth)("tn"))


def micro_macro(per_group: DataFrame) -> DataFrame:
    """Scores from totals, and the mean of the groups' scores."""
    scored = per_group.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))
    macro = scored.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")]).select(F.lit("macro").alias("kind"), "*")
    total = per_group.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(*prf(F.col("tp"), F.col("fp"), F.col("fn")))
    return macro.union(total.select(F.lit("micro").alias("kind"), "*"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """E5: n, p_o, p_e, kappa; 1 where chance agreement is total; null for no rows."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = cells.groupBy(F.col(a).alias("c")).agg(F.sum("n").alias("r")), cells.groupBy(F.col(b).alias("c")).agg(F.sum("n").alias("k"))
    both = rows.join(cols, "c").agg(F.coalesce(F.sum(F.col("r").cast("double") * F.col("k")), F.lit(0.0)).alias("s"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    out = total.crossJoin(F.broadcast(both)).select("n", (F.col("same") / F.col("n")).alias("p_o"), (F.col("s") / F.col("n") / F.col("n")).alias("p_e"))  # one row each
    return out.withColumn("kappa", F.when(1 - F.col("p_e") < 1e-12, 1.0).otherwise((F.col("p_o") - F.col("p_e")) / (1 - F.col("p_e"))))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """On the ranks as given: 1 - 6 sum d^2 / (n (n^2 - 1)), within [-1, 1]; 0 for fewer than two rows."""
    d = F.col(a) - F.col(b)
    out = df.agg(F.count(F.lit(1)).alias("n"), F.sum((d * d).cast("double")).alias("s"))
    n = F.col("n").cast("double")
    return out.select("n", F.when(n < 2, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - 6 * F.col("s") / (n * (n * n - 1))))).alias("rho"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Tau-a over all pairs; 0 for fewer than two rows.

    Pairs are not formed: with rows in order of a, discordant pairs are inversions of b, counted level by level of a
    binary split of b's ranks (a merge sort's counting, as aggregations over (level, block)); ties count for nothing.
    """
    from arrears.operators.ranking import positions

    ranks = positions(df.select(F.col(a).alias("a"), F.col(b).alias("b")), [F.col("b").asc(), F.col("a").desc()], out="rb")
    ranks = positions(ranks, [F.col("a").asc(), F.col("rb").asc()], out="ra")
    n = ranks.count()
    levels = max(1, (max(n, 1) - 1).bit_length())
    # rows in (a, b) order; an inversion of rb between i < j is split at the highest bit in which rb_i - 1 and rb_j - 1 differ
    each = ranks.select("ra", (F.col("rb") - 1).alias("r")).select("ra", "r", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    each = each.select("ra", "level", F.expr("shiftright(r, level + 1)").alias("block"), F.expr("shiftright(r, level) & 1").alias("bit"))
    run = W.partitionBy("level", "block").orderBy("ra").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = each.withColumn("ones", F.sum("bit").over(run)).where("bit = 0").agg(F.coalesce(F.sum("ones"), F.lit(0)).alias("inversions"))
    pairs = lambda c: F.coalesce(F.sum(c * (c - 1) / 2), F.lit(0.0))
    tied_a = ranks.groupBy("a").count().agg(pairs(F.col("count")).alias("ta"))
    tied_b = ranks.groupBy("b").count().agg(pairs(F.col("count")).alias("tb"))
    tied_ab = ranks.groupBy("a", "b").count().agg(pairs(F.col("count")).alias("tab"))
    one = before.crossJoin(tied_a).crossJoin(tied_b).crossJoin(tied_ab)  # one row each
    total = n * (n - 1) / 2
    # ties in b are ordered by a descending, so they come out as inversions unless a ties too
    discordant = F.col("inversions") - (F.col("tb") - F.col("tab"))
    concordant = total - F.col("ta") - F.col("tb") + F.col("tab") - discordant
    return one.select(F.lit(n).cast("long").alias("n"), ((concordant - discordant) / total if n > 1 else F.lit(0.0)).alias("tau"))


def hits(ranked: DataFrame, addressed: DataFrame, by: list[str], item: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """The first rank of an addressed item for each event, and whether it is within k. Events with none have rank null."""
    events = addressed.select(*by).distinct()
    first = ranked.join(addressed.select(*by, item), [*by, item], "left_semi").groupBy(*by).agg(F.min("rank").alias("first_rank"))
    out = events.join(first, by, "left")
    return out.select("*", *[F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("int").alias(f"hit_at_{k}") for k in ks])


def mrr(hit: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    return hit.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), *[F.avg(f"hit_at_{k}").alias(f"hit_at_{k}") for k in ks], F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr"))


def bootstrap_rate(spark, rate: float, n: int, *, resamples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """A percentile interval of a rate from resamples drawn in parallel by the normal approximation, also for small counts."""
    z = F.randn(seed)
    spread = math.sqrt(rate * (1 - rate) / n) if n else 0.0
    drawn = spark.range(resamples).select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round((rate + z * spread) * n) / n)).alias("r"))
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return drawn.agg(F.percentile("r", lo).alias("lower"), F.percentile("r", hi).alias("upper"))


def bootstrap_kappa(df: DataFrame, a: str, b: str, *, resamples: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """A percentile interval of kappa. Only the contingency table is resampled, by Poisson weights, so rows are read once."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    reps = df.sparkSession.range(resamples).select(F.col("id").alias("rep"))
    drawn = cells.crossJoin(reps).withColumn("w", F.greatest(F.lit(0.0), F.round(F.col("n") + F.sqrt("n") * F.randn(seed))))  # classes^2 x resamples
    total = drawn.groupBy("rep").agg(F.sum("w").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0)).alias("same"))
    rows, cols = drawn.groupBy("rep", F.col("a").alias("c")).agg(F.sum("w").alias("r")), drawn.groupBy("rep", F.col("b").alias("c")).agg(F.sum("w").alias("k"))
    chance = rows.join(cols, ["rep", "c"]).groupBy("rep").agg(F.sum(F.col("r") * F.col("k")).alias("s"))
    kappa = total.join(chance, "rep").select(((F.col("same") / F.col("t") - F.col("s") / F.col("t") ** 2) / (1 - F.col("s") / F.col("t") ** 2)).alias("kappa"))
    return kappa.agg(F.percentile("kappa", (1 - level) / 2).alias("lower"), F.percentile("kappa", (1 + level) / 2).alias("upper"))


def fisher_one_sided(n1: int, rate1: float, n2: int, rate2: float) -> float:
    """P(at least as many successes in the first row), from rounded counts."""
    a, c = round(n1 * rate1), round(n2 * rate2)
    k, total = a + c, n1 + n2
    log = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    return min(1.0, sum(math.exp(log(n1, x) + log(n2, k - x) - log(total, k)) for x in range(a, min(k, n1) + 1) if k - x <= n2))


def distribution(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Counts and the percentage of their group."""
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def likert(df: DataFrame, rating: str, by: list[str], bound: int = 4) -> DataFrame:
    """E21, P15."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(rating).alias("mean"), F.avg((F.col(rating) >= bound).cast("double")).alias("share_high"))


def within(df: DataFrame, measured: str, target: str, tolerance: float, out: str = "ok") -> DataFrame:
    """P16, P17, E20."""
    return df.withColumn(out, F.abs(F.col(measured) - F.col(target)) <= tolerance)


def edge_precision(df: DataFrame, verdict: str) -> DataFrame:
    """Strict counts valid edges, lenient plausible ones too."""
    share = lambda *v: F.avg(F.col(verdict).isin(*v).cast("double"))
    return df.agg(share("valid").alias("strict"), share("valid", "plausible").alias("lenient"))


def disagreements(df: DataFrame, a: str, b: str, yes: str) -> DataFrame:
    """Rows on which two labels differ; FP where only the first says yes, FN where only the second."""
    return df.where(F.col(a) != F.col(b)).withColumn("kind", F.when(F.col(a) == yes, "FP").otherwise("FN"))


def count_accuracy(n: Column, m: Column) -> Column:
    """E22."""
    return F.when(F.greatest(n, m) > 0, F.least(n, m) / F.greatest(n, m)).otherwise(1.0)


def spread(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Rows, least, greatest, mean, median and the commonest value (of several, the least) of each group."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.mode(v, True).alias("commonest")
    )


def outcomes(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of either side, once: matched, or only found, or only in the truth."""
    both = found.select(*keys).distinct().withColumn("_f", F.lit(True)).join(truth.select(*keys).distinct().withColumn("_t", F.lit(True)), keys, "full_outer")
    side = F.when(F.col("_f").isNull(), "missed").when(F.col("_t").isNull(), "spurious").otherwise("matched")
    return both.select(*keys, side.alias("outcome"))


def overlap(one, two):
    """How much of two arrays is shared, over what either has; 0 if both are empty."""
    either = F.size(F.array_union(one, two))
    return F.when(either > 0, F.size(F.array_intersect(one, two)) / either).otherwise(F.lit(0.0))


def deltas(before: DataFrame, after: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """U8: the measure before and after and its change, for every key of either; what is missing counts as 0."""
    a, b = (x.select(*keys, F.col(measure).alias(name)) for x, name in ((before, "before"), (after, "after")))
    both = a.join(b, keys, "full_outer").select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after")])
    return both.withColumn("change", F.col("after") - F.col("before"))


def agreement_cells(df: DataFrame, a: Column, b: Column, by: list[str]) -> DataFrame:
    """Of each group, how often each of two annotators said yes, the four cells, and the observed agreement to four places."""
    n = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), n(a, "a_yes"), n(b, "b_yes"), n(a & b, "both_yes"), n(~a & ~b, "both_no"), n(a & ~b, "only_a"), n(~a & b, "only_b"),
        F.round(F.avg((a == b).cast("double")), 4).alias("observed"),
    )


def consensus(df: DataFrame, predicted: str, agreed: str) -> DataFrame:
    """Both labels stripped and in lower case, nulls empty, and whether they match."""
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).alias(c)
    rest = [c for c in df.columns if c not in (predicted, agreed)]
    return df.select(*rest, plain(predicted), plain(agreed)).withColumn("match", F.col(predicted) == F.col(agreed))


def truth_stats(df: DataFrame, label: str, kind: str) -> DataFrame:
    """Rows, positive rows and their share, for all and by kind (null kind: all)."""
    return df.cube(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("positive"), F.avg(F.col(label).cast("double")).alias("share"), F.grouping(kind).alias("all"))


def matching(found: DataFrame, truth: DataFrame, key: str, at: str, ordinal: str, kind: str, width: int = 5) -> DataFrame:
    """Matched, only found and only true rows and their scores by kind; a detection meets truths of its own kind."""
    from arrears.operators.joins import greedy_match

    own = lambda df: df.select(F.concat_ws("\u0001", kind, F.col(key).cast("string")).alias("_own"), F.col(at), F.col(ordinal), F.col(kind))
    met = greedy_match(own(found), own(truth), "_own", at, ordinal, width)
    met = met.select(F.split("_own", "\u0001")[0].alias(kind)).groupBy(kind).agg(F.count(F.lit(1)).alias("tp"))
    n = lambda df, name: df.groupBy(kind).agg(F.count(F.lit(1)).alias(name))
    c = n(found, "found").join(n(truth, "true"), kind, "full_outer").join(met, kind, "left").select(kind, *[F.coalesce(x, F.lit(0)).alias(x) for x in ("found", "true", "tp")])
    c = c.select(kind, "tp", (F.col("found") - F.col("tp")).alias("fp"), (F.col("true") - F.col("tp")).alias("fn"))
    return c.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))
