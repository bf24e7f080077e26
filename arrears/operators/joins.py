"""Joins by interval, first match and greedy matching (§2.5). Every interval join has an equality key, so none is a product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def band(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, width: int, *, how: str = "inner") -> DataFrame:
    """Rows of one key at most `width` apart. Both sides carry a bucket of that width, the right one its two neighbours
    too, so that a large key is spread over its buckets."""
    bucket = lambda c: F.floor(F.col(c) / (width + 1)).cast("long")
    a = left.withColumn("_b", bucket(left_at))
    b = right.withColumn("_b", F.explode(F.array(*[bucket(right_at) + d for d in (-1, 0, 1)]))).withColumnRenamed(key, "_key")
    near = (F.col(key) == F.col("_key")) & (a["_b"] == b["_b"]) & (F.abs(F.col(left_at) - F.col(right_at)) <= width)
    return a.join(b, near, how).drop(a["_b"]).drop(b["_b"]).drop("_key")


def first_within(left: DataFrame, right: DataFrame, key: str, left_id: str, left_at: str, right_at: str, right_ordinal: str, width: int) -> DataFrame:
    """For each left row the first right row, in list order, that lies within the band."""
    near = band(left, right, key, left_at, right_at, width)
    return near.withColumn("_k", F.row_number().over(W.partitionBy(left_id).orderBy(right_ordinal))).where("_k = 1").drop("_k")


def contains(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, *, slack: int = 0) -> DataFrame:
    """Points within [start - slack, end]."""
    other = spans.withColumnRenamed(key, "_key")
    return points.join(other, (F.col(key) == F.col("_key")) & (F.col(at) >= F.col(start) - slack) & (F.col(at) <= F.col(end))).drop("_key")


def later_uses(defs: DataFrame, uses: DataFrame, keys: list[str], def_line: str, use_line: str, width: int) -> DataFrame:
    """Equality on keys, and the use after the definition, at most `width` lines. Rows meet by buckets of that width, so a hot
    key's definitions do not meet all of its uses."""
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    a = defs.withColumn("_b", bucket(def_line))
    b = uses.withColumn("_b", F.explode(F.array(bucket(use_line) - 1, bucket(use_line))))
    return a.join(b, [*keys, "_b"]).where((F.col(use_line) > F.col(def_line)) & (F.col(use_line) - F.col(def_line) <= width)).drop("_b")


def pairs_within(df: DataFrame, key: str, ordinal: str, at: str | None = None, width: int | None = None) -> DataFrame:
    """A.ordinal < b.ordinal within a key, at most `width` apart where one is given. Columns a_*, b_*."""
    a = df.select(*[F.col(c).alias(f"a_{c}") for c in df.columns])
    b = df.select(*[F.col(c).alias(f"b_{c}") for c in df.columns])
    if width is None:
        return a.join(b, (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col(f"a_{ordinal}") < F.col(f"b_{ordinal}")))
    bucket = F.floor(F.col(f"a_{at}") / (width + 1))
    a = a.withColumn("_ab", bucket)
    b = b.withColumn("_bb", F.explode(F.array(*[F.floor(F.col(f"b_{at}") / (width + 1)) + d for d in (-1, 0, 1)])))
    near = (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col("_ab") == F.col("_bb")) & (F.abs(F.col(f"a_{at}") - F.col(f"b_{at}")) <= width)
    return a.join(b, near & (F.col(f"a_{ordinal}") < F.col(f"b_{ordinal}"))).drop("_ab", "_bb")


def band_sums(df: DataFrame, key: str, ordinal: str, at: str, width: int) -> DataFrame:
    """Per key the number of pairs of pairs_within and the sum of b.ordinal - a.ordinal, without forming pairs: key, n, s.

    `at` and the ordinals are integers. Each row goes to the places up to `width` from its own; at its own place it counts, in order
    of the ordinal, what stands before it.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(ordinal).isNotNull() & F.col(at).isNotNull())
    rows = rows.groupBy(key, F.col(at).cast("long").alias("_at"), F.col(ordinal).cast("long").alias("_o")).agg(F.count(F.lit(1)).alias("_c"))
    rows = rows.select("*", F.explode(F.sequence(F.col("_at") - width, F.col("_at") + width)).alias("_to"))
    rows = rows.groupBy(key, "_to", "_o").agg(F.sum("_c").alias("_c"), F.sum(F.when(F.col("_at") == F.col("_to"), F.col("_c")).otherwise(0)).alias("_own"))
    before = W.partitionBy(key, "_to").orderBy("_o").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"_n": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_s": F.coalesce(F.sum(F.col("_c") * F.col("_o")).over(before), F.lit(0))})
    out = rows.groupBy(key).agg(F.sum(F.col("_own") * F.col("_n")).alias("n"), F.sum(F.col("_own") * (F.col("_o") * F.col("_n") - F.col("_s"))).alias("s"))
    return out.where("n > 0")


def best_similarity(df: DataFrame, keys: list[str], ident: str, text: str) -> DataFrame:
    """Each row's best similarity to another row of its group (other identity), for groups of two and more: ident, best.

    Only distinct texts are compared; where two rows share a text the best is 1 and nothing is compared for it.
    """
    from arrears.functions.text import similarity

    rows = df.where(" and ".join(f"{k} is not null" for k in [*keys, ident]))
    texts = rows.groupBy(*keys, text).agg(F.min(ident).alias("_lo"), F.max(ident).alias("_hi"))
    groups = texts.groupBy(*keys).agg(F.min("_lo").alias("_glo"), F.max("_hi").alias("_ghi")).where("_glo <> _ghi").drop("_glo", "_ghi")
    texts = texts.where(F.col(text).isNotNull())
    a = texts.where("_lo = _hi").select(*keys, F.col(text).alias("_a"), F.col("_lo").alias("_ai"))
    b = texts.select(*keys, F.col(text).alias("_b"), F.col("_lo").alias("_blo"), F.col("_hi").alias("_bhi"))
    other = (F.col("_a") != F.col("_b")) & ((F.col("_blo") != F.col("_ai")) | (F.col("_bhi") != F.col("_ai")))
    single = a.join(b, keys).where(other).groupBy(*keys, F.col("_a").alias(text)).agg(F.max(similarity(F.col("_a"), F.col("_b"))).alias("best"))
    best = single.union(texts.where("_lo <> _hi").select(*keys, text, F.lit(1.0).alias("best")))
    out = rows.join(groups, keys, "left_semi").join(best, [*keys, text], "left")
    return out.groupBy(ident).agg(F.max("best").alias("best"))


def capped_groups(df: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of keys that have at most `most` rows; counted first, so no key is gathered."""
    small = df.groupBy(key).count().where(F.col("count") <= most).select(key)
    return df.join(small, key, "left_semi")


def first_existing(candidates: DataFrame, known: DataFrame, by: list[str], candidate: str, ordinal: str) -> DataFrame:
    """Of each row's ordered candidates, the first that exists."""
    return candidates.join(known.select(F.col(known.columns[0]).alias(candidate)).distinct(), candidate).groupBy(*by).agg(F.min_by(candidate, ordinal).alias(candidate))


def last_definition(df: DataFrame, by: list[str], ordinal: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), ordinal).alias("_r")).select(*by, "_r.*")


def greedy_match(found: DataFrame, truth: DataFrame, key: str, at: str, ordinal: str, width: int = 5) -> DataFrame:
    """One-to-one, each detection in its order takes the first free truth in the band: key, found, truth (ordinals).

    Order-dependent, hence sequential by key; a key is cut where a gap wider than the band separates its rows, so that only
    rows that can influence each other must meet in one task. The gaps are sought between spans of places, by the first and last
    row of each, so that no task orders a key; a task takes all rows of a span, or of spans without a gap between them.
    """
    both = found.select(key, F.col(at).alias("at"), F.col(ordinal).cast("long").alias("n"), F.lit(0).alias("side")).union(
        truth.select(key, F.col(at).alias("at"), F.col(ordinal).cast("long").alias("n"), F.lit(1).alias("side"))
    )
    both = both.where("at is not null").withColumn("_b", F.floor(F.col("at") / (4096 * (width + 1))))
    ends = both.groupBy(F.col(key).alias("_key"), F.col("_b").alias("_eb")).agg(F.min("at").alias("_lo"), F.max("at").alias("_hi"))
    run = W.partitionBy("_key").orderBy("_eb")
    ends = ends.withColumn("_gap", (F.col("_lo") - F.lag("_hi").over(run) > width).cast("int")).withColumn("stretch", F.sum(F.coalesce("_gap", F.lit(0))).over(run))
    both = both.join(ends.select("_key", "_eb", "stretch"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_eb")))

    def match(pdf):
        from bisect import bisect_left, bisect_right

        import pandas as pd

        a, b, free, out = pdf[pdf.side == 0].sort_values("n"), pdf[pdf.side == 1].sort_values("n", ascending=False), {}, []
        for m, other in zip(b.n.tolist(), b["at"].tolist(), strict=True):
            free.setdefault(other, []).append(m)
        places, used = sorted(free), set()
        for n, line in zip(a.n.tolist(), a["at"].tolist(), strict=True):
            least = None
            for other in places[bisect_left(places, line - width) : bisect_right(places, line + width)]:
                own = free[other]
                while own and own[-1] in used:
                    own.pop()
                if own and (least is None or own[-1] < least):
                    least = own[-1]
            if least is not None:
                used.add(least)
                out.append((n, least))
        return pd.DataFrame({key: pd.Series([pdf[key].iloc[0]] * len(out), dtype=object), "found": [x for x, _ in out], "truth": [y for _, y in out]})

    kind = dict(found.dtypes)[key]
    return both.groupBy(key, "stretch").applyInPandas(match, f"{key} {kind}, found long, truth long")


def merge_relationships(edges: DataFrame) -> DataFrame:
    """A2: one row a pair: types (sorted set), edges, strength (max), hops (min), description (distinct, sorted)."""
    return edges.groupBy("src", "dst").agg(
        F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_list(F.struct("type", "weight", "hops"))).alias("edges"),
        F.max("weight").alias("strength"), F.min("hops").alias("hop_count"),
    )


def exists(df: DataFrame, other: DataFrame, on: Column | list[str], flag: str) -> DataFrame:
    """Whether there is a match, as a column."""
    keys = on if isinstance(on, list) else [on]
    return df.join(other.select(*keys).distinct().withColumn(flag, F.lit(True)), keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
