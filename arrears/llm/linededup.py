"""Operator 6, line dedup [native]: levelled sorted runs of line keys.

A line's key is the MD5 of the line, stripped of ASCII white space at both ends and with A-Z lower-cased. A batch of
documents is counted by key (its documents, its lines, the largest id) and merge-anti-joined with the runs, which are
bucketed and sorted by key, so that this needs no shuffle of them: novel keys become a run of level 0, counts of known ones
stay in the batch's own table. Two runs of one level merge into one of the next, so n batches leave at most log2(n) runs,
and each key stands in one run alone. `common` adds the known keys' counts to the runs' and reads off the keys that
occur in enough documents. Lines with such keys go, but for those in the largest document that has them. Keys with over a
task's share of all lines are at most as many as there are tasks; they meet the lines by broadcast, the others in a join.

Null or empty text is one empty line. Short keys never go. A document is an id: repeated rows count once and share their
fate; rows without an id count as one document, which never is the largest. Lines of any number and length are read
whole; ties (one id holding a key many times) keep all those lines. Other columns, whatever their names, pass through, but
one that has the name of an output gives way to it. No rows: no rows.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears.llm._common import Scratch, unpacked, whole_rows

SPACE = " \t\n\u000b\f\r"
MIN_SHARE = 500  # lines of a key from which it may be broadcast


def lower_ascii(x: Column) -> Column:
    """A-Z lower-cased and nothing else; the quick way where all is ASCII."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc, print (of the text), pos from 0, key: the lines with a key of min_chars code points at least."""
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("print"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(SPACE))).where(F.char_length("line") >= min_chars)
    return rows.select("doc", "print", "pos", F.unhex(F.md5(lower_ascii(F.col("line")))).alias("key"))


class LineRuns:
    """The runs, by level, and the batches' own counts. Tables lie in the shared folder until `close`."""

    def __init__(self, scratch: Scratch, buckets: int | None = None):
        self.scratch = scratch
        self.buckets = buckets or int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, DataFrame] = {}
        self.batches: list[DataFrame] = []

    def _write(self, run: DataFrame) -> DataFrame:
        return self.scratch.bucketed(run, "run", "key", buckets=self.buckets)

    def split(self, counts: DataFrame) -> DataFrame:
        """counts, with `known`: whether a run has the key."""
        for level, run in self.levels.items():
            counts = counts.join(run.select("key", F.lit(True).alias(f"in{level}")).hint("merge"), "key", "left")
        known = [F.coalesce(F.col(f"in{level}"), F.lit(False)) for level in self.levels]
        flag = known[0] if known else F.lit(False)
        for x in known[1:]:
            flag = flag | x
        return counts.withColumn("known", flag).drop(*[f"in{level}" for level in self.levels])

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch (doc, key): its novel keys as a run, known ones' counts beside it. Returns key, docs, lines, last, known."""
        counts = lines.groupBy("key", "doc").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("lines"), F.max("doc").alias("last"))
        batch = self._write(self.split(counts))
        self.batches.append(batch)
        run, level = batch.where("not known").drop("known"), 0
        while level in self.levels:
            run, level = self._merge(self.levels.pop(level), run), level + 1
        self.levels[level] = run
        return batch

    def _merge(self, one: DataFrame, two: DataFrame) -> DataFrame:
        """Their keys differ, so this only brings them into one order."""
        a, b = (x.select("key", F.struct("docs", "lines", "last").alias(f"r{i}")) for i, x in enumerate((one, two)))
        run = self._write(a.join(b.hint("merge"), "key", "full_outer").select("key", F.coalesce("r0", "r1").alias("r")).select("key", "r.*"))
        for x in (one, two):
            self.scratch.drop(x)  # batches' tables stay: they are not themselves a run
        return run

    def common(self, min_docs: int) -> DataFrame:
        """key, docs, lines, last: the keys in at least min_docs documents, and the largest of these."""
        again = reduce(DataFrame.union, [b.where("known") for b in self.batches]).groupBy("key").agg(*[F.sum(c).alias(f"{c}_") for c in ("docs", "lines")], F.max("last").alias("last_"))
        total = lambda c: (F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c)
        every = [run.join(again, "key", "left").select("key", total("docs"), total("lines"), F.greatest("last", "last_").alias("last")) for run in self.levels.values()]
        return reduce(DataFrame.union, every).where(F.col("docs") >= min_docs)

    def close(self) -> None:
        for x in [*self.levels.values(), *self.batches]:
            if getattr(x, "_arrears_table", None):
                self.scratch.drop(x)
        self.levels, self.batches = {}, []


def drop_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4,
    kept: str = "_kept", n_lines: str = "_n_lines", n_dropped: str = "_n_dropped",
) -> DataFrame:
    """All columns of docs, the kept text, and how many lines there were and went."""
    scratch = Scratch(docs.sparkSession)
    lines = keyed_lines(docs, id_col, text_col, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int"))
    lines = scratch.save(lines, "lines")
    runs = LineRuns(scratch)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    common = scratch.save(runs.common(min_docs), "common")
    share = max(MIN_SHARE, lines.count() // runs.buckets)  # at most `buckets` keys have so many lines or more
    runs.close()
    hot = F.broadcast(common.where(F.col("lines") >= share).select("key", "last"))
    spread = lines.join(F.broadcast(common.where(F.col("lines") >= share).select("key")), "key", "left_anti")
    gone = lines.join(hot, "key").select("doc", "print", "pos", "last").union(
        spread.join(common.where(F.col("lines") < share).select("key", "last"), "key").select("doc", "print", "pos", "last")
    )
    gone = gone.where(~F.col("doc").eqNullSafe(F.col("last"))).groupBy("doc", "print").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    text = F.col("row")[text_col]
    rows = whole_rows(docs).join(gone, F.col("row")[id_col].eqNullSafe(F.col("doc")) & (F.xxhash64(text) == F.col("print")), "left")
    rows = rows.select("row", "gone", lines_of(text).alias("lines"))
    at = F.col("gone")

    def stretch(i: Column) -> Column:
        start = F.when(i == 0, 1).otherwise(F.try_element_at(at, i) + 2)
        stop = F.when(i == F.size(at), F.size("lines")).otherwise(F.try_element_at(at, i + 1))
        return F.slice("lines", start, stop - start + 1)

    left = F.when(at.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(at)), stretch)), "\n"))
    return unpacked(
        rows, docs.columns, **{kept: left, n_lines: F.size("lines").cast("long"), n_dropped: F.coalesce(F.size(at), F.lit(0)).cast("long")}
    )
