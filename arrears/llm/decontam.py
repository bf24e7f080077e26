"""Operator 10, benchmark decontamination [native]: every item-sized window of a text, exactly, by counts that slide.

The similarity of a window and an item is the weighted Jaccard similarity of their shingles, a shingle weighing as often as
it occurs: sum of minima / sum of maxima >= `similarity`. Order does not count, so windows may start anywhere: an item with
its halves swapped is found. A text goes on if some window holds enough shingles of the items of a size. Then each
occurrence of an item's shingle adds one to the sum of minima of the windows that hold it and, as long as the item has it m
times, not the m-th before it; these are a run of starts. The running sum over where the runs begin and end is the sum of
minima at every start, so all windows are looked at in time linear in the hits, and none is missed. Of equally similar
windows, those that lay a shared shingle on its place in the item come first, then the first.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Items under `width` words are matched as one
shingle; items without words match nothing, as do null and blank texts. A window at a
text's end is as long as the text allows. Texts are scanned whole. Repeated rows give one row; ids may be null; other
columns pass by unread. No rows or no items: no rows. Item shingles are broadcast only up to `broadcast_rows` of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arrears.llm._common import Scratch, unpacked, whole_rows
from arrears.llm.licenses import words_of

WIDTH, SIMILARITY = 5, 0.8


def grams_of(words: str, width: int) -> Column:
    """The shingles of `width` words in an array column, in order."""
    one = lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(width)])
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), one)).otherwise(F.array().cast("array<string>"))


def grams_by_size(words: str, size: Column, width: int) -> Column:
    """As grams_of, by the width that goes with an item of so many words."""
    out = grams_of(words, width)
    for w in range(1, width):
        out = F.when(size == w, grams_of(words, w)).otherwise(out)
    return out


def leaks(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WIDTH, similarity: float = SIMILARITY, broadcast_rows: int = 200_000,
) -> DataFrame:
    """doc_id, print (of the text), item_id, start, n_words, similarity: the best window of each text and item."""
    scratch = Scratch(docs.sparkSession)
    listed = items.select(F.col(item_id).alias("item"), words_of(F.col(item_text)).alias("iw")).where(F.size("iw") > 0)
    listed = listed.withColumn("size", F.size("iw"))
    placed = listed.select("item", "size", F.posexplode(grams_by_size("iw", F.col("size"), width)).alias("t", "gram"))
    placed = scratch.save(placed.withColumn("h", F.xxhash64("gram")), "items")
    counted = placed.groupBy("item", "size", "gram").agg(F.count(F.lit(1)).alias("m"), F.collect_list("t").alias("ts"))
    small = placed.count() <= broadcast_rows
    sizes = [r.w for r in placed.select(F.least("size", F.lit(width)).alias("w")).distinct().collect()] or [width]  # at most `width` values

    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("print"), words_of(F.col(text_col)).alias("w")).withColumn("nw", F.size("w"))
    each = own
    if sizes == [width]:
        each = each.select("doc_id", "print", "nw", F.lit(width).alias("gw"), F.posexplode(grams_of("w", width)).alias("p", "gram"))
    else:
        per = [each.select("doc_id", "print", "nw", F.lit(g).alias("gw"), F.posexplode(grams_of("w", g)).alias("p", "gram")) for g in sorted(sizes)]
        each = reduce(DataFrame.union, per)
    known = placed.select("size", F.col("gram").alias("same"), F.col("h").alias("th"), F.least("size", F.lit(width)).alias("tw")).distinct()
    if small:
        known, counted = F.broadcast(known), F.broadcast(counted)
    hits = each.join(known, (F.xxhash64("gram") == F.col("th")) & (F.col("gram") == F.col("same")) & (F.col("gw") == F.col("tw")))
    keys = ["doc_id", "print", "nw", "size", "tw"]
    found = hits.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("p", "gram"))).alias("hits"))
    found = found.withColumn("n", F.col("size") - F.col("tw") + 1).withColumn("need", F.ceil(F.col("n") * similarity - 1e-9).cast("int"))
    near = F.exists(F.sequence(F.lit(0), F.size("hits") - F.col("need")), lambda i: F.get(F.col("hits"), i + F.col("need") - 1)["p"] - F.get(F.col("hits"), i)["p"] < F.col("n"))
    found = scratch.save(found.where(F.when(F.size("hits") >= F.col("need"), near).otherwise(False)), "found")

    keys = [*keys, "n"]
    at = found.select(*keys, F.inline("hits")).groupBy(*keys, "gram").agg(F.sort_array(F.collect_set("p")).alias("q"))
    at = at.join(counted, ["size", "gram"])
    event = lambda start, d, laid: F.struct(start.cast("int").alias("start"), F.lit(d).alias("d"), F.lit(laid).alias("laid"))
    before = lambda k: F.when(k >= F.col("m"), F.get(F.col("q"), (k - F.col("m")).cast("int")) + 1).otherwise(0)
    begins = F.transform("q", lambda x, k: event(F.greatest(x - F.col("n") + 1, before(k), F.lit(0)), 1, False))
    ends = F.transform("q", lambda x: event(x + 1, -1, False))
    laid = F.array_distinct(F.flatten(F.transform("q", lambda x: F.transform("ts", lambda t: event(F.greatest(x - t, F.lit(0)), 0, True)))))
    events = at.select(*keys, "item", F.inline(F.concat(begins, ends, laid)))
    events = events.groupBy(*keys, "item", "start").agg(F.sum("d").alias("d"), F.max("laid").alias("laid"))
    order = W.partitionBy("doc_id", "print", "item").orderBy("start")
    runs = events.withColumn("next", F.lead("start").over(order)).withColumn("shared", F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0)))
    # a run's first start; at the text's end windows get shorter, so its last one may be better
    starts = F.array(F.struct("start", "laid"), F.struct((F.col("next") - 1).alias("start"), F.lit(False).alias("laid")))
    windows = runs.where("shared > 0").select("doc_id", "print", "item", "nw", "size", "tw", "n", "shared", F.inline(starts)).where("start is not null")
    held = F.least("n", F.col("nw") - F.col("tw") + 1 - F.col("start"))
    windows = windows.withColumn("similarity", F.col("shared") / (held + F.col("n") - F.col("shared"))).where(F.col("similarity") >= similarity)
    windows = windows.withColumn("n_words", F.least("size", F.col("nw") - F.col("start")))
    best = windows.groupBy("doc_id", "print", "item").agg(
        F.min_by(F.struct("start", "n_words", "similarity"), F.struct(-F.col("similarity"), ~F.col("laid"), F.col("start"))).alias("b")
    )
    return best.select("doc_id", "print", F.col("item").alias("item_id"), "b.*")


def matches(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """The best match of each id and item."""
    per = W.partitionBy("doc_id", "item_id").orderBy(F.desc("similarity"), "start", "print")
    return leaks(docs, items, **kw).withColumn("_n", F.row_number().over(per)).where("_n = 1").drop("_n", "print")


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs whose text matches no item."""
    bad = leaks(docs, items, id_col=id_col, text_col=text_col, **kw).select("doc_id", "print").distinct()
    own, text = F.col("row")[id_col], F.col("row")[text_col]
    return unpacked(whole_rows(docs).join(bad, own.eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("print")), "left_anti"), docs.columns)
