"""Operator 2, SimHash near-duplicates: bit-sliced comparison within pigeonhole buckets.

Fingerprints: XXH64 (seed 42) of each word shingle of a text; a bit is set if it is set in over half of them. Equal
fingerprints are one node. Two fingerprints within `radius` bits agree wholly on some `c` of `radius + c` blocks of bits,
so each node goes to one bucket for each choice of c blocks; c grows with the number of nodes (1 up to 16 M, 2 up to
4 G, then 3 and 4), which keeps buckets small and loses no pair. Within a bucket the fingerprints stand as 64 vertical bit
planes; a block of queries updates all its distances plane by plane with carry-save counters and is abandoned once every
counter is beyond the radius. A bucket passes on the edges of a spanning forest, never all pairs, and one of over
`tile_rows` fingerprints is cut into pieces that meet pair by pair in separate tasks.

`similar_groups` takes the same fingerprints and buckets: a spanning forest of the links within the radius, each link then
verified by the Jaccard similarity of the shingle sets, as unlike texts can have one fingerprint. Similar texts may also lie
further apart than pigeonhole blocks can reach: at a similarity of 0.8 two fingerprints differ in 9.7 bits on average. An
exact pass over prefixes therefore follows and loses no pair: with all shingles in one order, two sets of that similarity
share one among the first n - ceil(0.8 n) + 1 of each. A node is a set of distinct shingles (its 128-bit hash). The order is
that of the hashes, with those found often in a sample of the texts last; any such choice is right, it only spares
comparisons. With the fingerprints' links those to a few centres are verified; then all pairs that share a prefix shingle
and are not in one component yet, but those that places in the order or sketches (parity bits, which differ in no more
places than the sets) show to be below the threshold: no true pair is among these.

Null or blank text: fingerprint 0, linked like any other. Fewer words than a shingle: the whole sequence is the shingle.
Texts are read whole. Repeated rows each keep their row. A null id keeps its row and never names a component.
No rows: no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arrears.llm._common import Scratch, connected_components, forget_shuffles

SEED = 42
BUCKET_GOAL = 4096
TILE_ROWS = 2048
BLOCK_ROWS = 512  # buckets in a row are compared in one block of about as many


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of `width` words, in order, of a text in UTF-8."""
    from xxhash import xxh64_intdigest as xxh

    words = (text or b"").lower().split()  # for bytes: A-Z, and \x20 \x09-\x0D, alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh(joined, SEED)], np.uint64)
    ends = np.fromiter(map(len, words), np.int64, len(words))
    ends += 1
    np.cumsum(ends, out=ends)
    starts = [0, *ends[:-width].tolist()]
    return np.fromiter((xxh(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each list of hashes. Eight counters stand in a word, a byte each, for up to 255 hashes at a time."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    every, sizes = np.concatenate([hashes[i] for i in some]), sizes[some]
    blocks = -(-sizes // 255)
    first = np.cumsum(blocks) - blocks
    within = np.arange(blocks.sum()) - np.repeat(first, blocks)
    starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + 255 * within
    lanes = np.uint64(0x0101010101010101)
    for j in range(8):
        part = np.add.reduceat((every >> np.uint64(j)) & lanes, starts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(part, first, axis=0, dtype=np.int64)
        for b in range(8):
            out[some] |= (2 * counts[:, b] > sizes).astype(np.uint64) << np.uint64(8 * b + j)
    return out


def majorities(hashes: Iterable[np.ndarray]) -> np.ndarray:
    """As majority, a bounded number of hashes at a time."""
    parts, own, size = [], [], 0
    for h in hashes:
        own.append(h)
        size += len(h)
        if size > 200_000:
            parts.append(majority(own))
            own, size = [], 0
    return np.concatenate([*parts, majority(own)])


def with_fingerprints(docs: DataFrame, *, text_col: str = "text", width: int = 4, out: str = "_fp") -> DataFrame:
    """All columns of docs, and the fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(majorities(shingle_hashes(t, width) for t in texts).view(np.int64))

    return docs.withColumn(out, fingerprint(F.col(text_col).cast("binary")))


def planes_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """bits[i, b] of each fingerprint, and planes[b, w]: bit b of all of them, packed along the words."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    words = -(-len(fps) // 64)
    padded = np.zeros((64, words * 64), np.uint8)
    padded[:, : len(fps)] = bits.T
    return bits, np.packbits(padded, axis=1, bitorder="little").view(np.uint64).reshape(64, words)


def close_pairs(fps: np.ndarray, radius: int, ends: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each fingerprint in turn, the later ones within the radius, where there are any; up to its bucket's end, if buckets stand in a row."""
    m = len(fps)
    ends = np.full(m, m) if ends is None else ends
    bits, planes = planes_of(fps)
    words = planes.shape[1]
    full = np.uint64(2**64 - 1)
    masks = np.where(bits.T.astype(bool), full, np.uint64(0))  # by plane and query
    digits = max(1, radius.bit_length())
    step = max(1, 16_384 // words)
    lane = np.arange(words * 64)
    for lo in range(0, m, step):
        rows = np.arange(lo, min(m, lo + step))
        rows = rows[ends[rows] > rows + 1]
        if not len(rows):
            continue
        barred = (lane[None, :] <= rows[:, None]) | (lane[None, :] >= ends[rows][:, None])  # itself, earlier ones, other buckets
        over = np.packbits(barred, axis=1, bitorder="little").view(np.uint64).reshape(len(rows), words)
        counters = [np.zeros_like(over) for _ in range(digits)]
        for b in range(0, 64, 2):
            d1 = planes[b] ^ masks[b, rows][:, None]
            d2 = planes[b + 1] ^ masks[b + 1, rows][:, None]
            half = counters[0] ^ d1
            carry = (counters[0] & d1) | (half & d2)
            counters[0] = half ^ d2
            for k in range(1, digits):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % 8 == 6:
                beyond, equal = over.copy(), np.full_like(over, full)
                for k in range(digits - 1, -1, -1):
                    if radius >> k & 1:
                        equal &= counters[k]
                    else:
                        beyond |= equal & counters[k]
                        equal &= ~counters[k]
                alive = (beyond != full).any(axis=1)
                if not alive.any():
                    rows = rows[:0]
                    break
                if not alive.all():
                    rows, over, beyond, counters = rows[alive], over[alive], beyond[alive], [c[alive] for c in counters]
        if len(rows):
            near = np.unpackbits((~beyond).view(np.uint8), axis=1, bitorder="little")
            for i, row in zip(rows, near, strict=True):
                if len(found := np.flatnonzero(row)):
                    yield int(i), found


def forest(fps: np.ndarray, radius: int, ends: np.ndarray | None = None) -> np.ndarray:
    """For each fingerprint, the place of the one its group hangs on."""
    label = np.arange(len(fps))
    for i, found in close_pairs(fps, radius, ends):
        own = np.unique(np.append(label[found], label[i]))
        if len(own) > 1:
            label[np.isin(label, own)] = own[0]
    return label


def spanning(fps: np.ndarray, radius: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends of links, each within the radius, that join what all such links join."""
    label, one, two = np.arange(len(fps)), [], []
    for i, found in close_pairs(fps, radius, ends):
        own, first = np.unique(label[found], return_index=True)
        if len(new := np.flatnonzero(own != label[i])):
            one += [i] * len(new)
            two += found[first[new]].tolist()
            label[np.isin(label, own[new])] = label[i]
    return np.array(one, np.int64), np.array(two, np.int64)


def scheme(nodes: int, radius: int) -> list[int]:
    """Masks of the bits that a bucket's fingerprints share; two within the radius share one bucket at least."""
    for c in range(1, 5):
        blocks = radius + c
        if 2 ** (c * (64 // blocks)) * BUCKET_GOAL >= nodes:
            break
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    single = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    return [sum(x) for x in itertools.combinations(single, c)]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def buckets(nodes: DataFrame, masks: list[int], tile_rows: int) -> DataFrame:
    """nodes (fp, rep), once for each of its buckets, or pairs of a large bucket's pieces: key, bits, tile."""
    each = F.array(*[F.struct(F.lit(i).alias("key"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(masks)])
    rows = nodes.select("fp", "rep", F.inline(each))
    large = rows.groupBy("key", "bits").count().where(F.col("count") > tile_rows)
    large = large.select("key", "bits", F.ceil(F.col("count") / tile_rows).cast("int").alias("pieces"))
    rows = rows.join(large, ["key", "bits"], "left")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("pieces")).cast("int")
    others = F.expr("filter(sequence(0, pieces - 1), x -> x <> own)")
    tiles = F.when(F.col("pieces") > 1, F.transform(others, lambda x: F.least(x, F.col("own")).cast("long") * 1_000_000 + F.greatest(x, F.col("own"))))
    return rows.withColumn("own", own).select("fp", "rep", "key", "bits", F.explode(F.coalesce(tiles, F.array(F.lit(0).cast("long")))).alias("tile"))


def edges_of(bucketed: DataFrame, radius: int, *, links: bool = False) -> DataFrame:
    """(a, b): a spanning forest of the links of each bucket; `links`: made of links alone, else of stars."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch | None:
            """Compares the buckets held, whole ones, in one block."""
            fp, rep = (np.concatenate([x[i] for x in held]) for i in range(2))
            sizes = np.array([len(x[0]) for x in held])
            sizes = np.add.reduceat(sizes, np.array(begins))
            ends = np.repeat(np.cumsum(sizes), sizes)
            if links:
                one, two = spanning(fp.view(np.uint64), radius, ends)
            else:
                label = forest(fp.view(np.uint64), radius, ends)
                one = np.flatnonzero(label != np.arange(len(label)))
                two = label[one]
            return pa.RecordBatch.from_arrays([pa.array(rep[one]), pa.array(rep[two])], ["a", "b"]) if len(one) else None

        held: list[tuple[np.ndarray, ...]] = []
        begins: list[int] = []
        key, rows = None, 0
        for batch in batches:
            fp, rep, k, bits, tile = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "rep", "key", "bits", "tile"))
            cut = np.flatnonzero((k[1:] != k[:-1]) | (bits[1:] != bits[:-1]) | (tile[1:] != tile[:-1])) + 1
            for lo, hi in itertools.pairwise([0, *cut.tolist(), len(fp)]):
                if lo == hi:
                    continue
                if (now := (k[lo], bits[lo], tile[lo])) != key:
                    if rows >= BLOCK_ROWS:
                        if (out := flush()) is not None:
                            yield out
                        held, begins, rows = [], [], 0
                    key = now
                    begins.append(len(held))
                held.append((fp[lo:hi].copy(), rep[lo:hi].copy()))
                rows += hi - lo
        if held and (out := flush()) is not None:
            yield out

    dealt = bucketed.repartition("key", "bits", "tile").sortWithinPartitions("key", "bits", "tile")
    return dealt.mapInArrow(compare, "a long, b long")


def groups(prints: DataFrame, scratch: Scratch, *, radius: int = 4, tile_rows: int = TILE_ROWS, masks: list[int] | None = None) -> DataFrame:
    """(fp, component) for every fingerprint in `prints` (doc_id, fp): the smallest id reachable by links."""
    nodes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    linked = nodes.where("rep is not null")
    edges = edges_of(buckets(linked, masks or scheme(linked.count(), radius), tile_rows), radius)
    parts = connected_components(edges, scratch)
    return nodes.join(parts, nodes.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp (signed), component of each row of docs."""
    scratch = Scratch(docs.sparkSession)
    prints = with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), width=width, out="fp")
    prints = scratch.save(prints.select("doc_id", "fp"), "prints")
    return prints.join(groups(prints, scratch, radius=radius), "fp")


def parity_sketch(own: np.ndarray) -> bytes:
    """Whether the number of hashes that fall on each place is odd; the places are a power of two, about four a hash."""
    places = 1 << max(8, (4 * len(own)).bit_length())
    odd = np.bincount((own & np.uint64(places - 1)).view(np.int64), minlength=places).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def least_apart(one: bytes, two: bytes) -> int:
    """In how many places two sketches differ: sets differ in no fewer hashes. The longer one is folded."""
    x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def keyed_rows(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """The rows of docs, whole, as `row`, dealt by two hashes of id and text (k1, k2): written once, joined without a shuffle since."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    own, text = F.col("row")[id_col], F.col("row")[text_col].cast("string")
    known = F.isnotnull(own).cast("int") + 2 * F.isnotnull(text).cast("int")
    return scratch.bucketed(row.select(F.xxhash64(own, text, known).alias("k1"), F.xxhash64(F.lit(1), known, text, own).alias("k2"), "row"), "rows", "k1", "k2")


def similar_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 4, often: int = 12, most: int = 200_000,
    scratch: Scratch | None = None, rows: DataFrame | None = None,
) -> DataFrame:
    """doc_id, k1, k2 (of id and text), component of each row of docs: groups of texts linked by Jaccard similarity of word shingles.

    A component's name is the smallest key of its shingle sets. `radius`: of fingerprints whose link is verified. `often`: so often in the texts' sample a shingle is put
    last; at most `most` are. `rows`: keyed_rows of docs, if there already.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = keyed_rows(docs, id_col, text_col, scratch) if rows is None else rows
    rows = rows.select("k1", "k2", F.col("row")[id_col].alias("doc_id"), F.col("row")[text_col].cast("string").alias("text"))
    share = similarity / (1 + similarity)  # of both sizes, which two such sets have in common at least

    @F.pandas_udf("array<long>")
    def distinct(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(shingle_hashes(t, width)).view(np.int64) for t in texts], dtype=object)

    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).select(F.explode(distinct(F.col("text").cast("binary"))).alias("h"))
    common = sample.groupBy("h").count().where(F.col("count") >= often).orderBy(F.desc("count"), "h").limit(most)
    last = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.h for r in common.collect()], np.int64).view(np.uint64)))
    del sample, common  # they hold shuffle files
    forget_shuffles(docs.sparkSession)

    @F.pandas_udf("key binary, n int, prefix array<long>, sketch binary, fp long")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        """`prefix`: places in the order, 63 bits of each hash below zero, those of common ones from zero up."""
        from xxhash import xxh128_digest

        late = np.append(last.value, np.uint64(2**64 - 1))
        for texts in batches:
            out = []

            def each(texts: pd.Series = texts, out: list = out) -> Iterator[np.ndarray]:
                for t in texts:
                    hashes = shingle_hashes(t, width)
                    own = np.unique(hashes)
                    place = (own >> np.uint64(1)).view(np.int64)
                    place = np.sort(np.where(late[np.searchsorted(late[:-1], own)] == own, place, place - 2**62 - 2**62))
                    prefix = place[: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1]
                    out.append((xxh128_digest(own.tobytes()), len(own), prefix, parity_sketch(own)))
                    yield hashes

            fps = majorities(each()).view(np.int64)
            yield pd.DataFrame(out, columns=["key", "n", "prefix", "sketch"]).assign(fp=fps)

    prints = rows.select("k1", "k2", "doc_id", described(F.col("text").cast("binary")).alias("_own")).select("k1", "k2", "doc_id", "_own.*")
    wide = prints = scratch.save(prints, "prints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    nodes = prints.groupBy("key").agg(F.min(order).alias("o"))
    nodes = scratch.save(nodes.select("key", F.monotonically_increasing_id().alias("rep"), "o.k1", "o.k2"), "nodes")
    sets = prints.drop("doc_id", "key").join(nodes.select("rep", "k1", "k2"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])  # as joined, so without another shuffle
    sets = scratch.save(sets.select("rep", "n", F.size("prefix").alias("p"), "prefix", "sketch", "fp"), "sets")
    prints = scratch.save(prints.select("doc_id", "k1", "k2", "key"), "keys")
    scratch.drop(wide)
    forget_shuffles(docs.sparkSession)
    # links of the fingerprints: of equal ones to the first, of others a forest
    firsts = scratch.save(sets.groupBy("fp").agg(F.min("rep").alias("rep")), "firsts")
    equal = sets.select(F.col("rep").alias("a"), "fp").join(firsts.withColumnRenamed("rep", "b"), "fp").where("a <> b").select("a", "b")
    within = edges_of(buckets(firsts, scheme(firsts.count(), radius), TILE_ROWS), radius, links=True)
    alike = scratch.save(equal.union(within).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "alike")
    forget_shuffles(docs.sparkSession)
    # centres are the smallest in three orders of the nodes; shingles put last may be in any number of sets, so theirs are
    # combined before the shuffle, and the join with them can be split
    placed = sets.select("rep", F.posexplode("prefix").alias("i", "h"))
    flips = [0, 0x2AAAAAAAAAAAAAAA, 0x1999999999999999]
    lows = [F.min(F.col("rep").bitwiseXOR(F.lit(x))) for x in flips]
    centres = F.array_distinct(F.array(*[F.col(f"c{k}").bitwiseXOR(F.lit(x)) for k, x in enumerate(flips)])).alias("centres")
    rare, same = placed.where("h < 0"), W.partitionBy("h")
    rare = rare.select("*", F.count(F.lit(1)).over(same).alias("reps"), *[x.over(same).alias(f"c{k}") for k, x in enumerate(lows)])
    many = placed.where("h >= 0").groupBy("h").agg(F.count(F.lit(1)).alias("reps"), *[x.alias(f"c{k}") for k, x in enumerate(lows)])
    many = placed.where("h >= 0").join(many, "h").select(*rare.columns)
    indexes = []
    for part in (rare, many):  # one after the other, for their shuffles' disk
        indexes.append(scratch.save(part.where("reps > 1").select("rep", "i", "h", centres), "index"))
        forget_shuffles(docs.sparkSession)
    index = indexes[0].union(indexes[1])

    @F.pandas_udf("double")
    def jaccard(one: pd.Series, two: pd.Series) -> pd.Series:
        def both(x: bytes, y: bytes) -> float:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            n = len(np.intersect1d(x, y, assume_unique=True))
            return n / (len(x) + len(y) - n) if len(x) + len(y) else 1.0

        return pd.Series([both(x, y) for x, y in zip(one, two, strict=True)])

    @F.pandas_udf("binary")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(shingle_hashes(t, width)).tobytes() for t in texts], dtype=object)

    def verified(found: DataFrame) -> DataFrame:
        wanted = found.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(nodes, "rep").select("rep", "k1", "k2")
        texts = rows.join(wanted, ["k1", "k2"]).dropDuplicates(["rep"]).select("rep", shingles(F.col("text").cast("binary")).alias("s"))
        texts = scratch.save(texts, "shingles")
        pairs = found.join(texts.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(texts.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
        links = scratch.save(pairs.where(jaccard("sa", "sb") >= similarity).select("a", "b"), "links")
        scratch.drop(texts)
        forget_shuffles(docs.sparkSession)
        return links

    # a few centres of each node, those it shares much with: large groups become components by few comparisons
    near = index.select("rep", F.explode("centres").alias("c")).where("rep <> c").groupBy("rep", "c").count()
    near = near.join(sets.select("rep", "p"), "rep").where("count >= 0.3 * p")
    near = near.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("count", "c")), asc=False).alias("l"))
    near = near.select(F.col("rep").alias("a"), F.explode(F.slice("l", 1, 2)).alias("x")).select("a", F.col("x.c").alias("b"))
    near = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = verified(scratch.save(alike.union(near).distinct(), "near"))
    parts = connected_components(links, scratch).withColumnRenamed("node", "rep")
    own = sets.select("rep", "n").join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = scratch.save(index.select("rep", "i", "h").join(own, "rep"), "labelled")
    for part in indexes:
        scratch.drop(part)
    index = labelled
    mixed = index.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("h")
    index = index.join(mixed, "h")
    one, two = (index.select("h", *[F.col(c).alias(f"{x}_{c}") for c in ("rep", "n", "i", "component")]) for x in "ab")
    needed = share * (F.col("a_n") + F.col("b_n")) - 1e-6
    first = (F.col("a_n") - F.col("a_i") >= needed) & (F.col("b_n") - F.col("b_i") >= needed)  # else this is not the first shingle they share
    pairs = one.join(two, "h").where((F.col("a_rep") < F.col("b_rep")) & (F.col("a_component") != F.col("b_component")) & first)
    pairs = pairs.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct()

    @F.pandas_udf("boolean")
    def possible(one: pd.Series, two: pd.Series, most_apart: pd.Series) -> pd.Series:
        return pd.Series([least_apart(x, y) <= m for x, y, m in zip(one, two, most_apart, strict=True)], dtype=bool)

    for x in "ab":
        pairs = pairs.join(sets.select(F.col("rep").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_s")), x)
    pairs = pairs.where(possible("a_s", "b_s", (1 - 2 * share) * (F.col("a_n") + F.col("b_n")) + 1e-6))
    pairs = scratch.save(pairs.select("a", "b"), "pairs")
    scratch.drop(labelled)
    links = links.union(verified(pairs))
    parts = connected_components(links, scratch)
    grouped = nodes.join(parts, nodes.rep == parts.node, "left").select("key", F.coalesce("component", "rep").alias("component"))
    return prints.join(grouped, "key").select("doc_id", "k1", "k2", "component")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row of each group of similar texts: that of the smallest id (of equal ids, one; of null ids, one if no other is there)."""
    scratch = Scratch(docs.sparkSession)
    rows = keyed_rows(docs, id_col, text_col, scratch)
    grouped = similar_groups(docs, id_col=id_col, text_col=text_col, scratch=scratch, rows=rows, **kw)
    keep = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("o"))
    keep = scratch.save(keep.select("o.k1", "o.k2"), "keep")
    return rows.join(keep, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
