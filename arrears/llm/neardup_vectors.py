"""Operator 5, embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative a group.

Equal vectors of a label are one node. k-means is fitted on a bounded sample (`sample_values` numbers); every node goes to
the cell of its nearest centroid. So that no pair is lost, it also meets the members of each cell whose border it is near:
two unit vectors with cosine t are sqrt(2 - 2t) apart, so a partner of a cell's member lies at most that far beyond the
border with the cell. That default `margin` makes the result exact; a smaller one trades recall for work.

Cells that follow each other make blocks, of a label alone; a cell too large for one is cut. Of two blocks, the rows of one
travel to the other if they are near any of its cells, once each, and stream past it in slices; only degrees and the edges
of a spanning forest leave. Without clusters every row is near nearly all cells, and then copies grow with the number of
blocks, so they are counted first and made in rounds: a round's are no more numbers than the nodes have themselves
(`ROUND_VALUES` at least), and its shuffle is gone before the next. So disk stays in proportion to the input.

Vectors that are null, empty, zero or hold null or non-finite numbers, and those without a label, link with nothing;
vectors of different length do not either. Rows repeated, ids included, are copies of each other and link. Null ids keep
their row and name no component. No rows: no rows.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm._common import Scratch, connected_components, forget_shuffles
from arrears.operators.components import hang

THRESHOLD, CELL_GOAL = 0.93, 2048
PLACED_VALUES = 2_000_000  # numbers of copied vectors held at once
BLOCK_VALUES = (524_288, 2_097_152)  # numbers in a block, least and most: large blocks need fewer copies
ROUND_VALUES = 16_000_000  # numbers copied in a round, at least
STEP_CELLS = 2_097_152  # products held at once


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k unit centroids of unit vectors; empty cells keep their centroid."""
    rnd = np.random.default_rng(seed)
    if k <= 1 or len(sample) <= k:
        return sample[:1] if k <= 1 or not len(sample) else sample
    centroids = sample[rnd.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[lo : lo + 4096] @ centroids.T).argmax(1) for lo in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return centroids


def gaps(centroids: np.ndarray) -> np.ndarray:
    """How far each two centroids are apart."""
    return np.stack([np.linalg.norm(centroids - c, axis=1) for c in centroids])


def cells(x: np.ndarray, centroids: np.ndarray, gap: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector its nearest cell, and whether it lies within the margin of each cell."""
    s = x @ centroids.T
    own = s.argmax(1)
    near = s.max(1, keepdims=True) - s <= margin * gap[own] + 1e-9
    return own, near


class Block:
    """The rows of a block, held, and the groups they are in; others stream past. Each pair is looked at once."""

    def __init__(self, ids: np.ndarray, mult: np.ndarray, x: np.ndarray, centroids: np.ndarray, margin: float, threshold: float, within: bool):
        self.centroids, self.gap, self.margin, self.threshold = centroids, gaps(centroids), margin, threshold
        own, near = self.near(x)
        order = np.argsort(own, kind="stable")
        self.ids, self.mult, self.x, own, near = ids[order], mult[order], x[order], own[order], near[order]
        self.x32 = self.x.astype(np.float32)
        self.root, self.links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(ids)]
        self.cells = [(int(own[lo]), lo, hi) for lo, hi in itertools.pairwise(cuts)]
        for cell, lo, hi in self.cells if within else []:  # with its own later rows, and with those of later cells that are near it
            for r, c in self.hits(self.x, self.x32, np.arange(lo, hi), lo + np.flatnonzero(near[lo:, cell])):
                r, c = r[c > r], c[c > r]
                self.links += self.sums(r, self.mult[c], len(ids)) + self.sums(c, self.mult[r], len(ids))
                self.join(r, c)

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As cells, a few thousand rows at a time."""
        both = [cells(x[lo : lo + 4096], self.centroids, self.gap, self.margin) for lo in range(0, len(x), 4096)]
        return np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both])

    @staticmethod
    def sums(at: np.ndarray, what: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(at, what, n).astype(np.int64)

    def hits(self, x: np.ndarray, x32: np.ndarray, some: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which of some rows of x link with which of the block's own. Single precision decides all but those too close to the threshold for it."""
        slack = (x.shape[1] + 16) * 2.4e-7
        step = max(1, min(512, STEP_CELLS // max(1, len(own))))
        mine = self.x32[own].T
        for lo in range(0, len(some) if len(own) else 0, step):
            s = (x32[some[lo : lo + step]] @ mine).ravel()
            at = np.flatnonzero(s >= self.threshold - slack)
            if not len(at):
                continue
            r, c = some[lo + at // len(own)], own[at % len(own)]
            sure = s[at] >= self.threshold + slack
            unsure = np.flatnonzero(~sure)
            for k in range(0, len(unsure), 8192):
                u = unsure[k : k + 8192]
                sure[u] = np.einsum("ij,ij->i", x[r[u]], self.x[c[u]]) >= self.threshold
            yield r[sure], c[sure]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        one, two = self.root[a], self.root[b]
        if (new := one != two).any():
            n = len(self.root)
            pairs = np.unique(one[new] * n + two[new])
            nodes, low = hang(pairs // n, pairs % n)
            to = np.arange(n)
            to[nodes] = low
            self.root = to[self.root]

    def meet(self, ids: np.ndarray, mult: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        """Others against the block: what each of them hangs on, and how many it links with."""
        near, x32 = self.near(x)[1], x.astype(np.float32)
        first, links = np.full(len(ids), -1), np.zeros(len(ids), np.int64)
        for cell, lo, hi in self.cells:
            for r, c in self.hits(x, x32, np.flatnonzero(near[:, cell]), np.arange(lo, hi)):
                links += self.sums(r, self.mult[c], len(ids))
                self.links += self.sums(c, mult[r], len(self.ids))
                fresh = first[r] < 0
                first[r[fresh]] = c[fresh]
                self.join(first[r], c)
        linked = links > 0
        return edges(ids[linked], self.ids[first[linked]], links[linked])

    def end(self) -> pa.RecordBatch:
        linked = self.links > 0
        return edges(self.ids[linked], self.ids[self.root[linked]], self.links[linked])


def edges(a: np.ndarray, b: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], ["a", "b", "links"])


def mixed(ids: np.ndarray, salt: int) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(33)).astype(np.int64)


class Layout:
    """The blocks of a label that needs more than one: groups of cells that follow each other, and pieces of a large cell."""

    def __init__(self, counts: np.ndarray, rows: int):
        self.starts, sizes = [0], [int(counts[0])]
        for cell, n in enumerate(counts[1:].tolist(), 1):
            if sizes[-1] + n > rows:
                self.starts.append(cell)
                sizes.append(n)
            else:
                sizes[-1] += n
        self.cells, self.rows = len(counts), rows
        self.pieces = np.maximum(1, -(-np.array(sizes) // rows))
        self.first = np.cumsum(self.pieces) - self.pieces
        self.group = np.repeat(np.arange(len(sizes)), self.pieces)  # of each block
        self.of_cell = np.repeat(np.arange(len(sizes)), np.diff([*self.starts, len(counts)]))
        self.primes = np.array(sizes)[self.group] // self.pieces[self.group] + 1
        self.slices = self.turn = np.ones(len(self.group), np.int64)  # of each block: parts of those that come, and the round

    @classmethod
    def of(cls, state: dict) -> Layout:
        out = cls.__new__(cls)
        out.__dict__ |= state
        return out

    def home(self, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        group = self.of_cell[own]
        return self.first[group] + mixed(ids, 1) % self.pieces[group]

    def goes(self, near: np.ndarray, home: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Whether each row travels to each of the blocks: near it, and of two blocks one alone travels to the other."""
        near = np.logical_or.reduceat(near, self.starts, axis=1)[:, self.group[blocks]]
        x, y = home[:, None], blocks[None, :]
        return near & (x != y) & ((x < y) == ((x + y) % 2 == 1))


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
    cell_goal: int = CELL_GOAL, tile_rows: int | None = None, margin: float | None = None, sample_values: int = 4_000_000, max_cells: int = 1024,
    round_values: int | None = None,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector. `tile_rows`: of a block, else by BLOCK_VALUES."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    margin = float(np.sqrt(2 - 2 * threshold)) if margin is None else margin
    exact = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"  # numbers travel as they came
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("k1", F.xxhash64(F.lit(1), "label", "v")).withColumn("k2", F.xxhash64("v", F.lit(2), "label"))
    narrow = scratch.save(rows.select("vec_id", "good", "k1", "k2"), "vectors")
    nodes = rows.where("good").withColumn("v", F.col("v").cast(f"array<{exact}>"))
    nodes = nodes.groupBy("k1", "k2", "label", F.size("v").alias("dim")).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v"))
    nodes = scratch.save(nodes, "nodes")
    forget_shuffles(spark)

    def block_rows(dim: int, n: int) -> int:
        return tile_rows or max(64, BLOCK_VALUES[0] // dim, min(n // 16, BLOCK_VALUES[1] // dim))

    each = nodes.where("rep is not null").groupBy("dim", "label").count()
    sizes = each.groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()  # a row for each length of vectors
    centroids = {}
    for s in sizes:
        k = min(max_cells, -(-s.most // cell_goal))
        want = max(k * 8, sample_values // s.dim)
        drawn = nodes.where(F.col("dim") == s.dim).where(F.xxhash64("k1", F.lit(9)) / F.lit(2.0**64) + 0.5 <= min(1.0, want / s.n)) if k > 1 else nodes.where(F.col("dim") == s.dim)
        centroids[s.dim] = spherical_kmeans(unit(matrix(drawn.select("v").limit(want if k > 1 else 1).toArrow().column("v"))), k)

    # labels of more than one block: rows by the least rows of a block at most
    least = F.lit(tile_rows) if tile_rows else F.greatest(F.lit(64), F.floor(F.lit(BLOCK_VALUES[0]) / F.col("dim")))
    large = {(r.label, r.dim): r["count"] for r in each.where(F.col("count") > least).collect()}
    used = {key: min(len(centroids[key[1]]), -(-n // cell_goal)) for key, n in large.items()}  # any of the centroids do
    number = {key: i for i, key in enumerate(sorted(large))}
    linking = nodes.where("rep is not null").select("label", "dim", "rep", "mult", "v")
    models = spark.sparkContext.broadcast((centroids, number, used))  # bounded: max_cells centroids

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int] | None, np.ndarray]]:
        """The places of each large label's rows, and of the others'."""
        label, dim = batch.column("label").dictionary_encode(), batch.column("dim").to_numpy()
        code, names = label.indices.to_numpy(), label.dictionary.to_pylist()
        other = np.ones(batch.num_rows, bool)
        for key in {(names[c], int(d)) for c, d in set(zip(code.tolist(), dim.tolist(), strict=True))} & models.value[1].keys():
            at = (code == names.index(key[0])) & (dim == key[1])
            other &= ~at
            at, bound = np.flatnonzero(at), max(1, min(4096, PLACED_VALUES // key[1]))
            yield from ((key, at[lo : lo + bound]) for lo in range(0, len(at), bound))
        yield None, np.flatnonzero(other)

    apart: dict[tuple[str, int], np.ndarray] = {}  # of each task

    def placed(batch: pa.RecordBatch, key: tuple[str, int], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part, centres = batch.take(pa.array(at)), models.value[0][key[1]][: models.value[2][key]]
        if key not in apart:
            apart.clear()
            apart[key] = gaps(centres)
        own, near = cells(unit(matrix(part.column("v"))), centres, apart[key], margin)
        return part.column("rep").to_numpy(), own, near

    def counted(keys_of: Callable) -> dict[tuple[int, int], int]:
        """How often keys_of names a number for rows of each large label."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in batches:
                for key, at in parts(batch):
                    if key:
                        values, n = np.unique(keys_of(key, *placed(batch, key, at)), return_counts=True)
                        seen.update({(models.value[1][key], v): k for v, k in zip(values.tolist(), n.tolist(), strict=True)})
            yield pa.RecordBatch.from_pylist([{"i": i, "v": v, "n": n} for (i, v), n in seen.items()], pa.schema([("i", pa.int64()), ("v", pa.int64()), ("n", pa.int64())]))

        return {(r.i, r.v): r.n for r in linking.mapInArrow(count, "i long, v long, n long").groupBy("i", "v").agg(F.sum("n").alias("n")).collect()} if large else {}

    layouts: list[Layout] = []
    in_cells = counted(lambda key, ids, own, near: own)
    for key, i in number.items():
        layouts.append(Layout(np.array([in_cells.get((i, c), 0) for c in range(used[key])]), block_rows(key[1], large[key])))
    laid = spark.sparkContext.broadcast([vars(x) for x in layouts])  # bounded: a few numbers for every cell_goal rows

    def goals(key: tuple[str, int], ids: np.ndarray, own: np.ndarray, near: np.ndarray) -> np.ndarray:
        layout = Layout.of(laid.value[models.value[1][key]])
        return np.nonzero(layout.goes(near, layout.home(own, ids), np.arange(len(layout.group))))[1]

    coming = counted(goals)
    total = sum(s.n * s.dim for s in sizes)
    limit = max(ROUND_VALUES, total) if round_values is None else round_values
    turn, held = 0, total - sum(n * dim for (_, dim), n in large.items())  # labels of one block come first
    for key, i in number.items():
        layout = layouts[i]
        guests = np.array([coming.get((i, b), 0) for b in range(len(layout.group))])
        layout.slices = np.maximum(1, -(-guests // (4 * layout.rows)))
        layout.turn = np.zeros(len(guests), np.int64)
        for b, load in enumerate(((guests + layout.primes * layout.slices) * key[1]).tolist()):
            if held and held + load > limit:
                turn, held = turn + 1, 0
            layout.turn[b], held = turn, held + load
    plan = spark.sparkContext.broadcast([vars(x) for x in layouts])

    element = pa.float32() if exact == "float" else pa.float64()
    copies_schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("block", pa.int32()), ("slice", pa.int32()), ("guest", pa.bool_()), ("rep", pa.int64()), ("mult", pa.int64()), ("v", pa.list_(element))])
    copies_ddl = f"label string, dim int, block int, slice int, guest boolean, rep long, mult long, v array<{exact}>"

    def place(turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch: pa.RecordBatch, row: np.ndarray, block: np.ndarray, part: np.ndarray, guest: bool) -> Iterator[pa.RecordBatch]:
            bound = max(1, min(4096, PLACED_VALUES // max(1, int(batch.column("dim").to_numpy()[row].max(initial=1)))))
            for lo in range(0, len(row), bound):  # copies leave in bounded batches, however many blocks they go to
                took = batch.take(pa.array(row[lo : lo + bound]))
                at = [pa.array(x[lo : lo + bound].astype(np.int32)) for x in (block, part)]
                cols = [took.column("label"), took.column("dim"), *at, pa.array(np.full(took.num_rows, guest)), took.column("rep"), took.column("mult"), took.column("v").cast(pa.list_(element))]
                yield pa.RecordBatch.from_arrays(cols, schema=copies_schema)

        for batch in batches:
            for key, at in parts(batch):
                if key is None:
                    if turn == 0:
                        yield from out(batch, at, np.zeros(len(at)), np.zeros(len(at)), False)
                    continue
                layout = Layout.of(plan.value[models.value[1][key]])
                if not len(blocks := np.flatnonzero(layout.turn == turn)):
                    continue
                ids, own, near = placed(batch, key, at)
                home = layout.home(own, ids)
                row = np.flatnonzero(layout.turn[home] == turn)
                n = layout.slices[home[row]]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield from out(batch, at[np.repeat(row, n)], np.repeat(home[row], n), within, False)
                row, block = np.nonzero(layout.goes(near, home, blocks))
                block = blocks[block]
                yield from out(batch, at[row], block, mixed(ids[row], 2) % layout.slices[block], True)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None

        def built() -> Block:
            t = pa.Table.from_batches(held).combine_chunks()
            at = models.value[0][key[1]]
            k = models.value[2].get(key[:2], -(-t.num_rows // cell_goal))
            return Block(t.column("rep").to_numpy(), t.column("mult").to_numpy(), unit(matrix(t.column("v"))), at[:k], margin, threshold, key[3] == 0)

        for batch in batches:
            names = batch.column("label").to_numpy(zero_copy_only=False)
            cols = [names, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "block", "slice", "guest"))]
            change = np.zeros(max(batch.num_rows - 1, 0), bool)
            for c in cols:
                change |= c[1:] != c[:-1]
            for lo, hi in itertools.pairwise([0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                now, piece = (names[lo], *(int(c[lo]) for c in cols[1:4])), batch.slice(lo, hi - lo)
                if now != key:
                    if held or block:
                        yield (block or built()).end()
                    key, held, block = now, [], None
                if not cols[4][lo]:
                    held.append(piece.select(["rep", "mult", "v"]))
                    continue
                if block is None and held:
                    block, held = built(), []
                if block is None:
                    continue  # a block without rows: none of the kind is laid out
                bound = max(1, min(4096, PLACED_VALUES // key[1]))
                for at in range(0, piece.num_rows, bound):
                    some = piece.slice(at, bound)
                    yield block.meet(some.column("rep").to_numpy(), some.column("mult").to_numpy(), unit(matrix(some.column("v"))))
        if held or block:
            yield (block or built()).end()

    keys, met = ["label", "dim", "block", "slice"], []
    for t in range(turn + 1):
        copies = linking.mapInArrow(functools.partial(place, t), copies_ddl).repartition(*keys).sortWithinPartitions(*keys, "guest")
        met.append(scratch.save(copies.mapInArrow(meet, "a long, b long, links long"), "met"))
        del copies
        forget_shuffles(spark)
    met = functools.reduce(DataFrame.union, met)
    joined = connected_components(met.select("a", "b"), scratch)
    degree = met.groupBy("a").agg(F.sum("links").alias("others"))
    known = nodes.select("k1", "k2", "rep", "mult").join(degree, F.col("rep") == F.col("a"), "left").join(joined, F.col("rep") == F.col("node"), "left")
    known = known.select("k1", "k2", F.lit(True).alias("good"), F.coalesce("component", "rep").alias("component"), (F.col("mult") - 1 + F.coalesce("others", F.lit(0))).alias("n"))
    out = narrow.join(known, ["k1", "k2", "good"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
