"""Operator 7, packing along a space-filling curve.

A document's hashed bag of token ids is projected to a few dimensions; the documents are range-sorted by the Hilbert key
of that point and laid end to end, so that neighbours in a sequence are alike. The line of ids is cut every `length`
ids, which pads nothing; what is left at its end is cut at powers of two, each a sequence of its own. The only global
state is one sum for each range partition.

Null or blank text: the end id alone. Repeated rows and null ids each keep their pieces (a row has a key of its own, which
also breaks ties on the curve). A long document is cut like any other. No rows: no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm import tokens
from arrears.llm._common import Scratch, running_starts

LENGTH = 2048
DIMS, BITS, HASHED = 4, 8, 512


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of unsigned coordinates (Skilling 2004)."""
    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            if i:
                x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[:, -1] & q, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray], dims: int = DIMS, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """A Hilbert key for each list of token ids."""
    random = np.random.default_rng(seed)
    axes = random.standard_normal((HASHED, dims)).astype(np.float32)
    axes = np.stack([axes, -axes], 1).reshape(-1, dims)  # a token's hash is a place and a sign
    sizes = np.array([len(x) for x in ids], np.int64)
    points = np.zeros((len(ids), dims), np.float64)
    if sizes.sum():
        every = np.concatenate(ids).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rows = axes[(every >> np.uint64(54)).view(np.int64)]
        some = sizes > 0
        points[some] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.float64)
        norm = np.linalg.norm(points, axis=1, keepdims=True)
        points /= np.where(norm == 0, 1, norm)
    return hilbert_key(np.minimum((points + 1) / 2 * (1 << bits), (1 << bits) - 1), bits)


def bounds_of(total: int, length: int) -> Callable[[int], tuple[int, int, int]]:
    """From a place on the line of ids to its sequence's number, first place and end."""
    whole = total // length
    cuts = [whole * length]
    for b in range(length.bit_length() - 1, -1, -1):
        if (total - whole * length) >> b & 1:
            cuts.append(cuts[-1] + (1 << b))

    def bounds(place: int) -> tuple[int, int, int]:
        if place < cuts[0]:
            k = place // length
            return k, k * length, (k + 1) * length
        k = next(i for i in range(1, len(cuts)) if place < cuts[i])
        return whole + k - 1, cuts[k - 1], cuts[k]

    return bounds


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str | None = None, by_word: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession)
    table = tokens.token_table(docs, scratch, id_col=id_col, text_col=text_col, tokenizer=tokenizer, by_word=by_word, place=curve_keys)
    starts, total = running_starts(table.select("row", "n", "curve"), "n", ["curve", "row"], scratch)
    path, bounds = tokenizer or tokens.default_tokenizer(), bounds_of(total, length)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    schema = pa.schema([(x, pa.int64()) for x in names])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, kind = tokens.encoder(path, by_word)
        for batch in batches:
            out: dict[str, list] = {x: [] for x in names}
            for doc, ids, n, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "n", "at")), strict=True):
                for start, size, sequence, offset, own in tokens.cut(ids, at, kind.itemsize, n, bounds):
                    crc = zlib.crc32(np.frombuffer(own, kind).astype("<u4").tobytes())
                    for name, x in zip(names, (doc, start, size, crc, n, sequence, offset), strict=True):
                        out[name].append(x)
            yield tokens.arrow(out, schema)

    rows = table.select("row", F.col("doc_id").cast("long").alias("doc_id"), "ids", "n").join(starts.select("row", "at"), "row")
    return rows.select("doc_id", "ids", "n", "at").mapInArrow(pieces, SCHEMA)
