"""Operator 9, token ids in training order: fixed-stride shards under a keyed Feistel permutation.

Documents' ids are laid end to end in the order they are read and cut into sequences of `length`; the last one is filled
with the pad id. Places on that line come from one sum for each partition of the written token table, so nothing is
joined or sorted for them; the one shuffle takes compressed pieces to their shards. A balanced Feistel network over the smallest even power of two that holds all sequence numbers, walked along its
cycle until it falls inside them, gives each sequence its slot: a permutation that any worker computes for itself.
Slots are range-partitioned by shard; a task writes each of its shards as one file of `slots_per_shard` records of equal
stride, under another name until it is whole, so a lost executor's shard is written anew and a resumed run skips those
that are there; names hold a digest of the line, so that only shards of the same ids in the same order are taken up. A training job reads slot s at byte (s mod slots_per_shard) x stride of its shard, in order; `read`
starts at any slot.

Null or blank text: the end id alone. Repeated rows and null ids each keep their ids; texts of any
length are cut like others. No rows: no shards.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm import tokens
from arrears.llm._common import Scratch

LENGTH, SLOTS_PER_SHARD, ROUNDS, PAD = 2048, 2048, 6, 0


def round_keys(key: str, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{key}/{i}".encode()).digest()[:8], "little") for i in range(rounds)]


def permute(x: np.ndarray, n: int, key: str, *, inverse: bool = False) -> np.ndarray:
    """Where the keyed permutation of range(n) takes each x (or, inverted, whence)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = round_keys(key)

    def mix(v: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            v = (v ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            v = (v ^ (v >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (v ^ (v >> np.uint64(29))) & mask

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in keys[::-1] if inverse else keys:
            left, right = (right ^ mix(left, k), left) if inverse else (right, left ^ mix(right, k))
        return (left << shift) | right

    out = once(np.asarray(x).astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def shard_path(uri: str, digest: str, shard: int) -> str:
    return f"{uri}/shard-{digest}-{shard:08d}.bin"


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def materialise(
    docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, slots_per_shard: int = SLOTS_PER_SHARD,
    key: str = "training-order", tokenizer: str | None = None, by_word: bool = True, pad: int = PAD, scratch: Scratch | None = None,
) -> tuple[DataFrame, dict]:
    """Writes the shards into `folder` (a URI that all executors reach) and returns their index, which is a written table:
    doc_id, start, length, sequence_id, slot, shard, offset of each piece; and the layout."""
    scratch = scratch or Scratch(docs.sparkSession)
    table = tokens.token_table(docs, scratch, id_col=id_col, text_col=text_col, tokenizer=tokenizer, by_word=by_word)
    part = F.shiftright("row", 33)
    rows = table.withColumn("_part", part)
    sums = rows.groupBy("_part").agg(F.sum("n").alias("n"), F.bit_xor(F.xxhash64("row", "doc_id", "n", F.xxhash64("ids"))).alias("h"))
    base, total, mixed = [], 0, 0
    for r in sorted(map(tuple, sums.collect())):  # a row a partition
        base.append((r[0], total))
        total, mixed = total + r[1], mixed ^ r[2]
    digest = hashlib.sha256(f"{mixed}/{total}/{length}/{slots_per_shard}/{key}/{pad}".encode()).hexdigest()[:12]
    bases = scratch.spark.createDataFrame(base, "_part long, _base long")
    count = -(-total // length)
    path = tokenizer or tokens.default_tokenizer()
    rows = rows.join(F.broadcast(bases), "_part").select(F.col("doc_id").cast("long").alias("doc_id"), "ids", "n", (F.col("at") + F.col("_base")).alias("at"))
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "sequence_id", "slot", "shard", "offset")), ("ids", pa.binary())])
    ddl = "doc_id long, start long, length long, sequence_id long, slot long, shard long, offset long, ids binary"

    def bounds(place: int) -> tuple[int, int, int]:
        k = place // length
        return k, k * length, (k + 1) * length

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, kind = tokens.encoder(path, by_word)
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, ids, n, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "n", "at")), strict=True):
                for start, size, sequence, offset, own in tokens.cut(ids, at, kind.itemsize, n, bounds):
                    for name, x in (("doc_id", doc), ("start", start), ("length", size), ("sequence_id", sequence), ("offset", offset), ("ids", pack(own))):
                        out[name].append(x)
            slot = permute(np.array(out["sequence_id"], np.int64), count, key)
            yield tokens.arrow(out | {"slot": slot, "shard": slot // slots_per_shard}, schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, kind = tokens.encoder(path, by_word)
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        shard, sink, at, name = -1, None, 0, ""
        unpack = zstandard.ZstdDecompressor().decompress

        def fill(upto: int) -> None:
            nonlocal at
            if upto > at:
                sink.write(np.full(upto - at, pad, kind).tobytes())
                at = upto

        def close() -> None:
            if sink:
                fill(min(slots_per_shard, count - shard * slots_per_shard) * length)
                sink.close()
                fs.move(name, shard_path(root, digest, shard))

        for batch in batches:
            for number, slot, offset, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "offset", "ids")), strict=True):
                if number != shard:
                    close()
                    shard, at = number, 0
                    from pyarrow.fs import FileType

                    info = fs.get_file_info(shard_path(root, digest, shard))
                    whole = min(slots_per_shard, count - shard * slots_per_shard) * length * kind.itemsize
                    name = f"{root}/.{uuid.uuid4().hex}.part"
                    sink = None if info.type == FileType.File and info.size == whole else fs.open_output_stream(name)
                if sink:
                    place = (slot - shard * slots_per_shard) * length + offset
                    fill(place)
                    own = unpack(ids)
                    sink.write(own)
                    at = place + len(own) // kind.itemsize
            yield batch.drop_columns(["ids"])
        close()

    placed = rows.mapInArrow(pieces, ddl)
    shards = max(1, -(-count // slots_per_shard))
    dealt = placed.repartitionByRange(min(shards, 100_000), "shard").sortWithinPartitions("shard", "slot", "offset")
    index = scratch.save(dealt.mapInArrow(write, ddl.removesuffix(", ids binary")), "index")
    scratch.drop(table)
    layout = {"folder": folder, "digest": digest, "tokens": total, "sequences": count, "length": length, "slots_per_shard": slots_per_shard, "key": key, "tokenizer": path, "by_word": by_word}
    return index, layout


def read(spark: SparkSession, layout: dict, from_slot: int = 0, to_slot: int | None = None, *, batch_values: int = 1_000_000) -> DataFrame:
    """slot, sequence_id, ids of the slots from `from_slot` until before `to_slot` (none: the end), in order: a task a shard, in order of
    shards, each seeks its first slot and reads on from there, so that a run stopped at slot s goes on with from_slot = s."""
    count, length, per = layout["sequences"], layout["length"], layout["slots_per_shard"]
    folder, digest, key, path, by_word = (layout[k] for k in ("folder", "digest", "key", "tokenizer", "by_word"))
    stop = count if to_slot is None else min(to_slot, count)
    if from_slot < 0:
        raise ValueError("slots count from 0")
    schema = pa.schema([("slot", pa.int64()), ("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    step = max(1, batch_values // length)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, kind = tokens.encoder(path, by_word)
        fs, root = open_fs(folder)
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                slots = range(max(from_slot, shard * per), min(stop, (shard + 1) * per))
                if not slots:
                    continue
                with fs.open_input_file(shard_path(root, digest, shard)) as source:
                    source.seek((slots.start - shard * per) * length * kind.itemsize)
                    for lo in range(slots.start, slots.stop, step):
                        own = np.arange(lo, min(lo + step, slots.stop))
                        ids = np.frombuffer(source.read(len(own) * length * kind.itemsize), kind)
                        if len(ids) != len(own) * length:
                            raise ValueError(f"shard {shard} ends before slot {own[-1]}")
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) + 1, length, dtype=np.int32)), pa.array(ids.astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(permute(own, count, key, inverse=True)), lists], schema=schema)

    first, last = from_slot // per, max(from_slot // per, -(-stop // per))
    return spark.range(first, last, 1, max(1, min(last - first, 100_000))).mapInArrow(scan, "slot long, sequence_id long, ids array<int>")


def read_back(index: DataFrame, layout: dict) -> DataFrame:
    """The index and, from the shards' bytes, read in order, each piece's ids_crc32 (over little-endian 32-bit ids)."""
    folder, digest, length, per, path, by_word = (layout[k] for k in ("folder", "digest", "length", "slots_per_shard", "tokenizer", "by_word"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, kind = tokens.encoder(path, by_word)
        fs, root = open_fs(folder)
        shard, source = -1, None
        for batch in batches:
            crc = []
            for number, slot, offset, size in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "offset", "length")), strict=True):
                if number != shard:
                    if source:
                        source.close()
                    shard, source, at = number, fs.open_input_stream(shard_path(root, digest, number)), 0
                place = ((slot - shard * per) * length + offset) * kind.itemsize
                if place > at:
                    source.read(place - at)
                own = source.read(size * kind.itemsize)
                at = place + len(own)
                crc.append(zlib.crc32(np.frombuffer(own, kind).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crc, pa.int64())], [*batch.schema.names, "ids_crc32"])
        if source:
            source.close()

    shards = max(1, -(-layout["sequences"] // per))
    dealt = index.repartitionByRange(min(shards, 100_000), "shard").sortWithinPartitions("shard", "slot", "offset")
    from pyspark.sql import types as T

    return dealt.mapInArrow(check, T.StructType([*index.schema.fields, T.StructField("ids_crc32", T.LongType())]))
