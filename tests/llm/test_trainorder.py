import random

import numpy as np
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from arrears.llm import q09, tokens, trainorder


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    x = np.arange(n)
    y = trainorder.permute(x, n, "k")
    assert sorted(y) == list(range(n)) and (trainorder.permute(y, n, "k", inverse=True) == x).all()
    assert n < 64 or (y != trainorder.permute(x, n, "other")).any()


def test_shards_hold_all_ids_and_resume(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices(["alpha", "beta's", "Gamma.", "d4"], k=rnd.randrange(0, 300))), "a", "b") for i in range(30)]
    rows += [(40, None, "a", "b"), (41, "x " * 3000, "a", "b"), (41, "x " * 3000, "a", "b"), (None, "nobody", "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, shard string")
    kw = dict(length=64, slots_per_shard=10)
    index, layout = trainorder.materialise(docs, f"file://{tmp_path}/out", **kw)
    tok = Tokenizer.from_file(tokens.default_tokenizer())
    line = [x for _, t, *_ in rows for x in [*tok.encode(t or "", add_special_tokens=False).ids, 1]]
    assert layout["tokens"] == len(line) and layout["sequences"] == -(-len(line) // 64)
    files = sorted(p for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    every = np.concatenate([np.frombuffer(p.read_bytes(), "<u2") for p in files]).reshape(-1, 64)
    assert [p.stat().st_size for p in files[:-1]] == [10 * 64 * 2] * (len(files) - 1)
    order = trainorder.permute(np.arange(len(every)), len(every), "training-order")
    assert every[order].reshape(-1)[: len(line)].tolist() == line and not every[order].reshape(-1)[len(line) :].any()
    crc = {(r.slot, r.offset): r.ids_crc32 for r in trainorder.read_back(index, layout).collect()}
    n = len(every)
    for start, stop in ((0, None), (7, None), (10, None), (n - 1, None), (n, None), (n + 25, None), (5, 12), (3, 3)):
        got = trainorder.read(spark, layout, start, stop, batch_values=200).collect()
        assert [r.slot for r in got] == list(range(start, n if stop is None else stop)) and [list(r.ids) for r in got] == every[start:stop].tolist()
        assert all(order[r.sequence_id] == r.slot for r in got)
    with pytest.raises(ValueError, match="slots"):
        trainorder.read(spark, layout, -1)
    before = [p.stat().st_mtime_ns for p in files]
    files[1].unlink()
    index, layout = trainorder.materialise(docs, f"file://{tmp_path}/out", **kw)
    assert [p.stat().st_mtime_ns for p in files][2:] == before[2:] and np.frombuffer(files[1].read_bytes(), "<u2").tolist() == every[10:20].reshape(-1).tolist()
    assert {(r.slot, r.offset): r.ids_crc32 for r in trainorder.read_back(index, layout).collect()} == crc
    assert len(crc) == index.count() and isinstance(fs.LocalFileSystem(), fs.FileSystem)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert q09.op9_trainorder(spark, str(tmp_path)).count() == 0
