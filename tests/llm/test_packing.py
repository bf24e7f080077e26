import itertools
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from arrears.llm import packing, q07, tokens


def write(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, start string, row string").write.parquet(f"{path}/documents.parquet")


def test_pieces_cover_every_id_once(spark, tmp_path):
    rnd = random.Random(1)
    words = "don't stop THE É Straße <|endoftext|> a1b2 ... word, naïve ́x \x1cz 日本語 😀 it's".split(" ")
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 900))), "a", "b") for i in range(40)]
    rows += [(100, None, "", ""), (101, "", "", ""), (102, " \n", "", ""), (103, "same text", "", ""), (103, "same text", "", ""), (None, "no id", "", "")]
    rows.append((200, "\n".join(rnd.choices(words, k=30_000)), "", ""))
    write(spark, tmp_path, rows)
    got = q07.op7_packing(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(tokens.default_tokenizer())
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    for i, own in itertools.groupby(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start, r.sequence_id)), key=lambda r: r.doc_id):
        own, ids = list(own), want[i][0]
        assert all(r.doc_tokens == len(ids) for r in own)
        if len(want[i]) == 1:
            at = 0
            for r in own:
                assert r.start == at
                at += r.length
            assert at == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert {r.doc_id for r in got} == set(want)
    padded = 0
    for _, own in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded == 0


def test_hilbert_neighbours_differ_by_one():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    key = packing.hilbert_key(points, 3)
    assert sorted(key) == list(range(512))
    line = points[np.argsort(key)]
    assert (np.abs(np.diff(line, axis=0)).sum(1) == 1).all()


def test_no_rows(spark, tmp_path):
    write(spark, tmp_path, [])
    assert q07.op7_packing(spark, str(tmp_path)).count() == 0
