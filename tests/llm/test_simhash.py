import random

import numpy as np
import pytest
import xxhash

from arrears.llm import q02, simhash
from arrears.llm._common import Scratch


def brute_print(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius):
    ids = list(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def texts():
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("alpha Beta gamma delta eps zeta Eta theta iota kappa".split()) for _ in range(n)) for n in (3, 40, 90, 200, 700)]
    out = [None, "", "  \n", "one", "one two three", "ONE two three", "é è É", "x " * 600]
    for b in base:
        w = b.split()
        for k in range(6):
            v = list(w)
            for _ in range(k):
                v[rnd.randrange(len(v))] = "word%d" % rnd.randrange(1000)
            out.append(" ".join(v))
    return out + [base[2]] * 5


def test_fingerprints_and_components_match_brute_force(spark, tmp_path):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, component string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in q02.op2_simhash(spark, str(tmp_path)).collect()}
    prints = {i: brute_print(t) for i, t, _, _ in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints, 4)


@pytest.mark.parametrize("radius", [0, 3, 4, 9])
def test_close_pairs(radius):
    rnd = np.random.default_rng(5)
    fps = rnd.integers(0, 2**63, 400).astype(np.uint64)
    for i in range(0, 400, 2):
        flips = rnd.choice(64, rnd.integers(0, 12), replace=False)
        fps[i + 1] = fps[i] ^ np.uint64(sum(1 << int(b) for b in flips))
    got = {(i, int(j)) for i, found in simhash.close_pairs(fps, radius) for j in found}
    assert got == {(i, j) for i in range(400) for j in range(i + 1, 400) if bin(int(fps[i] ^ fps[j])).count("1") <= radius}


@pytest.mark.parametrize("nodes", [10, 2**30, 2**33, 2**45])
def test_every_scheme_and_split_buckets_lose_no_link(spark, nodes):
    rnd = random.Random(nodes)
    prints = {}
    for g in range(60):
        own = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 9)):
            prints[len(prints)] = own
            for _ in range(rnd.randrange(0, 5)):
                own ^= 1 << rnd.randrange(64)
    df = spark.createDataFrame([(i, simhash.signed(p)) for i, p in prints.items()] + [(None, 7)], "doc_id long, fp long")
    scratch = Scratch(spark)
    got = {r.fp: r.component for r in simhash.groups(df, scratch, tile_rows=3, masks=simhash.scheme(nodes, 4)).collect()}
    assert got.pop(7) is None
    assert {i: got[simhash.signed(p)] for i, p in prints.items()} == brute_components(prints, 4)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert q02.op2_simhash(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_null_ids(spark, tmp_path):
    spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "a b"), (None, "q r s t u v")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.component_id) for r in q02.op2_simhash(spark, str(tmp_path)).collect()), key=str)
    assert got == [(5, 5), (5, 5), (None, 5), (None, None)]
