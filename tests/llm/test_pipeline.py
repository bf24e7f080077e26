import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from arrears.llm import simhash, tokens
from tests.llm.test_linededup import brute as brute_lines  # noqa: F401  (same rules, checked there)
from tests.llm.test_linededup import key

LETTERS = {"xx": "abcdefgh", "yy": "nopqrstu"}


def word(rnd, lang):
    return "".join(rnd.choices(LETTERS[lang], k=rnd.randrange(2, 8)))


def documents():
    rnd = random.Random(11)
    text = lambda lang, n: [word(rnd, lang) for _ in range(n)]
    item = text("xx", 30)
    docs, shared = [], "A shared line, in all of these documents"
    for i in range(120):
        lang = "xx" if i % 2 else "yy"
        docs.append((i, " ".join(text(lang, 80)) + ("\n" + shared if i % 5 == 0 else ""), lang))
    docs += [(200, docs[3][1], "xx"), (201, docs[3][1].upper(), "xx"), (202, None, "xx"), (203, "", "yy"), (204, "1234 5678", "xx")]
    for k in range(6):  # near copies: one word of 80 changed, 0.88 and more
        w = docs[7][1].split(" ")
        w[10 * k + 3] = "changed"
        docs.append((300 + k, " ".join(w), "xx"))
    docs.append((400, " ".join(text("xx", 20) + item + text("xx", 20)), "xx"))
    return docs, [(1, " ".join(item))]


def grams(t):
    w = t.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(docs, items):
    """What is kept, in order: letters; lines; similar texts, the smallest id first; items held."""
    kept = {i: t for i, t, _ in docs if t and any(c.isalpha() for c in t)}
    lines = {}
    for i, t in kept.items():
        for x in set(map(key, t.split("\n"))):
            if len(x) >= 20:
                lines.setdefault(x, []).append(i)
    common = {x: max(own) for x, own in lines.items() if len(own) >= 3}
    kept = {i: "\n".join(x for x in t.split("\n") if common.get(key(x), i) == i) for i, t in kept.items()}
    out = {}
    for i, t in sorted(kept.items()):
        if not any(len(grams(t) & grams(u)) / len(grams(t) | grams(u)) >= 0.8 for u in out.values()):
            out[i] = t
    return {i: t for i, t in out.items() if not any(x in t for _, x in items)}


def test_run_matches_brute_force(spark, tmp_path):
    docs, items = documents()
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    want = brute(docs, items)
    assert set(got) == set(want)
    tok = Tokenizer.from_file(tokens.default_tokenizer())
    for i, t in want.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for s, n, crc in got[i]) and sum(n for _, n, _ in got[i]) == len(ids)


def test_filtering_stages_keep_the_columns(spark):
    df = spark.createDataFrame([(1, "abc", "xx", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, df, "").columns == df.columns


def test_similar_texts_are_found(spark):
    """Recall against all pairs, at similarities from 0.8 up: at least 0.95 of the linked texts; and no link below 0.8."""
    rnd = random.Random(6)
    rows = []
    for g in range(150):
        w = ["w%d" % rnd.randrange(5000) for _ in range(rnd.choice([60, 150, 400]))]
        rows.append((2 * g, " ".join(w)))
        for _ in range(rnd.randrange(1, 1 + len(w) // 50)):
            w[rnd.randrange(len(w))] = "new%d" % rnd.randrange(5000)
        rows.append((2 * g + 1, " ".join(w)))
    sim = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    close = {2 * g: sim(rows[2 * g][1], rows[2 * g + 1][1]) for g in range(150)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.dedup(df).collect()}
    gone = {i - 1 for i in range(1, 300, 2) if i not in kept}
    assert all(close[i] >= 0.8 for i in gone) and {2 * g for g in range(150)} <= kept
    assert len(gone) >= 0.95 * sum(v >= 0.8 for v in close.values()) > 50


def test_dedup_keeps_one_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "z"), (None, "z"), (5, None), (6, "")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.dedup(df).collect()), key=str) == [(1, "a b c"), (5, None), (None, "z")]
    assert simhash.dedup(df.limit(0)).count() == 0


def test_a_shingle_that_fills_two_texts_does_not_join_them(spark):
    rnd = random.Random(8)
    own = lambda: " ".join("w%d" % rnd.randrange(10**6) for _ in range(200))
    rows = [(k, f"{own()}\n{'lol ' * 600}") for k in range(3)]
    rows += [(3, rows[0][1] + "lol lol")]  # the same distinct shingles
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.dedup(df).collect()) == [0, 1, 2]


def test_every_similar_pair_of_dense_families_is_linked(spark):
    """Families of templated texts, most pairs at 0.6 to 0.8: the groups are those of all pairs."""
    rnd = random.Random(12)
    rows = []
    for _ in range(4):
        base = ["w%d" % rnd.randrange(10**6) for _ in range(120)]
        for _ in range(60):
            w = list(base)
            for at in rnd.sample(range(120), rnd.choice([1, 2, 3, 4, 5])):
                w[at] = "new%d" % rnd.randrange(10**6)
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), rows[-1][1] + " one more"))
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    for often in (1, 12):
        groups = {}
        for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), often=often).collect():
            groups.setdefault(r.component, set()).add(root[r.doc_id])
        assert all(len(x) == 1 for x in groups.values()) and len(groups) == len(set(root)) > 8


def test_near_dedup_takes_the_links_of_fingerprints(spark, monkeypatch):
    """All sets with fingerprints within 4 bits are linked, by links within 4 bits alone, and verified: unlike texts stay."""
    rnd, seen, save = random.Random(3), {}, simhash.Scratch.save
    rows = []
    for _ in range(12):
        w = ["w%d" % rnd.randrange(10**6) for _ in range(300)]
        rows.append(" ".join(w))
        for _ in range(4):
            w[rnd.randrange(300)] = "new%d" % rnd.randrange(10**6)
            rows.append(" ".join(w))
    rows += ["w%d w%d %s" % (rnd.randrange(10**6), rnd.randrange(10**6), "lol " * 600) for _ in range(3)]  # one fingerprint
    rows = list(enumerate(rows))

    def saved(self, df, name, **kw):
        seen[name] = save(self, df, name, **kw)
        return seen[name]

    monkeypatch.setattr(simhash.Scratch, "save", saved)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    fp = simhash.majority([simhash.shingle_hashes(t.encode(), 5) for _, t in rows])
    close = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    own = {r.rep: np.uint64(r.fp % 2**64) for r in seen["sets"].collect()}
    links = [(r.a, r.b) for r in seen["alike"].collect()]
    assert all(np.bitwise_count(own[a] ^ own[b]) <= 4 for a, b in links)
    joined, all_close = {r: r for r in own}, list(range(len(rows)))
    for a, b in links:
        joined = {r: joined[a] if x == joined[b] else x for r, x in joined.items()}
    for i, j in np.argwhere(close):
        all_close = [all_close[i] if x == all_close[j] else x for x in all_close]
    assert len(set(joined.values())) == len(set(all_close)) < len(rows) - 20
    assert kept == {*range(0, 60, 5), 60, 61, 62}


def test_clashing_columns_pass_all_filtering_stages(spark, tmp_path):
    names = ["row", "k1", "k2", "_langid", "_kept", "_n_lines", "_print", "_keep_id", "print", "component", "key", "prefix", "rep", "gone", "lines", "_d", "_p", "h", "n"]
    rnd = random.Random(2)
    text = lambda: " ".join(word(rnd, "xx") for _ in range(60))
    rows = [(i, text(), "xx", "s", 3, *names) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    spark.createDataFrame([(1, text())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        got = out.collect()
        assert len(got) == 30 and all(list(r)[5:] == names for r in got)


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
