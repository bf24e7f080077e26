import random
import zlib

import numpy as np

from arrears.llm import langid, q01

SOUNDS = {"aa": ["ba", "lo", "mi", "ter", "é"], "bb": ["sch", "un", "ge", "ß", "lo"], "cc": ["ño", "ba", "que", "mi", "ra"]}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choices(SOUNDS[lang], k=rnd.randrange(1, 4))) for _ in range(n))


def rows():
    rnd = random.Random(9)
    out = [(i, text(rnd, lang, rnd.randrange(5, 80)), lang, "s", "p") for i, lang in enumerate(rnd.choices(list(SOUNDS), k=400))]
    out += [(1000, None, "aa", "s", "p"), (1001, "", "aa", "s", "p"), (1002, "123 ... 4", "bb", "s", "p"), (1003, "日本語 文字 漢字 " * 30, None, "s", "p")]
    out += [(1004, text(rnd, "aa", 20_000), "aa", "s", "p"), (1004, text(rnd, "aa", 30), "aa", "s", "p"), (None, text(rnd, "cc", 40), "cc", "s", "p")]
    return out


def test_held_out_accuracy_and_defined_cases(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, "doc_id long, text string, lang string, score string, lang_pred string").write.parquet(f"{tmp_path}/documents.parquet")
    got = q01.op1_langid(spark, str(tmp_path)).collect()
    assert len(got) == len(data)
    lang = {i: x for i, _, x, *_ in data}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(held) > 80 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    by = {r.doc_id: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[1003].lang_pred in SOUNDS and by[1003].rejected  # a learned language, but far from all of them
    assert by[1004].lang_pred == "aa" and by[None].lang_pred == "cc"
    assert sum(r.rejected for r in got if r.doc_id is not None and r.doc_id < 1000) == 0
    assert all(0 <= r.score <= 1 for r in got)


def test_probabilities_sum_to_one_and_batches_do_not_matter():
    rnd = random.Random(1)
    texts = {k: [text(rnd, k, 60) for _ in range(40)] for k in SOUNDS}
    model = langid.train(list(texts.values()), list(texts))
    letters = sorted({c for own in texts.values() for t in own for c in t if c != " "} | {" "})
    logs = [langid.entropies(model, [f"ba lo{c}" if c != " " else "ba lo "], squares=False) for c in letters]
    # the chance of each next sign: the total's change from "ba lo"; those unseen in a language share what is left
    base = langid.entropies(model, ["ba lo"])
    total = sum(np.exp(m[0] * n[0] - base[0][0] * base[1][0]) for m, n, *_ in logs)
    assert (total > 0.9).all() and (total <= 1 + 1e-6).all()
    flat = [t for own in texts.values() for t in own]
    one = langid.entropies(model, flat)[0]
    assert np.allclose(one, np.concatenate([langid.entropies(model, [t])[0] for t in flat]))


def plain_signs(text):
    out = []
    for c in text:
        c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
        if c != " " or out and out[-1] != " ":
            out.append(c)
    return ["^"] * (langid.ORDER - 1) + out  # the blanks before a text count as blanks


def plain_kneser_ney(texts, vocabulary):
    """Interpolated Kneser-Ney in dictionaries: a function from a context and a sign to the sign's probability."""
    order, counts = langid.ORDER, [{} for _ in range(langid.ORDER + 1)]
    for t in texts:
        own = [" " if c == "^" else c for c in plain_signs(t)]
        for i in range(order - 1, len(own)):
            gram = tuple(own[i - order + 1 : i + 1])
            counts[order][gram] = counts[order].get(gram, 0) + 1
    for n in range(order - 1, 0, -1):
        for gram in counts[n + 1]:
            counts[n][gram[1:]] = counts[n].get(gram[1:], 0) + 1
    cut = [0] * (order + 1)
    for n in range(1, order + 1):
        once, twice = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        cut[n] = once / (once + 2 * twice) if once and twice else 0.5

    def chance(context, sign):
        n = len(context) + 1
        lower = chance(context[1:], sign) if context else 1 / vocabulary
        after = [c for g, c in counts[n].items() if g[:-1] == context]
        if not after:
            return lower
        return max(counts[n].get((*context, sign), 0) - cut[n], 0) / sum(after) + cut[n] * len(after) / sum(after) * lower

    return chance


def test_equals_plain_kneser_ney():
    rnd = random.Random(4)
    texts = [[text(rnd, k, rnd.randrange(1, 9)) for _ in range(12)] for k in SOUNDS]
    texts[0] += ["", " 12 ", "a", "É--x  y."]
    model = langid.train(texts, list(SOUNDS))
    signs = {c if c != "^" else " " for own in texts for t in own for c in plain_signs(t)[langid.ORDER - 1 :]}
    chances = [plain_kneser_ney(own, len(signs) + 1) for own in texts]
    new = [text(rnd, "bb", 6), "É new; word 7 with ñ", "日本", "x"]
    got = langid.entropies(model, new)[0]
    for i, t in enumerate(new):
        own = [" " if c == "^" else c for c in plain_signs(t)]
        for j, chance in enumerate(chances):
            logs = [np.log(chance(tuple(own[k - langid.ORDER + 1 : k]), own[k])) for k in range(langid.ORDER - 1, len(own))]
            assert abs(np.mean(logs) - got[i][j]) < 1e-5


def test_many_labels_share_the_sample(spark):
    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, text(rnd, "aa", 60), f"l{i % 50}") for i in range(400)], "doc_id long, text string, lang string")
    read = []
    langid_train, langid.train = langid.train, lambda texts, *a: read.append(sum(len(t) for own in texts for t in own)) or langid_train(texts, *a)
    try:
        langid.fit(docs, max_chars=20_000)
    finally:
        langid.train = langid_train
    assert 4_000 < read[0] < 40_000


def test_nothing_to_learn_from(spark, tmp_path):
    spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.lang_pred, r.score) for r in q01.op1_langid(spark, str(tmp_path)).collect()] == [("und", 0.0)]
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert q01.op1_langid(spark, f"{tmp_path}/e").count() == 0


def test_a_rare_label_does_not_turn_rejection_off(spark):
    rnd = random.Random(2)
    data = [(i, text(rnd, lang, 60), lang) for i, lang in enumerate(list(SOUNDS) * 100)]
    data += [(900 + i, " ".join("".join(rnd.choices(["kyr", "ow", "pzy"], k=2)) for _ in range(60)), "dd") for i in range(6)]
    junk = spark.createDataFrame([(1, "日本語 文字 漢字 " * 30), (2, "$x9 {}; 0xFF || qjq&&~ jvx " * 20)], "doc_id long, text string")
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert "dd" in model.langs and model.reject_z == 8.0
    assert all(r._langid.rejected for r in langid.identify(junk, model).collect())
    assert not any(r._langid.rejected for r in langid.identify(docs, model).collect() if r.lang != "dd")
    few = langid.fit(docs.where("doc_id < 6"))  # too few texts to know what is usual in any language
    assert not any(r._langid.rejected for r in langid.identify(junk, few).collect())
