import random
import re
from collections import Counter

import pytest

from arrears.llm import decontam


def grams(words, width):
    return Counter(" ".join(words[i : i + width]) for i in range(len(words) - width + 1))


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            iw = words(it)
            width = min(5, len(iw))
            if not iw:
                continue
            own = grams(iw, width)
            for s in range(len(w)):
                win = grams(w[s : s + len(iw)], width)
                if win and (sim := sum((win & own).values()) / sum((win | own).values())) >= 0.8 and sim > out.get((d, i), (0, 0))[1] + 1e-12:
                    out[d, i] = (s, sim)
    return {k: round(v, 9) for k, (_, v) in out.items()}  # windows not laid on a shared shingle can tie, so starts may differ


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(4)
    vocab = ["w%d" % i for i in range(300)] + ["É1", "ß"]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(text(n))) for k, n in enumerate((1, 3, 5, 9, 20, 40, 60, 150))] + [(50, None), (51, " ... "), (52, " ".join(["same"] * 30))]
    items.append((53, items[5][1]))
    docs = [(None, items[4][1]), (0, None), (1, ""), (2, " ".join(["same"] * 400)), (3, " ".join(text(3000)))]
    for k, (_, t) in enumerate(items):
        if t and len(words(t)) > 1:
            w = t.split()
            docs.append((100 + k, " ".join(text(50) + w + text(30)).upper().replace(" ", " \n- ")))
            w[len(w) // 2] = "changed"
            docs.append((200 + k, " ".join(text(10) + w)))
            docs.append((300 + k, " ".join(t.split()[:-1])))
            docs.append((400 + k, " ".join(text(5) + t.split()[: len(w) // 2] + text(4) + t.split()[len(w) // 2 :])))
    docs += [docs[-1], docs[-1]]
    return docs, items


def test_matches_brute_force(spark, data):
    docs, items = data
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, gram string, start int")
    i = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, w string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.matches(d, i).collect()}
    assert got == brute(docs, items)
    left = decontam.decontaminate(d, i)
    assert left.columns == d.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((k for k, _ in docs if k not in {x for x, _ in got}), key=str)


def test_nothing_to_do(spark):
    d, i = (spark.createDataFrame([], f"{k} long, text string") for k in ("doc_id", "item_id"))
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontam.matches(d, i).count() == 0
    assert decontam.decontaminate(one, i).count() == 1


def test_windows_off_every_diagonal(spark):
    """Halves and sentences of an item in another order, also at a text's end and with words changed."""
    rnd = random.Random(14)
    text = lambda n: ["w%d" % rnd.randrange(10**6) for _ in range(n)]
    item = text(60)
    swapped = item[30:] + item[:30]
    changed = [w if k != 3 else "changed" for k, w in enumerate(swapped)]
    turned = item[40:] + item[20:40] + item[:20]
    docs = [(k, " ".join(w)) for k, w in enumerate((text(25) + swapped + text(40), text(25) + changed, turned + text(9), swapped[:54], text(70) + item[:40]))]
    items = [(1, " ".join(item)), (2, " ".join(text(60)))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.matches(d, i).collect()} == want and (0, 1) in want and (1, 1) in want
