import re

from arrears.llm import licenses, q04


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for label, p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min(places, default=(None,))[0], max(places, default=(None,))[0], ",".join(sorted({x for _, x in places}))


def test_base_columns_match_brute_force(spark, tmp_path):
    texts = [None, "", "  ", "mit", "under the MIT license", "Under the mit-license. under the mit license", "cc by nc", "CC BY-NC 4.0 and cc by nc nd cc by nc",
             "Licensed under the Apache License, Version 2.0.", "apache license version é 2", "İ under the mit lİcense", "under the mKt license", "x " * 20000 + "cc by nc", "cc by ncé",
             "licensed under the GNU General Public License, version 3.", "cc by"]
    rows = [(i, t, "l", 1, "h") for i, t in enumerate(texts)] + [(4, "under the MIT license", "l", 1, "h"), (None, "cc by nc", "l", 1, "h")]
    spark.createDataFrame(rows, "doc_id long, text string, label string, p int, w string").write.parquet(f"{tmp_path}/documents.parquet")
    got = q04.op4_licenses(spark, str(tmp_path)).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((i, *brute(t)) for i, t, *_ in rows), key=key)
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    assert labels[14] == ("gpl-3", 1.0) and labels[0] == ("", 0.0) and labels[8] == ("apache-2", 1.0)


def test_near_license_text_is_verified_by_its_span(spark):
    text = dict(licenses.TEXTS)["bsd"].split()
    near, far = list(text), list(text)
    near.insert(9, "gladly")  # moves what follows to the next diagonal
    far[::3] = ["word"] * len(far[::3])
    df = spark.createDataFrame([(1, "a b " + " ".join(near)), (2, " ".join(far))], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert got[1].labels == "bsd" and 0.8 <= got[1].score < 1 and got[1].n_base == 0
    assert got[2].labels == ""


def test_no_rows(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
