import hashlib
from collections import defaultdict

from arrears.llm import linededup, q06
from arrears.llm._common import Scratch

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows):
    seen = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                seen[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(seen.get(key(x), ())) >= 3 and (i is None or i != max(d for d in seen[key(x)] if d is not None)))]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark, tmp_path):
    shared, other, short = "A line that many Documents share", "Ünïcode line SHARED by some of us", "short line"
    rows = [(i, f"{shared}\n own {i} line that is long enough\n{short}\n\t{other.swapcase() if i % 2 else other} \r") for i in range(8)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, shared), (24, shared), (25, f"{shared}\n{shared.upper()}\nx"), (25, f"{shared}\n{shared.upper()}\nx")]
    rows += [(25, f"y\n{shared}"), (None, f"{shared}\nz"), (26, "\n".join(["filler line number %d with text" % (k % 50) for k in range(4000)] + [other])), (27, " " + "a" * 19), (28, " " + "a" * 19), (29, " " + "A" * 19)]
    spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, _gone string").drop("_gone").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, q06.op6_linededup(spark, str(tmp_path)).collect()), key=str) == brute(rows)


def test_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, pos int, key string, doc long, line string, print string")
    assert linededup.drop_lines(df).columns[:7] == df.columns and linededup.drop_lines(df).count() == 0


def test_levels_merge_and_known_keys_are_counted(spark):
    runs = linededup.LineRuns(Scratch(spark), 2)
    for k in range(5):
        batch = spark.createDataFrame([(bytes([j]), 10 * k + j) for j in range(k + 1)], "key binary, doc long")
        assert {r.key[0] for r in runs.add(batch).where("not known").collect()} == {k}
    assert sorted(runs.levels) == [0, 2]
    assert sum(run.count() for run in runs.levels.values()) == 5
    assert {(r.key[0], r.docs, r.last) for r in runs.common(3).collect()} == {(j, 5 - j, 40 + j) for j in range(3)}
    runs.close()
    assert not runs.scratch.tables and not runs.levels


def test_clashing_columns_and_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(linededup, "MIN_SHARE", 3)
    names = ["_gone", "_doc", "_print", "_lines", "gone", "doc", "print", "lines", "row", "key", "pos", "last", "_KEPT"]
    hot, other = "a line that is in every document", "a line that is in three of them"
    rows = [(i, f"{hot}\n{hot}\nown {i} of no other document\n" + (other if i < 3 else ""), *names) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = linededup.drop_lines(df)
    assert out.columns == ["doc_id", "text", *names[:-1], "_kept", "_n_lines", "_n_dropped"]
    got = out.collect()
    assert all([r[c] for c in names[:-1]] == names[:-1] for r in got)
    want = {i: (n, dropped, sha) for i, n, dropped, sha in brute([r[:2] for r in rows])}
    assert {r.doc_id: (r._n_lines, r._n_dropped, hashlib.sha256(r._kept.encode()).hexdigest()) for r in got} == want
