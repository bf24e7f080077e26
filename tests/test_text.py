from pyspark.sql import functions as F

from arrears.functions import judge
from arrears.functions import patterns as P
from arrears.functions import text as X
from arrears.operators import score


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_word_boundaries_are_ascii(spark):
    t = F.col("t")
    hit = lambda s: one(spark, X.first_match(t, P.ALL), t=s)
    assert hit("// todo: x") == "todo" and hit("TODOs") is None and hit("éTODOé") == "TODO" and hit("# hard-coded here") == "hard-coded"
    assert hit("@SuppressWarnings") is None  # its first sign is no word
    assert one(spark, X.first_by_ordinal(t, ["FIXME", "TODO"]), t="TODO FIXME") == 1


def test_classes(spark):
    got = {s: one(spark, X.classify(F.col("t")), t=s) for s in ("TODO: Refactor this poor design", "HACK: Quick fix for performance", "TODO: Add documentation for this function", "TODO: Need to add unit tests", "BUG: Known issue with null pointer", "TODO: Improve component coupling", "xyz")}
    assert list(got.values()) == ["Design", "Implementation", "Documentation", "Test", "Defect", "Architecture", "Other"]


def test_comment_lines(spark):
    test = lambda s, e: one(spark, X.is_comment(F.col("t"), F.col("e")), t=s, e=e)
    assert test("x = 1 # TODO", ".py") and not test("// TODO", ".py") and test("  * TODO", ".js") and not test("TODO *", ".js") and test("# a", ".php") and not test("* a", ".txt")


def test_ids_paths_and_similarity(spark):
    assert one(spark, X.line_id(F.col("f"), F.col("l"), F.col("c")), f="a.py", l=3, c="0123456789") == "a.py-3-0123456"
    assert one(spark, X.normal_path(F.col("p")), p="./.git\\x") == "git/x"
    assert one(spark, X.extension(F.col("p")), p="a/b.c/D.PY") == ".py"
    assert one(spark, X.similarity(F.col("a"), F.col("b")), a="kitten", b="sitting") == 1 - 3 / 7
    assert one(spark, X.similarity(F.col("a"), F.col("b")), a="", b="x") == 0.0


def test_parsers(spark):
    r = one(spark, X.parse_classification(F.col("t")), t="CLASSIFICATION: TRUE\nCONFIDENCE: 90")
    assert (r.is_satd, r.confidence) == (True, 0.9)
    assert one(spark, X.parse_classification(F.col("t")), t="classification: false confidence: 250").confidence == 1.0
    assert one(spark, X.parse_classification(F.col("t")), t="nothing").confidence == 0.0
    assert one(spark, X.parse_fix_potential(F.col("t")), t="ASSESSMENT: partial\nJUSTIFICATION: x").value == 0.5
    p = one(spark, X.parse_plan(F.col("t")), t="WHY_NOW: now\nSTEPS:\n1. a\n- b\nBENEFITS:\n- c\nRISKS:\n- d\nPRIORITY: HIGH")
    assert (p.why_now, p.steps, p.benefits, p.risks, p.priority) == ("now", ["a", "b"], ["c"], ["d"], "HIGH")
    assert one(spark, X.parse_plan(F.col("t")), t="?").steps == ["Review context", "Implement fix", "Test changes"]


def test_diff_summary(spark):
    diff = "--- a\n+++ b\n" + "".join(f"+line {i}\n unchanged {i}\n" for i in range(50))
    short = one(spark, X.diff_summary(F.col("d"), 100), d=diff)
    assert short.startswith("+line 0\n+line 1\n") and "unchanged" not in short and short.endswith("(truncated)") and len(short) < 120
    assert one(spark, X.diff_summary(F.col("d"), 100), d="+x") == "+x"


def test_scores(spark):
    rank = lambda a, b, c, d: round(one(spark, score.rank_score(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=a, b=b, c=c, d=d), 9)
    assert (rank(0.0, 1.0, 0.3, 1.0), rank(0.0, 0.0, 0.6, 0.0), rank(0.8, 0.6, 0.3, 0.5)) == (0.555, 0.06, 0.68)
    assert one(spark, score.interest(F.col("m"), F.col("t")), m=5, t=200) == 0.25


def test_judge(spark):
    class Busy(Exception):
        status = 429

    pauses, calls = [], []

    def call(text):
        calls.append(text)
        if len(calls) < 3:
            raise Busy
        return "ok"

    assert judge.with_retries(call, "x", sleep=pauses.append) == ("ok", None) and pauses == [1.0, 2.0]
    assert judge.with_retries(lambda _: 1 / 0, "x") == (None, "other")
    v = one(spark, judge.local(F.col("t")), t="TODO: quick fix")
    assert v.is_satd and v.confidence > 0.8 and judge.scorer() is judge.local


def test_best_similarity_compares_distinct_texts(spark):
    from arrears.operators import joins

    rows = [("g", 1, "abc"), ("g", 2, "abc"), ("g", 3, "abd"), ("g", 4, ""), ("m", 5, None), ("m", 15, "z"), ("h", 6, "x"), ("h", 6, "y"), ("i", 7, "kit"), ("i", 8, "kat"), ("i", 7, "kat"), (None, 9, "a"), (None, 10, "a"), ("j", 11, None), ("j", 12, None)]
    df = spark.createDataFrame(rows, "g string, id long, t string")
    a, b = df.select("g", "id", "t"), df.select(F.col("g").alias("h"), F.col("id").alias("k"), F.col("t").alias("o"))
    want = a.join(b, (F.col("g") == F.col("h")) & (F.col("id") != F.col("k"))).groupBy("id").agg(F.max(X.similarity(F.col("t"), F.col("o"))).alias("best"))
    assert {tuple(r) for r in joins.best_similarity(df, ["g"], "id", "t").collect()} == {tuple(r) for r in want.collect()}


def test_patterns_fail_at_once_where_none_starts(spark):
    assert X.alternation(["TODO", "@x"]).startswith("(?i)(?=[@T])") and X.starts(["a?b"], literal=False) == X.starts(["a|b"], literal=False) == X.starts([".x"]) == X.starts([""]) == ""
    for text, want in {"a todo": True, "todos": False, "@x": False, "a@x": True, "": False}.items():
        assert one(spark, F.col("t").rlike(X.alternation(["TODO", "@x"])), t=text) == want
    assert one(spark, F.col("t").rlike(X.alternation(["x?y"], literal=False)), t="y") and one(spark, X.contains_any(F.col("t"), ["Not Working", "zz"]), t="is not working")
