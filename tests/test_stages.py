"""Structure, relationships, the stages end to end, streaming and statistics."""

import datetime as dt

from pyspark.sql import functions as F

from arrears import cli
from arrears.operators import evalstats as E
from arrears.operators import relate, replay, structure
from arrears.plans import pipeline
from arrears.sources.files import lines, tree
from arrears.streaming import commits as stream

PY = '''from store import save
import os

def load(path):
    # TODO: quick fix
    data = read(path)

    return save(data)

# FIXME: temporary solution
def read(path):
    return path
x = 1
'''
STORE = '''def save(data):
    # HACK: ugly
    if data:
        write(data)
'''
JS = """import { a } from './lib';
function first(x) {
  // TODO: refactor
  if (x) { return second(x); }
}
const second = (y) => {
  // HACK: messy
  return y;
};
"""


def write(root):
    for name, text in (("app.py", PY), ("store.py", STORE), ("web.js", JS), ("node_modules/z.js", "// TODO"), (".hidden/y.py", "# TODO"), ("notes.txt", "TODO")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_structure(spark, tmp_path):
    write(tmp_path)
    files = tree(spark, str(tmp_path))
    assert {r.file for r in files.collect()} == {"app.py", "store.py", "web.js"}
    rows = lines(files.where("ext = '.py'"), "text", "file")
    got = {(r.file, r.name): (r.start, r.end, r.calls) for r in structure.python_functions(rows).collect()}
    assert got == {("app.py", "load"): (4, 10, ["read", "save"]), ("app.py", "read"): (11, 12, []), ("store.py", "save"): (1, 5, ["write"])}
    js = {r.name: (r.start, r.end, r.calls) for r in structure.js_functions(files.where("ext = '.js'")).collect()}
    assert js == {"first": (2, 5, ["second"]), "second": (6, 9, [])}
    assert [r.module for r in structure.js_imports(files.where("ext = '.js'")).collect()] == ["./lib"]
    assert {(r.module, tuple(r.names or ())) for r in structure.python_imports(rows).collect()} == {("store", ("save",)), ("os", ())}
    assert structure.python_controls(rows).count() == 0
    assert [(r.kind, r.start, r.end) for r in structure.python_controls(rows, strict=False).collect()] == [("if", 3, 4)]
    assert {(r.line, r.is_multi_line) for r in structure.comments(files.where("file = 'web.js'")).collect()} == {(3, False), (7, False)}


def test_relationships_and_commands(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    write(src)
    files = tree(spark, str(src))
    items = pipeline.numbered(pipeline.detect(pipeline.candidates(files)))
    at = {r.node: (r.file, r.line) for r in items.collect()}
    assert sorted(at.values()) == [("app.py", 5), ("app.py", 10), ("store.py", 2), ("web.js", 3), ("web.js", 7)]
    edges = {(at[r.src], at[r.dst], r.type): r.weight for r in relate.discover(files, items.select("node", "file", "line")).collect()}
    assert edges[("app.py", 5), ("app.py", 10), "call"] == 0.75 and edges[("app.py", 5), ("store.py", 2), "call"] == 1.0
    assert edges[("web.js", 3), ("web.js", 7), "call"] == 0.75 and edges[("app.py", 10), ("store.py", 2), "module"] == 0.75
    assert cli.main(["analyze", "-r", str(src), "-o", str(out), "--quick"], spark) == 0
    top = spark.read.parquet(f"{out}/items").orderBy(F.desc("sir")).first()
    assert (top.file, top.line, top.sir) == ("app.py", 5, 1.0)
    assert spark.read.parquet(f"{out}/chains").count() == 2
    assert cli.main(["export", "-i", str(out), "-o", str(tmp_path / "csv"), "-f", "csv"], spark) == 0
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 5


def test_statistics(spark):
    df = spark.createDataFrame([("a", "a")] * 163 + [("b", "b")] * 206 + [("a", "b")] * 11 + [("b", "a")] * 20, "x string, y string")
    assert round(E.cohen_kappa(df, "x", "y").first().kappa, 4) == 0.8433
    ci = E.bootstrap_kappa(df, "x", "y", resamples=500).first()
    assert 0.75 < ci.lower < 0.8433 < ci.upper < 0.92
    r = spark.range(1).select(*E.prf(F.lit(85), F.lit(10), F.lit(15))).first()
    assert [round(x, 4) for x in r] == [0.8947, 0.85, 0.8718]
    ci = E.bootstrap_rate(spark, 0.48, 6411).first()
    assert 0.46 <= ci.lower <= 0.49 and 0.47 <= ci.upper <= 0.51
    assert E.fisher_one_sided(168, 0.107, 168, 0.048) < 0.05 and E.fisher_one_sided(200, 0.05, 200, 0.05) > 0.4
    assert round(E.fisher_one_sided(3, 1 / 3, 3, 0), 3) == 0.5


def test_addressed(spark):
    inst = spark.createDataFrame([("a", "f", "# TODO: one thing"), ("b", "f", "# HACK: other"), ("c", "g", "# FIXME")], "id string, file string, content string")
    before = spark.createDataFrame([("h", "f", "# TODO: one thing"), ("h", "f", "# HACK: other"), ("h", "g", "# FIXME")], "hash string, file string, text string")
    after = spark.createDataFrame([("h", "f", "# TODO: one thinG"), ("h", "f", "zzzzzzz"), ("h", "g", "# FIXME")], "hash string, file string, text string")
    assert {(r.id, r.reason) for r in replay.addressed(inst, before, after).collect()} == {("b", "removed")} or {r.id for r in replay.addressed(inst, before, after).collect()} == {"b"}


def test_count_window_equals_batch(spark, tmp_path):
    rows = [(f"r{i % 2}", f"h{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), ["f"]) for i in range(40)]
    ddl = "repo string, hash string, ts timestamp, files array<string>"
    for k in range(4):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    stream.run_available(stream.count_window(src, size=5), lambda df, n: got.extend(df.collect()), str(tmp_path / "ck"))
    assert len(got) == 40 and {r["index"] for r in got} == set(range(1, 21))
    assert all(r.in_window == min(5, r["index"]) for r in got)


def test_a_stream_of_halves_is_written_by_many_tasks(spark):
    from arrears.operators.components import Scratch
    from arrears.plans import stage_queries

    rows = spark.range(0, 400, numPartitions=4).selectExpr("id", "cast(id as double) as n").repartition(4)
    scratch = Scratch(spark)
    stream, seen = stage_queries._stream(spark, rows, rows.drop("n").schema, scratch), []
    query = stream.writeStream.foreachBatch(lambda df, n: seen.append((df.select(F.input_file_name()).distinct().count(), sorted(r.id for r in df.collect())))).option("checkpointLocation", scratch.path("state")).trigger(availableNow=True).start()
    query.awaitTermination()
    batches = [ids for _, ids in seen]
    assert len(batches) == 2 and sum(batches, []) == list(range(400))
    assert abs(len(batches[0]) - 200) <= 8 and all(files > 1 for files, _ in seen)


def test_a_row_gets_one_verdict(spark):
    """The verdict is made once, before the filter and the columns that read it."""
    from arrears.functions import judge

    df = spark.createDataFrame([("a.py", ".py", "# TODO: an ugly workaround")], "file string, ext string, text string")
    got = pipeline.detect(pipeline.candidates(df, ["TODO"], context=0), quick=False, scorer=judge.local)
    assert [(r.is_actual, round(r.confidence, 6)) for r in got.collect()] == [(True, 0.85)]
    assert "Generate explode(array(" in got._jdf.queryExecution().optimizedPlan().toString()
