"""Data and module edges of scripts, and the stages with a table of commits."""

import json

from pyspark.sql import functions as F

from arrears import cli
from arrears.operators import relate, structure

A = """import { b } from '../lib/b';
// TODO: first
let total = 1;
function use() {
  return total + b;
}
const s = 'total = 3'; // total = 4




total += 2;
// HACK: second
const o = { total: x.total };
o.total = 5;
"""
FILES = [("src/a.ts", A), ("lib/b.js", "// FIXME: x\nexport const b = 1;\n"), ("lib/index.ts", "// TODO\nconst c = require('./../src/a');\n"), ("none.js", None)]


def test_names(spark):
    files = spark.createDataFrame(FILES, "file string, text string")
    got = [(r.line, r.target) for r in structure.js_names(files).where("file = 'src/a.ts' and var = 'total'").orderBy("at").collect()]
    assert got == [(3, True), (5, False), (12, True), (14, False), (14, False), (15, False)]
    assert {r["var"] for r in structure.js_names(files).where("target and file <> 'src/a.ts'").collect()} == {"b", "c"}


def test_candidates(spark):
    df = spark.createDataFrame([("a/b/c.ts", "../d"), ("c.ts", "./x/./y.js"), ("c.ts", "../up")], "file string, module string")
    got = {}
    for r in structure.js_module_candidates(df).orderBy("ordinal").collect():
        got.setdefault(r.module, []).append(r.target)
    assert got["../d"] == ["a/d.js", "a/d.jsx", "a/d.ts", "a/d.tsx", "a/d", "a/d/index.js", "a/d/index.jsx", "a/d/index.ts", "a/d/index.tsx"]
    assert got["./x/./y.js"][4] == "x/y.js" and got["../up"][0] == "../up.js"


def test_edges(spark):
    files = spark.createDataFrame(FILES, "file string, text string")
    items = spark.createDataFrame([(1, "src/a.ts", 2), (2, "src/a.ts", 13), (3, "lib/b.js", 1), (4, "lib/index.ts", 1)], "node long, file string, line int")
    got = {(r.src, r.dst, r.type, r.hops) for r in relate.discover(files, items).collect()}
    # the last place that sets `total` near an item is line 12, near the second; the use on line 5 is near the first and comes before
    assert (2, 1, "data", 1) in got and not any(t == "data" and (s, d) == (1, 2) for s, d, t, _ in got)
    assert (1, 3, "module", 1) in got and (4, 1, "module", 1) in got and (4, 3, "module", 2) in got


def test_analyze_with_commits(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    for name, text in FILES[:3]:
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(text)
    log = [
        {"hash": "h1", "author": "x", "ts": "2024-01-01T00:00:00Z", "files": ["src/a.ts", "lib/b.js"]}, {"hash": "h2", "author": "y", "ts": "2025-06-01T00:00:00Z", "files": ["src/a.ts"]},
    ]
    (tmp_path / "log.json").write_text("\n".join(map(json.dumps, log)))
    assert cli.main(["analyze", "-r", str(src), "-o", str(out), "--quick", "-c", str(tmp_path / "log.json")], spark) == 0
    got = {(r.file, r.line): r for r in spark.read.parquet(f"{out}/items").collect()}
    own = got["src/a.ts", 2]
    assert (own.churn, own.age_days, own.contributors) == (2, 517, 2) and own.rel == 0.5 + 0.3 + 0.2 * 0.1
    assert got["lib/index.ts", 1].churn == 0 and got["lib/index.ts", 1].rel > 0  # a neighbour of what the newest commit touches
    ranked = spark.read.parquet(f"{out}/ranking")
    assert {r.hash for r in ranked.select("hash").distinct().collect()} == {"h1", "h2"} and ranked.where("rel <= 0").count() == 0
    assert abs(own.rank_score - (0.4 * own.sir + 0.3 * own.rel + 0.15 * (1 - own.effort))) < 1e-9
    assert ranked.agg(F.count_distinct("node")).first()[0] == 4
