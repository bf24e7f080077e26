"""Relationship discovery (IRD): typed, weighted edges between debt items from the structure of their files.

Items are (node, file, line); files (file, text). Every pairing has an equality key; items in one function or module pair
up as the reference has it, which is the result and not an intermediate product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.functions import patterns as P
from arrears.functions.text import hops_of
from arrears.operators import graph, joins, structure
from arrears.sources.files import lines


def edge(df: DataFrame, kind: str, weight, hops) -> DataFrame:
    return df.where("src <> dst").select("src", "dst", F.lit(kind).alias("type"), weight.cast("double").alias("weight"), hops.cast("int").alias("hops"))


def holders(items: DataFrame, functions: DataFrame) -> DataFrame:
    """Items with the function that holds them, up to two lines above its start."""
    return joins.contains(items, functions, "file", "line", "start", "end", slack=2).select("node", "file", "name", "calls")


def call_edges(items: DataFrame, functions: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Caller to callee within a file (static default weight), and across files by `from module import name` (the maximum)."""
    lo, hi, base = P.EDGE_RANGES["call"]
    held = holders(items, functions)
    calls = held.select(F.col("node").alias("src"), "file", F.explode("calls").alias("name"))
    inside = calls.join(held.select(F.col("node").alias("dst"), "file", "name"), ["file", "name"])
    out = edge(inside, "call", F.lit(base), F.lit(1))
    if imports is not None:
        known = functions.select(F.col("file").alias("target")).distinct()
        found = joins.first_existing(structure.module_candidates(imports.where("names is not null")), known, ["file", "module", "names"], "target", "ordinal")
        named = found.select("file", "target", F.explode("names").alias("name"))
        across = calls.join(named, ["file", "name"]).join(held.select(F.col("node").alias("dst"), F.col("file").alias("target"), "name"), ["target", "name"])
        out = out.union(edge(across, "call", F.lit(hi), F.lit(1)))
    return out.distinct()


def data_edges(items: DataFrame, definitions: DataFrame, uses: DataFrame, k: int = P.MAX_HOPS) -> DataFrame:
    """Definitions and later uses of a name, each near an item (the first within five lines), at most k hops apart."""
    near = lambda df, tag: joins.first_within(
        df.withColumn("_id", F.xxhash64("file", "line", "var")), items.select(F.col("file").alias("file"), F.col("line").alias("at"), "node"), "file", "_id", "line", "at", "node", 5
    ).select("file", "var", F.col("line").alias(f"{tag}_line"), F.col("node").alias(tag))
    pairs = joins.later_uses(near(definitions, "src"), near(uses, "dst"), ["file", "var"], "src_line", "dst_line", 10 * k)
    pairs = pairs.withColumn("far", F.col("dst_line") - F.col("src_line")).withColumn("hops", hops_of(F.col("far"))).where(F.col("hops") <= k)
    return edge(pairs, "data", graph.edge_weight(F.lit("data"), F.col("far"), F.col("hops"), F.lit(0)), F.col("hops")).distinct()


def script_data_edges(items: DataFrame, names: DataFrame, k: int = P.MAX_HOPS) -> DataFrame:
    """Of each name in a script the last place near an item that sets it, to every other use near an item, before or after, at most k hops away."""
    spots = items.select("file", F.col("line").alias("item_line"), "node")
    near = joins.first_within(names.withColumn("_id", F.xxhash64("file", "at")), spots, "file", "_id", "line", "item_line", "node", 5)
    near = near.select("file", "var", "line", "at", "target", "node")
    last = joins.last_definition(near.where("target").select("file", "var", "line", "at", "node"), ["file", "var"], "at")
    last = last.select("file", "var", F.col("line").alias("def_line"), F.col("node").alias("src"))
    uses = near.where("not target").select("file", "var", "line", F.col("node").alias("dst")).distinct()
    pairs = uses.join(last, ["file", "var"]).withColumn("far", F.abs(F.col("line") - F.col("def_line"))).withColumn("hops", hops_of(F.col("far"))).where(F.col("hops") <= k)
    return edge(pairs, "data", graph.edge_weight(F.lit("data"), F.col("far"), F.col("hops"), F.lit(0)), F.col("hops")).distinct()


def control_edges(items: DataFrame, controls: DataFrame, k: int = P.MAX_HOPS) -> DataFrame:
    """An item at a control node's head (three lines) to the items within its span."""
    heads = joins.first_within(controls.withColumn("_id", F.xxhash64("file", "start", "kind")), items.select("file", F.col("line").alias("at"), "node"), "file", "_id", "start", "at", "node", 3)
    heads = heads.select("file", F.col("node").alias("src"), "start", "end", "depth", F.col("at").alias("head"))
    inside = joins.contains(items.select(F.col("node").alias("dst"), "file", "line"), heads, "file", "line", "start", "end")
    inside = inside.withColumn("hops", F.greatest(hops_of(F.col("line") - F.col("head")), F.lit(1))).where(F.col("hops") <= k)
    return edge(inside, "control", graph.edge_weight(F.lit("control"), F.lit(0), F.col("hops"), F.col("depth")), F.col("hops")).distinct()


def module_edges(items: DataFrame, dependencies: DataFrame, k: int = P.MAX_HOPS) -> DataFrame:
    """Items of a file to those of the files it reaches within k imports. dependencies: src, dst files."""
    reach = graph.bounded_reach(dependencies, k).select(F.col("src").alias("file"), F.col("dst").alias("other"), "hops")
    pairs = items.select(F.col("node").alias("src"), "file").join(reach, "file").join(items.select(F.col("node").alias("dst"), F.col("file").alias("other")), "other")
    return edge(pairs, "module", graph.edge_weight(F.lit("module"), F.lit(0), F.col("hops"), F.lit(0)), F.col("hops"))


def dependencies(imports: DataFrame, files: DataFrame) -> DataFrame:
    """G6."""
    found = joins.first_existing(structure.module_candidates(imports), files.select(F.col("file").alias("target")), ["file", "module"], "target", "ordinal")
    return found.select(F.col("file").alias("src"), F.col("target").alias("dst")).where("src <> dst").distinct()


def script_dependencies(imports: DataFrame, items: DataFrame) -> DataFrame:
    """Scripts and the files with items that they import by a relative path."""
    known = items.select(F.col("file").alias("target")).distinct()
    found = joins.first_existing(structure.js_module_candidates(imports), known, ["file", "module"], "target", "ordinal")
    return found.select(F.col("file").alias("src"), F.col("target").alias("dst")).where("src <> dst").distinct()


def coupling(rows: DataFrame) -> DataFrame:
    """One row of dynamic base weights by type, from counts over all lines."""
    has = lambda p: F.sum(F.col("content").rlike(p).cast("int"))
    n = lambda p: F.sum(F.regexp_count("content", F.lit(p)))
    c = rows.agg(
        has(r"^\s*(import|from)\b").alias("imports"), n(r"[a-zA-Z0-9_]+\s*\(").alias("calls"), has(r"^\s*[a-zA-Z_][a-zA-Z0-9_]*\s*=[^=]").alias("defs"), has(r"^\s*global\b").alias("globals"),
        has(r"\b(if|elif|else|for|while|case|catch|except)\b").alias("branches"), n(r"\b(def|class|function)\s+[a-zA-Z_]").alias("entities"), F.countDistinct("file").alias("files"),
    )
    share = lambda a, b, none: F.when(b > 0, F.least(F.lit(1.0), a / b)).otherwise(none)
    pairs = F.when(F.col("files") > 1, F.col("files") * (F.col("files") - 1)).otherwise(1)
    rho = {
        "call": share(F.col("imports"), F.col("calls"), 0.5), "data": share(F.floor(0.1 * F.col("defs")) + 2 * F.col("globals"), F.col("defs"), 0.5),
        "control": F.least(F.lit(1.0), F.when(F.col("entities") > 0, F.col("branches") / F.col("entities")).otherwise(1.0) / 10), "module": F.least(F.lit(1.0), F.col("imports") / pairs),
    }
    return c.select(*[graph.dynamic_weight(k, v).alias(k) for k, v in rho.items()])


def discover(files: DataFrame, items: DataFrame, *, k: int = P.MAX_HOPS, strict: bool = True) -> DataFrame:
    """All edges between items (node, file, line) of files (file, text); k is held within 1..5 (Q12)."""
    k = min(5, max(1, k))
    python, script = files.where(F.col("file").rlike(r"\.py$")), files.where(F.col("file").rlike(r"\.[jt]sx?$"))
    rows = lines(python, "text", "file")
    imports = structure.python_imports(rows)
    out = call_edges(items, structure.python_functions(rows), imports)
    out = out.union(call_edges(items, structure.js_functions(script)))
    out = out.union(data_edges(items, structure.python_definitions(rows), structure.python_uses(rows), k))
    out = out.union(script_data_edges(items, structure.js_names(script), k))
    out = out.union(control_edges(items, structure.python_controls(rows, strict=strict).union(structure.js_controls(script)), k))
    depends = dependencies(imports, files).union(script_dependencies(structure.js_imports(script), items)).distinct()
    return out.union(module_edges(items, depends, k))
