"""Code structure from text (§2.11, S18): spans, calls, definitions, uses, imports, control nodes, comments.

Inputs are files (file, text) or their lines (file, line, content). Python is read by line and indent, as windows over a
file's lines; JavaScript and TypeScript by braces, a token-level reading without a parser: names bound by destructuring
and functions passed inline are not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arrears.functions.text import indent
from arrears.sources.files import lines

DEF = r"^\s*def\s+([a-zA-Z0-9_]+)\s*\("
# Words that are no uses.
KEYWORDS = ["def", "class", "if", "else", "elif", "for", "while", "return", "import", "from", "as", "try", "except", "finally", "with", "True", "False", "None"]
PY_CONTROL = r"^\s*(if|elif|else|for|while|try|except|finally|with)\b"
JS_CONTROL = r"\b(if|for|while|do|switch|try|catch|finally)\b"
JS_NAMED = r"(?:\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*=>|^[ \t]*(?:async\s+|static\s+)*([A-Za-z_$][\w$]*)\s*\([^()]*\)\s*\{)"


def python_functions(rows: DataFrame) -> DataFrame:
    """File, name, start, end, calls. A def opens; the next def, or a line indented no deeper that is no comment, closes it."""
    last = rows.groupBy("file").agg(F.max("line").alias("_last"))
    rows = rows.where(F.trim("content") != "").withColumn("_indent", indent(F.col("content"))).withColumn("_name", F.nullif(F.regexp_extract("content", DEF, 1), F.lit("")))
    own = W.partitionBy("file").orderBy("line")
    rows = rows.withColumn("_def", F.last(F.when(F.col("_name").isNotNull(), F.struct("line", "_indent", "_name")), True).over(own)).where("_def is not null")
    closes = F.col("_name").isNull() & (F.col("_indent") <= F.col("_def._indent")) & ~F.trim("content").startswith("#")
    spans = rows.groupBy("file", F.col("_def.line").alias("start"), F.col("_def._name").alias("name")).agg(F.min(F.when(closes, F.col("line"))).alias("_close"))
    spans = spans.withColumn("_next", F.lead("start").over(W.partitionBy("file").orderBy("start"))).join(last, "file")
    spans = spans.withColumn("end", F.coalesce(F.col("_close") - 1, F.col("_next") - 1, F.col("_last"))).select("file", "name", "start", "end")
    body = rows.where(F.col("_name").isNull()).select("file", F.col("_def.line").alias("start"), "line", F.regexp_extract_all("content", F.lit(r"([a-zA-Z0-9_]+)\s*\("), F.lit(1)).alias("c"))
    calls = spans.join(body, ["file", "start"]).where("line <= end").select("file", "start", "name", F.explode("c").alias("call")).where("call <> name")
    calls = calls.groupBy("file", "start").agg(F.array_sort(F.collect_set("call")).alias("calls"))
    return spans.join(calls, ["file", "start"], "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))


def python_definitions(rows: DataFrame) -> DataFrame:
    """File, line, var of assignments."""
    found = rows.select("file", "line", F.regexp_extract("content", r"^\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*=", 1).alias("var"))
    return found.where("var <> ''")


def python_uses(rows: DataFrame) -> DataFrame:
    """File, line, var of identifiers that are neither the line's target nor keywords."""
    target = F.regexp_extract("content", r"^\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*=", 1)
    names = F.array_except(F.regexp_extract_all("content", F.lit("([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1)), F.array(*[F.lit(k) for k in KEYWORDS]))
    return rows.select("file", "line", F.explode(F.array_distinct(F.array_remove(names, target))).alias("var"))


def python_imports(rows: DataFrame) -> DataFrame:
    """File, line, module, names (null for a plain import)."""
    text = F.trim("content")
    plain, source = F.regexp_extract(text, r"^import\s+([a-zA-Z0-9_.]+)", 1), F.regexp_extract(text, r"^from\s+([a-zA-Z0-9_.]+)\s+import\s+(.+)", 1)
    names = F.transform(F.split(F.regexp_extract(text, r"^from\s+([a-zA-Z0-9_.]+)\s+import\s+(.+)", 2), ","), lambda x: F.trim(x))
    found = rows.select("file", "line", F.when(plain != "", plain).otherwise(source).alias("module"), F.when(source != "", names).alias("names"))
    return found.where("module <> ''")


def module_candidates(imports: DataFrame) -> DataFrame:
    """For each import the paths it may mean, in order: file beside it, package beside it, then from the root."""
    base = F.regexp_extract("file", "^(.*/)[^/]*$", 1)
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    path = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    ups = F.array_join(F.slice(F.split(base, "/"), F.lit(1), F.greatest(F.size(F.split(base, "/")) - dots, F.lit(0))), "/")
    up = F.when(ups == "", "").otherwise(F.concat(ups, F.lit("/")))
    relative = F.array(F.concat(up, path, F.lit(".py")), F.concat(up, path, F.lit("/__init__.py")))
    absolute = F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py")), F.concat(base, path, F.lit(".py")), F.concat(base, path, F.lit("/__init__.py")))
    return imports.select("file", "module", "names", F.posexplode(F.when(dots > 0, relative).otherwise(absolute)).alias("ordinal", "target"))


def python_controls(rows: DataFrame, *, strict: bool = True) -> DataFrame:
    """File, kind, start, end, depth. strict: none, as the reference's structures never hold a line (Q2)."""
    schema = "file string, kind string, start long, end long, depth long"
    if strict:
        return rows.sparkSession.createDataFrame([], schema)

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        out, stack, last = [], [], 0
        for line, text in pdf.sort_values("line")[["line", "content"]].itertuples(index=False):
            if not text.strip():
                continue
            depth = len(text) - len(text.lstrip())
            while stack and depth <= stack[-1][0]:
                out[stack.pop()[1]][3] = last
            if m := re.match(PY_CONTROL, text):
                stack.append((depth, len(out)))
                out.append([pdf["file"].iloc[0], m[1], line, line, len(stack) - 1])
            last = line
        for _, at in stack:
            out[at][3] = last
        return pd.DataFrame(out, columns=["file", "kind", "start", "end", "depth"]).astype({"file": object, "kind": object})

    return rows.select("file", "line", "content").groupBy("file").applyInPandas(read, schema)


def blank_js(text: str) -> str:
    """Strings and comments blanked, lines kept."""
    return re.sub(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def brace_end(text: str, at: int) -> int:
    """The place after the block that opens at or after `at`; the line's end if none opens there."""
    start, stop = text.find("{", at), text.find("\n", at)
    if start < 0 or (0 <= stop < start and text[at:start].strip() not in ("", ")")):
        return stop if stop >= 0 else len(text)
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return i + 1
    return len(text)


def _by_file(files: DataFrame, read, schema: str) -> DataFrame:
    """A function of (file, text) that yields rows, over files of any number; one file is held at a time."""
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, *r) for f, t in zip(pdf["file"], pdf["text"], strict=True) for r in read(t or "")]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: object for c in names if out[c].dtype.kind not in "if"})

    return files.select("file", "text").mapInPandas(each, schema)


def js_functions(files: DataFrame) -> DataFrame:
    """File, name, start, end, calls."""

    def read(text: str):
        code = blank_js(text)
        line = lambda i: code.count("\n", 0, i) + 1
        for m in re.finditer(JS_NAMED, code, re.M):
            name = m[1] or m[2] or m[3]
            if name in ("if", "for", "while", "switch", "catch", "function"):
                continue
            end = brace_end(code, m.end() - (1 if m[3] else 0))
            calls = sorted(set(re.findall(r"([A-Za-z_$][\w$]*)\s*\(", code[m.end() : end])) - {name, "if", "for", "while", "switch", "catch", "function", "return"})
            yield name, line(m.start() + len(m[0]) - len(m[0].lstrip())), line(max(m.end(), end - 1)), calls

    return _by_file(files, read, "file string, name string, start long, end long, calls array<string>")


def js_controls(files: DataFrame) -> DataFrame:
    """File, kind, start, end, depth."""

    def read(text: str):
        code = blank_js(text)
        found = [(m.start(), brace_end(code, m.end()), m[1]) for m in re.finditer(JS_CONTROL, code)]
        for at, end, kind in found:
            depth = sum(a < at < b for a, b, _ in found)
            yield kind, code.count("\n", 0, at) + 1, code.count("\n", 0, max(at, end - 1)) + 1, depth

    return _by_file(files, read, "file string, kind string, start long, end long, depth long")


# Words that are no identifiers.
JS_KEYWORDS = [
    "await", "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally", "for",
    "function", "if", "import", "in", "instanceof", "let", "new", "null", "return", "super", "switch", "this", "throw", "true", "try", "typeof", "var", "void", "while", "with", "yield",
]


def js_names(files: DataFrame) -> DataFrame:
    """File, line, at (place in the text), var, target: identifiers, and whether each is what a declaration or an assignment sets."""

    def read(text: str):
        code, words = blank_js(text), set(JS_KEYWORDS)
        line, seen = 1, 0
        for m in re.finditer(r"(?<![\w$])[A-Za-z_$][\w$]*", code):
            line, seen = line + code.count("\n", seen, m.start()), m.start()
            if m[0] not in words:
                declared = re.search(r"(?<![\w$])(?:const|let|var)\s+$", code[max(0, m.start() - 40) : m.start()])
                assigned = re.match(r"\s*(?:\*\*|<<|>>>?|&&|\|\||\?\?|[-+*/%&|^])?=(?![=>])", code[m.end() : m.end() + 40])
                member = code[m.start() - 1 : m.start()] == "."
                yield line, m.start(), m[0], bool(declared or assigned and not member)

    return _by_file(files, read, "file string, line long, at long, var string, target boolean")


def js_imports(files: DataFrame) -> DataFrame:
    """File, line, module: relative ones only."""
    rows = lines(files, "text", "file")
    found = F.regexp_extract_all("content", F.lit(r"(?:\bfrom\s*|\brequire\s*\(\s*|\bimport\s*\(?\s*)['\"](\.[^'\"]*)['\"]"), F.lit(1))
    return rows.select("file", "line", F.explode(found).alias("module"))


def comments(files: DataFrame) -> DataFrame:
    """File, line, content, is_multi_line: line comments, and blocks with the line they begin on."""

    def read_of(python: bool):
        single, block = (r"#(.*)$", r"\"\"\"(.*?)\"\"\"") if python else (r"//(.*)$", r"/\*(.*?)\*/")

        def read(text: str):
            for n, row in enumerate(text.split("\n"), 1):
                if (m := re.search(single, row)) and m[1].strip():
                    yield n, m[1].strip(), False
            for m in re.finditer(block, text, re.S):
                if m[1].strip():
                    yield text.count("\n", 0, m.start()) + 1, m[1].strip(), True

        return read

    schema = "file string, line long, content string, is_multi_line boolean"
    python = F.col("file").rlike(r"\.pyx?$")
    return _by_file(files.where(python), read_of(True), schema).union(_by_file(files.where(~python), read_of(False), schema))


def js_module_candidates(imports: DataFrame) -> DataFrame:
    """For each relative import the paths it may mean, in order: the path with each extension and as it is, then its index files."""
    base = F.regexp_extract("file", "^(.*/)[^/]*$", 1)
    step = lambda acc, x: (
        F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    )
    path = F.array_join(F.aggregate(F.split(F.concat(base, F.col("module")), "/"), F.array().cast("array<string>"), step), "/")
    script = [".js", ".jsx", ".ts", ".tsx"]
    ways = F.array(*[F.concat(path, F.lit(e)) for e in [*script, "", *[f"/index{e}" for e in script]]])
    return imports.select("file", "module", F.posexplode(ways).alias("ordinal", "target"))
