"""Text functions (§2.3, §2.4): patterns, comment tests, classes, ids, similarity, parsers. All stay within the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from arrears.functions import patterns as P

# An ASCII word boundary; Java's \b knows other letters too.
BOUND = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def escape(literal: str) -> str:
    """F1."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", literal)


def starts(patterns: Iterable[str], *, literal: bool = True) -> str:
    """A lookahead for the first characters of the patterns, so that most places fail at once; empty where they are not all certain."""
    patterns = list(patterns)
    if not patterns or not all(re.match(r"[A-Za-z0-9_@]" + ("" if literal else r"(?![?*{])[^|]*$"), p) for p in patterns):
        return ""
    return f"(?=[{''.join(sorted({p[0] for p in patterns}))}])"


def alternation(patterns: Iterable[str], *, literal: bool = True, ignore_case: bool = True) -> str:
    """one of the patterns between ASCII word boundaries."""
    patterns = list(patterns)
    body = "|".join(escape(p) if literal else p for p in patterns)
    return f"{'(?i)' if ignore_case else ''}{starts(patterns, literal=literal)}{BOUND}({body}){BOUND}"


def first_match(text: Column, patterns: Iterable[str], **kw) -> Column:
    """what matched first, or null."""
    return F.nullif(F.regexp_extract(text, alternation(patterns, **kw), 1), F.lit(""))


def first_by_ordinal(text: Column, patterns: list[str], **kw) -> Column:
    """the place (from 1) of the first pattern in list order that matches, or null."""
    out = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(patterns, 1))):
        out = F.when(text.rlike(alternation([p], **kw)), i).otherwise(out)
    return out


def extension(path: Column) -> Column:
    """F3."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language(path: Column, languages: Mapping[str, list[str]] = P.LANGUAGES) -> Column:
    """The language of a file's extension, or the generic one."""
    ext, out = F.ltrim(extension(path), F.lit(".")), F.lit(P.GENERIC)
    for name, extensions in languages.items():
        out = F.when(ext.isin(extensions), name).otherwise(out)
    return out


def at_level(level: str, explicit: list[str] = P.EXPLICIT) -> list[str]:
    """Explicit patterns of a detection level."""
    if level not in P.LEVELS:
        raise ValueError(f"unknown level {level!r}; known: {', '.join(P.LEVELS)}")
    return [p for p in explicit if p in P.CORE] if level == P.LEVELS[0] else list(explicit)


def scanned(level: str, *, implicit: bool = True, custom: Iterable[str] = ()) -> list[str]:
    """What a scan looks for: implicit patterns by the flag alone, custom ones always."""
    return [*at_level(level), *(P.IMPLICIT if implicit else []), *custom]


def listed(level: str, *, implicit: bool = True, custom: Iterable[str] = ()) -> list[str]:
    """P5: what a listing shows: implicit patterns at the highest level only, custom ones always."""
    return [*at_level(level), *(P.IMPLICIT if implicit and level == P.LEVELS[-1] else []), *custom]


def is_comment(text: Column, ext: Column) -> Column:
    """by extension, a marker anywhere or at the start of the stripped line."""
    line = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))

    def test(anywhere: Iterable[str], start: Iterable[str]) -> Column:
        out = F.lit(False)
        for m in anywhere:
            out = out | line.contains(m)
        for m in start:
            out = out | line.startswith(m)
        return out

    out = test(*P.COMMENT_DEFAULT)
    for marks in {v for v in P.COMMENT.values()}:
        out = F.when(ext.isin([e for e, m in P.COMMENT.items() if m == marks]), test(*marks)).otherwise(out)
    return out


def is_replay_comment(text: Column, ext: Column) -> Column:
    """a marker anywhere, by extension; no comments in other files."""
    out = F.lit(False)
    for marks in {v for v in P.REPLAY_COMMENT.values()}:
        hit = F.lit(False)
        for m in marks:
            hit = hit | text.contains(m)
        out = F.when(ext.isin([e for e, m in P.REPLAY_COMMENT.items() if m == marks]), hit).otherwise(out)
    return out


def contains_any(text: Column, words: Iterable[str]) -> Column:
    words = [w.lower() for w in words]
    return text.rlike(starts(words) + f"(?:{'|'.join(map(escape, words))})")


def classify(text: Column, classes: Mapping[str, list[str]] = P.CLASSES, default: str = P.DEFAULT_CLASS) -> Column:
    """The first class, in order, one of whose words the lower-cased text contains."""
    low, out = F.lower(text), F.lit(default)
    for name, words in reversed(list(classes.items())):
        out = F.when(contains_any(low, words), name).otherwise(out)
    return out


def matched(text: Column, patterns: list[str], *, literal: bool = False) -> Column:
    """all patterns that occur, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(alternation([p], literal=literal)), F.lit(p)) for p in patterns]))


def explicit(text: Column, patterns: list[str] = P.EXPLICIT_RE) -> Column:
    return text.rlike(alternation(patterns, literal=False))


def heuristic_confidence(explicit_n: Column, implicit_n: Column) -> Column:
    """F12, without noise."""
    step = lambda base, n: F.lit(base) + 0.05 * F.least(n, F.lit(4))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.15), F.when(explicit_n > 0, step(0.8, explicit_n)).when(implicit_n > 0, step(0.6, implicit_n)).otherwise(0.2)))


def lexical_confidence(n: Column) -> Column:
    """F13."""
    return F.least(F.lit(1.0), 0.5 + 0.1 * n)


def line_id(file: Column, line: Column, commit: Column) -> Column:
    """F15."""
    return F.concat_ws("-", file, line.cast("string"), F.substring(commit, 1, 7))


def content_id(file: Column, line: Column, content: Column) -> Column:
    """F16."""
    return F.concat(F.lit("satd-"), F.substring(F.md5(F.concat_ws(":", file, line.cast("string"), content)), 1, 12))


def base_name(path: Column) -> Column:
    """what follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    """what precedes the last slash; empty if there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def days_between(later: Column, earlier: Column) -> Column:
    """with fractions."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000


def normal_path(path: Column) -> Column:
    """slashes forward; leading dots and slashes go, as characters."""
    return F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("./"))


def similarity(a: Column, b: Column, cut: int = 500) -> Column:
    """1 - Levenshtein distance / the longer length; 1 if equal, 0 if one is empty."""
    x, y = F.substring(a, 1, cut), F.substring(b, 1, cut)
    return F.when(x == y, 1.0).when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def diff_summary(diff: Column, budget: int = 4000) -> Column:
    """short diffs as they are; else changed lines until the budget, then a mark."""
    lines = F.filter(F.split(diff, "\n", -1), lambda x: (x.startswith("+") | x.startswith("-")) & ~x.startswith("+++") & ~x.startswith("---"))
    kept = F.aggregate(
        lines, F.lit(""), lambda acc, x: F.when(F.length(acc) + F.length(x) + 1 <= budget, F.concat(acc, x, F.lit("\n"))).otherwise(acc)
    )
    return F.when(F.length(diff) <= budget, diff).otherwise(F.concat(kept, F.lit("... (truncated)")))


def parse_classification(text: Column) -> Column:
    """is_satd, confidence between 0 and 1."""
    label, raw = F.regexp_extract(text, r"(?i)CLASSIFICATION:\s*(TRUE|FALSE)", 1), F.regexp_extract(text, r"(?i)CONFIDENCE:\s*(\d{1,9})", 1)
    share = F.coalesce(F.try_to_number(F.nullif(raw, F.lit("")), F.lit("999999999")).cast("double"), F.lit(0.0))
    return F.struct((F.upper(label) == "TRUE").alias("is_satd"), (F.least(F.lit(100.0), F.greatest(F.lit(0.0), share)) / 100).alias("confidence"))


def parse_fix_potential(text: Column) -> Column:
    """level and value; LOW if there is none."""
    level = F.coalesce(F.nullif(F.upper(F.regexp_extract(text, r"(?i)ASSESSMENT:\s*(HIGH|PARTIAL|LOW)", 1)), F.lit("")), F.lit("LOW"))
    return F.struct(level.alias("level"), F.when(level == "HIGH", 1.0).when(level == "PARTIAL", 0.5).otherwise(0.0).alias("value"))


def parse_plan(text: Column) -> Column:
    """sections of a remediation plan, with defaults."""

    def section(name: str, stop: str, default: list[str]) -> Column:
        raw = F.regexp_extract(text, rf"(?is){name}:\s*(.+?)(?={stop}:|\z)", 1)
        items = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(\d+\.\s*|-\s*)", ""))), lambda x: x != "")
        return F.when(F.size(items) > 0, items).otherwise(F.array(*[F.lit(d) for d in default]))

    why = F.regexp_extract(text, r"(?is)WHY_NOW:\s*(.+?)\s*(?=STEPS:|\z)", 1)
    return F.struct(
        F.coalesce(F.nullif(why, F.lit("")), F.lit("Recent changes provide an opportunity to address this debt.")).alias("why_now"),
        section("STEPS", "BENEFITS", ["Review context", "Implement fix", "Test changes"]).alias("steps"),
        section("BENEFITS", "RISKS", ["Improved code quality"]).alias("benefits"),
        section("RISKS", "PRIORITY", ["Potential regression if not tested"]).alias("risks"),
        F.coalesce(F.nullif(F.upper(F.regexp_extract(text, r"(?i)PRIORITY:\s*(HIGH|MEDIUM|LOW)", 1)), F.lit("")), F.lit("MEDIUM")).alias("priority"),
    )


def indent(line: Column) -> Column:
    """F30."""
    return F.length(line) - F.length(F.ltrim(line, F.lit(" \t")))


def agreement_name(kappa: Column) -> Column:
    """F32."""
    out = F.lit("Almost Perfect")
    for bound, name in ((0.8, "Substantial"), (0.6, "Moderate"), (0.4, "Fair"), (0.2, "Slight"), (0.0, "Poor")):
        out = F.when(kappa < bound, name).otherwise(out)
    return out


def truth(text: Column) -> Column:
    """F35."""
    return F.lower(text) == "true"


def hops_of(distance: Column, step: int = 10) -> Column:
    """lines apart, in hops of ten."""
    return F.ceil(F.abs(distance) / step).cast("int")


def hunt_prompt(content: Column, context: Column) -> Column:
    """the classification prompt."""
    return F.concat(
        F.lit("Decide whether this comment admits technical debt.\nComment: "), content, F.lit("\nContext:\n"), F.coalesce(context, F.lit("")),
        F.lit("\nAnswer with CLASSIFICATION: TRUE or FALSE and CONFIDENCE: 0 to 100."),
    )
