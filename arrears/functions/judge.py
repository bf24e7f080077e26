"""The model surface (§2.17): a scorer is any function from text columns to columns. The local ones are deterministic and stay
in the JVM; a remote one is wrapped as an Arrow UDF with retries, batches and errors as data."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from arrears.functions import patterns as P
from arrears.functions import text as X


def local(content: Column, context: Column | None = None) -> Column:
    """L1: is_satd, confidence from explicit markers and phrases, which are counted once."""
    counts = F.struct(F.size(X.matched(content, P.EXPLICIT_RE)).alias("e"), F.size(X.matched(content, P.IMPLICIT_RE)).alias("i"))
    verdict = lambda n: F.struct(((n["e"] + n["i"]) > 0).alias("is_satd"), X.heuristic_confidence(n["e"], n["i"]).alias("confidence"))
    return F.get(F.transform(F.array(counts), verdict), F.lit(0))


def local_fix(same_file: Column, same_chain: Column) -> Column:
    """L2: HIGH if the commit touches the item's file, PARTIAL if its chain's, else LOW."""
    return F.when(same_file, 1.0).when(same_chain, 0.5).otherwise(0.0)


def local_plan(debt_type: Column, file: Column) -> Column:
    """L3."""
    return F.format_string("Address the %s debt in %s while its file is open.", F.lower(debt_type), file)


def error_kind(e: Exception) -> str:
    """L8."""
    status = getattr(e, "status", None)
    return {401: "auth", 403: "auth", 429: "rate_limit"}.get(status, "network" if isinstance(e, OSError) else "other")


def with_retries(call: Callable[[str], str], text: str, *, tries: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """Exponential pauses after rate limits; the answer, or the kind of error."""
    for n in range(tries):
        try:
            return call(text), None
        except Exception as e:  # noqa: BLE001  errors are data here
            kind = error_kind(e)
            if kind != "rate_limit" or n == tries - 1:
                return None, kind
            sleep(pause * 2**n)
    return None, "other"


def remote(call: Callable[[str], str], **kw) -> Callable[[Column], Column]:
    """Answers of a remote model, one Arrow batch at a time; partitions bound how many run at once."""

    @F.pandas_udf("answer string, error string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            yield pd.DataFrame([with_retries(call, p, **kw) for p in prompts], columns=["answer", "error"], dtype=object)

    return ask


REGISTRY: dict[str, Callable] = {"local": local}


def scorer(name: str | None = None, config: dict | None = None, environment: dict | None = None) -> Callable:
    """By name, else configuration, else environment, else local."""
    name = name or (config or {}).get("provider") or (environment or {}).get("DEBT_SCORER") or "local"
    if name not in REGISTRY:
        raise ValueError(f"unknown scorer {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]
