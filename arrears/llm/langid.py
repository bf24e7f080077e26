"""Operator 1, language identification: interpolated Kneser-Ney character models in sorted hash arrays.

One model per language over lower-cased letters, runs of anything else being one blank. All languages share the hash
arrays: an entry holds the fully interpolated log probability of its n-gram in every language, so that a character costs
one search unless its n-gram is new, which then backs off by the stored weight of its context. The language with the
lowest cross-entropy a character wins; a text is rejected if its cross-entropy lies further above what that language's
texts have than `reject_z` deviations, with the spread a text of its length has.

Training reads a bounded sample: `chars_per_language` characters in expectation (default 1,500,000, and of all languages
together at most `max_chars`, so that many labels mean fewer characters each) of whole texts, at most `max_train_chars`
each, drawn by a hash of the id; a fifth of it only calibrates. The model is a few MB, whatever
the corpus, which bounds what is broadcast.

Null text, or text without a letter: `und`, score 0, rejected. One language only: score 1. No rows to learn from: every
text is `und`. Texts of any length are scored whole; repeated rows are scored alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm._common import unpacked, whole_rows, worker_cache

ORDER = 4
CHUNK_CHARS = 150_000
SCHEMA = "lang_pred string, score double, cross_entropy double, rejected boolean"
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


@dataclass
class Model:
    langs: list[str]
    order: int
    grams: list[np.ndarray]  # by order: sorted hashes
    logp: list[np.ndarray]  # by order: a row per hash, a column per language
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]  # by order: log of what a context leaves to the lower order
    unseen: np.ndarray  # log probability of a character no language has
    beta: float = 1.0
    mean: np.ndarray | None = None
    var: np.ndarray | None = None
    char_var: np.ndarray | None = None
    reject_z: float = 8.0


def letters() -> np.ndarray:
    """By code point: the lower-case letter, or 0."""
    cache = worker_cache()
    if "letters" not in cache:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        cache["letters"] = table
    return cache["letters"]


def symbols(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, `pad` blanks before each; the text of each; whether it counts."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + pad
    blank = " " * pad
    raw = np.frombuffer("".join([x for t in texts for x in (blank, t)]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), lens)
    is_pad = np.arange(len(raw)) - np.repeat(np.cumsum(lens) - lens, lens) < pad
    sym = letters()[raw]
    keep = sym != 0
    keep[1:] |= sym[:-1] != 0
    keep |= is_pad
    return sym[keep], doc[keep], ~is_pad[keep]


def hashes(sym: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 1 to order, the hash of the n symbols that end at each place."""
    with np.errstate(over="ignore"):
        base = (sym.astype(np.uint64) + np.uint64(1)) * _MULT
        base ^= base >> np.uint64(29)
        out, factor = [base], np.uint64(1)
        for n in range(1, order):
            factor = factor * _STEP
            h = out[-1].copy()
            h[n:] += base[:-n] * factor
            out.append(h)
        return out


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


class Lookup:
    """A sorted hash array with, for each value of a hash's top bits, the place of the first such hash."""

    def __init__(self, table: np.ndarray):
        bits = min(20, max(4, int(len(table)).bit_length() + 3))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.table = np.append(table, np.uint64(2**64 - 1))

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.first[(keys >> self.shift).view(np.int64)]
        got = self.table[at]
        late = np.flatnonzero(got < keys)
        while len(late):
            at[late] += 1
            got[late] = self.table[at[late]]
            late = late[got[late] < keys[late]]
        return at, got == keys


def by_order(model: Model) -> list[tuple[Lookup, list[np.ndarray], Lookup, list[np.ndarray]]]:
    """What a worker makes of a model once: lookups, and a column per language that ends in a zero for what is not found."""
    cache = worker_cache()
    if cache.get("langid_of") is not model:
        column = lambda x: [np.append(x[:, j], np.float32(0)) for j in range(x.shape[1])]
        made = [(Lookup(g), column(p), Lookup(c), column(b)) for g, p, c, b in zip(model.grams, model.logp, model.contexts, model.backoff, strict=True)]
        cache["langid_of"], cache["langid_made"] = model, made
    return cache["langid_made"]


def train(texts: list[list[str]], langs: list[str], order: int = ORDER) -> Model:
    """texts: by language."""
    per = []  # by language, by order: hashes, their context hashes, suffix hashes, left hashes
    for own in texts:
        sym, _, real = symbols(own, order - 1)
        hs = hashes(sym, order)
        rows = []
        for n in range(1, order + 1):
            h = hs[n - 1][real]
            context = np.roll(hs[n - 2], 1)[real] if n > 1 else np.zeros(len(h), np.uint64)
            suffix = hs[n - 2][real] if n > 1 else np.zeros(len(h), np.uint64)
            u, first, counts = np.unique(h, return_index=True, return_counts=True)
            rows.append((u, context[first], suffix[first], counts.astype(np.float64)))
        for n in range(order - 1, 0, -1):  # lower orders count the different symbols on their left
            u, context, suffix, _ = rows[n - 1]
            at, _ = find(u, rows[n][2])
            rows[n - 1] = (u, context, suffix, np.bincount(at, minlength=len(u)).astype(np.float64))
        per.append(rows)
    grams, logp, contexts, backoff = [], [], [], []
    vocabulary = len(np.unique(np.concatenate([r[0][0] for r in per]))) + 1
    k, prob = len(langs), None
    unseen = np.zeros(k)
    for n in range(1, order + 1):
        union = np.unique(np.concatenate([r[n - 1][0] for r in per]))
        suffix = np.zeros(len(union), np.uint64)
        context = np.zeros(len(union), np.uint64)
        for r in per:
            at, _ = find(union, r[n - 1][0])
            suffix[at], context[at] = r[n - 1][2], r[n - 1][1]
        ctx = np.unique(context)
        cat, _ = find(ctx, context)
        own, weight = np.zeros((len(union), k)), np.ones((len(ctx), k))
        for j, r in enumerate(per):
            u, c, _, counts = r[n - 1]
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            ci, _ = find(ctx, c)
            total = np.bincount(ci, counts, minlength=len(ctx))
            kinds = np.bincount(ci, minlength=len(ctx))
            seen = total > 0
            weight[seen, j] = discount * kinds[seen] / total[seen]
            at, _ = find(union, u)
            own[at, j] = np.maximum(counts - discount, 0) / total[ci]
        if n == 1:
            lower = np.full((len(union), k), 1 / vocabulary)
            unseen = np.log(weight[0] / vocabulary)
        else:
            at, _ = find(grams[-1], suffix)
            lower = prob[at]
        prob = own + weight[cat] * lower
        grams.append(union)
        logp.append(np.log(prob).astype(np.float32))
        contexts.append(ctx)
        backoff.append(np.log(weight).astype(np.float32))
    return Model(langs, order, grams, logp, contexts, backoff, unseen.astype(np.float32))


def entropies(model: Model, texts: list[str], *, squares: bool = False):
    """By text and language, the mean log probability a symbol; symbols counted; letters; the variance of a symbol's log probability."""
    k, tables = len(model.langs), by_order(model)
    sym, doc, real = symbols(texts, model.order - 1)
    hs = hashes(sym, model.order)
    places = np.flatnonzero(real)
    gram, logp, _, _ = tables[-1]
    at, hit = gram(hs[-1][places])
    at[~hit] = len(gram.table) - 1
    out = [column[at] for column in logp]
    todo = np.flatnonzero(~hit)
    if len(todo):
        _, _, context, backoff = tables[-1]
        for n in range(model.order - 1, -1, -1):
            at, hit = context(hs[n - 1][places[todo] - 1]) if n else (None, np.zeros(len(todo), bool))
            for j in range(k):
                if n:
                    out[j][todo[hit]] += backoff[j][at[hit]]
                else:
                    out[j][todo] += model.unseen[j]
            if not n:
                break
            gram, logp, context, backoff = tables[n - 1]
            at, hit = gram(hs[n - 1][places[todo]])
            for j in range(k):
                out[j][todo[hit]] += logp[j][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
    doc = doc[places]
    count = np.bincount(doc, minlength=len(texts))
    letter = np.bincount(doc, sym[places] != 0, minlength=len(texts))
    some = count > 0
    starts = (np.cumsum(count) - count)[some]

    def total(x: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(texts))
        if len(starts):
            sums[some] = np.add.reduceat(x, starts, dtype=np.float64)
        return sums / np.maximum(count, 1)

    mean = np.stack([total(x) for x in out], 1)
    return mean, count, letter, np.stack([total(x.astype(np.float64) ** 2) for x in out], 1) - mean**2 if squares else None


def posterior(model: Model, mean: np.ndarray, count: np.ndarray) -> np.ndarray:
    x = mean * (model.beta * np.sqrt(np.maximum(count, 1)))[:, None]
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def calibrate(model: Model, texts: list[list[str]], reject_z: float) -> Model:
    """Sets the posterior's sharpness by likelihood, and what cross-entropy is usual, from texts the counts did not see."""
    flat, truth = [t for own in texts for t in own], np.repeat(np.arange(len(texts)), [len(own) for own in texts])
    k = len(model.langs)
    model.mean, model.var, model.char_var, model.reject_z = np.zeros(k), np.full(k, 0.05), np.full(k, 4.0), reject_z
    if not flat:
        return model
    parts = [entropies(model, c, squares=True) for c in chunks(flat)]
    mean, count, letter, var = (np.concatenate([p[i] for p in parts]) for i in range(4))
    ok = letter > 0
    mean, count, var, truth = mean[ok], count[ok], var[ok], truth[ok]
    best = -np.inf
    for beta in np.geomspace(0.02, 5, 24):
        model.beta, p = beta, None
        p = posterior(model, mean, count)[np.arange(len(truth)), truth]
        if (like := np.log(np.maximum(p, 1e-6)).mean()) > best + 1e-9:
            best, chosen = like, beta
    model.beta = chosen
    right = mean.argmax(1) == truth
    every, every_var = (x[np.flatnonzero(right), truth[right]] for x in (mean, var))
    for j in range(k):
        own = right & (truth == j)
        if own.sum() >= 5:
            model.mean[j], model.var[j], model.char_var[j] = -mean[own, j].mean(), max(mean[own, j].var(), 0.002), var[own, j].mean()
        elif len(every) >= 5:  # what all languages have; little was learned of this one, so no less than its few texts have
            few = -mean[truth == j, j]
            model.mean[j], model.var[j], model.char_var[j] = max(-every.mean(), few.mean() if len(few) else -np.inf), max(every.var(), 0.002), every_var.mean()
        else:
            model.mean[j] = np.inf  # nothing is known to be usual: no text is too far
    return model


def chunks(texts: list[str]) -> Iterator[list[str]]:
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > CHUNK_CHARS:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


def predict(model: Model, texts: list[str | None]) -> pd.DataFrame:
    out = {k: [] for k in ("lang_pred", "score", "cross_entropy", "rejected")}
    names = np.array([*model.langs, "und"], dtype=object)
    for own in chunks([t or "" for t in texts]):
        if not model.langs:
            best, score, ce, letter = np.zeros(len(own), int), np.zeros(len(own)), np.full(len(own), np.nan), np.zeros(len(own))
            rejected = np.ones(len(own), bool)
        else:
            mean, count, letter, _ = entropies(model, own)
            best, post = mean.argmax(1), posterior(model, mean, count)
            rows = np.arange(len(own))
            score, ce = post[rows, best], -mean[rows, best]
            usual = np.sqrt(model.var[best] + model.char_var[best] / np.maximum(count, 1))
            rejected = ce > model.mean[best] + model.reject_z * usual
        none = letter == 0
        out["lang_pred"].append(names[np.where(none, len(model.langs), best)])
        out["score"].append(np.where(none, 0.0, score))
        out["cross_entropy"].append(np.where(none, np.nan, ce))
        out["rejected"].append(rejected | none)
    return pd.DataFrame({k: np.concatenate(v) if v else [] for k, v in out.items()})


def fit(
    labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
    chars_per_language: int = 1_500_000, max_train_chars: int = 100_000, max_chars: int = 60_000_000, reject_z: float = 8.0,
) -> Model:
    """Learns from `labelled`; only the bounded sample named above reaches the driver."""
    rows = labelled.select(
        F.xxhash64(F.col(id_col).cast("string"), F.lit(11)).alias("h"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"),
    ).where("l is not null and t is not null")
    rows = rows.where(F.length("t").between(1, max_train_chars))
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.sum(F.length("t")).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], order, [], [], [], [], np.zeros(0))
    each = min(chars_per_language, max_chars / len(langs))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, each / sizes[k]))])
    drawn = rows.where((F.col("h").cast("double") / F.lit(2.0**64) + 0.5) <= share[F.col("l")])
    got = [(r.l, r.h, r.t) for r in drawn.select("l", "h", "t").collect()]
    got.sort()
    fitting = [[t for x, h, t in got if x == lang and h % 5] for lang in langs]
    holding = [[t for x, h, t in got if x == lang and not h % 5] for lang in langs]
    fitting = [own or held for own, held in zip(fitting, holding, strict=True)]
    known = [i for i, own in enumerate(fitting) if own]
    fitting, holding, langs = [fitting[i] for i in known], [holding[i] for i in known], [langs[i] for i in known]
    return calibrate(train(fitting, langs, order), holding, reject_z)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", prefix: str = "_langid") -> DataFrame:
    """All columns of `docs`, and `prefix` (in place of a column of that name) as a struct of lang_pred, score, cross_entropy, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model).copy())  # of plain arrays: workers need not import this package
    name = f"langid-{uuid.uuid4().hex}"

    @F.pandas_udf(SCHEMA)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = worker_cache()
        if name not in cache:
            cache[name] = Model(**shared.value)
        for texts in batches:
            yield predict(cache[name], texts.tolist())

    rows = whole_rows(docs)
    return unpacked(rows, docs.columns, **{prefix: score(F.col("row")[text_col].cast("string"))})


def train_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(~held_out(id_col))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
