"""Token ids of whole texts, by a fixed public tokenizer whose file is a parameter.

A tokenizer that drops white space gives each word the ids it has anywhere, so words are looked up in a bounded table
and only new ones are encoded, Latin ones by the tokenizer's model directly (checked against the whole tokenizer when it is
loaded, and not used where it differs); a text that holds a special token's marks is encoded as a whole.
Null text has no ids. Ids are kept as little-endian unsigned integers of two or, for large vocabularies, four bytes.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm._common import worker_cache

END = 1
CACHE_WORDS = 700_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 65_536 else "<u4")


def encoder(path: str, by_word: bool = True) -> tuple[Callable[[list[bytes]], list[bytes]], np.dtype]:
    """A function from texts in UTF-8 to their ids as bytes, and the type of an id; kept for the worker's life."""
    cache = worker_cache()
    if ("encoder", path, by_word) in cache:
        return cache["encoder", path, by_word]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    kind = id_type(tok.get_vocab_size(with_added_tokens=True))
    marks = [t.content.encode()[:2] for t in tok.get_added_tokens_decoder().values()]
    model, code, signs = tok.model, "H" if kind.itemsize == 2 else "I", byte_signs()
    units = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall

    def whole(texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, kind).tobytes() for e in tok.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def latin(w: bytes) -> bytes | None:
        """The ids of a word of signs up to U+024F, its units put to the tokenizer's model as they stand there: composed, lower-cased, a
        sign for each byte. None for other words, and for those with an apostrophe, which has rules of its own."""
        if w.isalpha():
            return array(code, [t.id for t in model.tokenize(w.decode())]).tobytes()
        text = unicodedata.normalize("NFC", w.decode("utf-8", "replace"))
        if max(text) > "\u024f" or "\u0130" in text or "'" in text:
            return None
        ids = [t.id for u in units(text.lower()) for t in model.tokenize("".join(map(signs.__getitem__, u.encode())))]
        return array(code, ids).tobytes()

    class Words(dict):
        """The ids of a word, found when it is first asked for."""

        def __missing__(self, w: bytes) -> bytes:
            ids = latin(w)
            self[w] = ids = whole([w])[0] if ids is None else ids
            return ids

    words = Words()
    checks = [x.lower() for x in "the naïve straße ñandú œuvre e\u0301te xqzjvk internationalisation ǆungla a1b22. x***, 12.5% né. «mot» _a_b- ½x x² ª\u0301".encode().split()]
    direct = by_word and sys.byteorder == "little" and all(latin(w) in (None, x) for w, x in zip(checks, whole(checks), strict=True))

    def encode(texts: list[bytes]) -> list[bytes]:
        if not direct:  # another kind of tokenizer, or one that the shortcut does not suit
            return whole(texts)
        if len(words) > CACHE_WORDS:
            words.clear()
        # lower() for bytes is A-Z alone; the tokenizer does as much and more
        return [whole([t])[0] if any(m in t for m in marks) else b"".join(map(words.__getitem__, t.lower().split())) for t in texts]

    cache["encoder", path, by_word] = encode, kind
    return encode, kind


def byte_signs() -> list[str]:
    """The sign that byte-level BPE has for each byte: printable Latin-1 ones stand for themselves, others for signs from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def groups_of(texts: list[bytes], size: int = 400_000) -> Iterator[list[bytes]]:
    own, n = [], 0
    for t in texts:
        own.append(t)
        n += len(t)
        if n > size:
            yield own
            own, n = [], 0
    if own:
        yield own


def with_tokens(
    docs: DataFrame, *, text_col: str = "text", tokenizer: str | None = None, by_word: bool = True, end: int = END,
    place: Callable[[list[np.ndarray]], np.ndarray] | None = None, out: str = "_tok",
) -> DataFrame:
    """All columns of docs and a struct of ids (with the end id), n, at (the ids before them in the partition, as it is read) and,
    if `place` is given, what it makes of the ids, as curve."""
    path = tokenizer or default_tokenizer()

    @F.pandas_udf("ids binary, n long, at long, curve long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode, kind = encoder(path, by_word)
        last, before = np.array([end], kind).tobytes(), 0
        for texts in batches:
            ids, curve = [], []
            for own in groups_of([t or b"" for t in texts]):
                got = encode(own)
                ids += [x + last for x in got]
                if place:
                    curve.append(place([np.frombuffer(x, kind) for x in got]))
            n = np.array([len(x) // kind.itemsize for x in ids], np.int64)
            ends = before + np.cumsum(n)
            yield pd.DataFrame({"ids": ids, "n": n, "at": ends - n, "curve": np.concatenate(curve) if curve else np.zeros(len(ids), np.int64)})
            before = int(ends[-1]) if len(ends) else before

    return docs.withColumn(out, tokens(F.col(text_col).cast("string").cast("binary")))


def token_table(docs: DataFrame, scratch, *, id_col: str, text_col: str, **kw) -> DataFrame:
    """doc_id, row (a key of its own, partition and place), ids, n, at, curve; written, as texts are encoded once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return scratch.save(with_tokens(rows, text_col="text", **kw).select("doc_id", "row", "_tok.*"), "tokens", codec="zstd")


def cut(ids: bytes, at: int, size: int, length: int, bounds: Callable[[int], tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """The pieces of a document of `length` ids that begins at the global place `at`: start, length, sequence, offset, ids."""
    start = 0
    while start < length:
        sequence, first, stop = bounds(at + start)
        n = min(length - start, stop - (at + start))
        yield start, n, sequence, at + start - first, ids[start * size : (start + n) * size]
        start += n


def arrow(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
