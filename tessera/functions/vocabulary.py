"""Token ids of a tokenizers file as columns: Arrow batches go to the library by slices of bounded size, each worker reads the file once."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Characters (or ids) that the library has at once: what it makes of them takes some hundred bytes for each.
AT_ONCE = 1 << 18


def _slices(items: Sequence) -> Iterator[Sequence]:
    """Runs of neighbours of at most AT_ONCE characters or ids together; a longer one is alone."""
    start, size = 0, 0
    for k, x in enumerate(items):
        if k > start and size + len(x) > AT_ONCE:
            yield items[start:k]
            start, size = k, 0
        size += len(x)
    if start < len(items):
        yield items[start:]


def _encoded(path: str, texts: list[str]) -> Iterator:
    for some in _slices(texts):
        yield from _tokenizer(path).encode_batch_fast(some, add_special_tokens=False)


def encode(text: Column | str, path: str) -> Column:
    """Ids of a text, without special tokens added; null for null."""

    def ids(batch: pd.Series) -> pd.Series:
        found = _encoded(path, batch[batch.notna()].tolist())
        return pd.Series([np.array(next(found).ids, np.int32) if there else None for there in batch.notna()], dtype=object)

    return F.pandas_udf(ids, "array<int>")(text)


def decode(ids: Column | str, path: str, skip_special: bool = True) -> Column:
    """The text of ids; null for null.  Special tokens are left out unless skip_special is false, unknown ids always."""

    def texts(batch: pd.Series) -> pd.Series:
        there = batch[batch.notna()]
        found = [s for some in _slices(there.tolist()) for s in _tokenizer(path).decode_batch([np.asarray(x).tolist() for x in some], skip_special_tokens=skip_special)]
        return pd.Series(found, index=there.index, dtype=object).reindex(batch.index).where(batch.notna(), None)

    return F.pandas_udf(texts, "string")(ids)


def counts(texts: Column | str, path: str, before: str = "", after: str = "") -> Column:
    """How many ids each of an array of texts has, put between two others; null for null."""

    def sizes(batch: pd.Series) -> pd.Series:
        flat = [before + x + after for one in batch if one is not None for x in one if x is not None]
        found = map(len, _encoded(path, flat))
        return pd.Series([None if one is None else [None if x is None else next(found) for x in one] for one in batch], dtype=object)

    return F.pandas_udf(sizes, "array<int>")(texts)
