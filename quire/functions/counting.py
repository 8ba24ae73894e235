"""Token counts and cuts by a tokenizer that is handed in; without one, a proxy of a quarter of the characters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def count_tokens(x: Column, load: Callable | None = None) -> Column:
    """Tokens of a text (0 for null); ``load`` makes, once in each worker, a tokenizer with ``encode``."""
    if load is None:
        return F.coalesce(F.floor(F.length(x) / 4), F.lit(0)).cast("long")

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _loaded(load).encode
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(x)


def truncate_tokens(x: Column, n: int, load: Callable) -> Column:
    """The text's first ``n`` tokens, decoded; a text within them as it is."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        model = _loaded(load)

        def one(t):
            ids = model.encode(t) if t else []
            return t if len(ids) <= n else model.decode(ids[:n])

        return texts.map(one)

    return cut(x)


_models: dict[int, object] = {}


def _loaded(load: Callable):
    key = id(load)
    if key not in _models:
        _models.clear()
        _models[key] = load()
    return _models[key]
