"""Model-backed steps: a registry of plain callables, with stand-ins that need no model."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

REGISTRY: dict[str, Callable] = {}


def register(name: str, fn: Callable) -> None:
    REGISTRY[name] = fn


def first_sentence(text: str) -> dict[str, str]:
    """A stand-in summary: title and description from the first sentence."""
    one = re.split(r"(?<=[.!?])\s", text.strip(), maxsplit=1)[0]
    return {"title": one[:60], "description": one[:200], "text": text.strip()[:400]}


def keyword_classifier(text: str, words: dict[str, list[str]]) -> list[str]:
    lower = text.lower()
    return sorted(tag for tag, keys in words.items() if any(k in lower for k in keys))


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    """A unit vector of hashed words; zero for no words."""
    v = [0.0] * dim
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


register("summarize", first_sentence)
register("embed", hashed_embedding)


def summarize(df: DataFrame, name: str = "summarize", key: str = "document_id") -> DataFrame:
    """``(key, title, description, text)`` by a registered callable, in Arrow batches; a text that fails gives nulls."""
    fn, kind = REGISTRY[name], df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf["text"]):
                try:
                    out.append((k, *(fn(t or "")[c] for c in ("title", "description", "text"))))
                except Exception:  # one failed text does not stop the others
                    out.append((k, None, None, None))
            yield pd.DataFrame(out, columns=[key, "title", "description", "text"])

    return df.select(key, "text").mapInPandas(run, f"{key} {kind}, title string, description string, text string")


def embed(df: DataFrame, name: str = "embed", key: str = "chunk_id") -> DataFrame:
    fn, kind = REGISTRY[name], df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "embedding": [fn(t or "") for t in pdf["text"]]})

    return df.select(key, "text").mapInPandas(run, f"{key} {kind}, embedding array<float>")
