"""Where models and services plug in: batch functions with deterministic stand-ins, so that no query needs them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import on_path

Embed = Callable[[list[str]], list[list[float]]]


def hashed_embedding(texts: list[str], dims: int = 64) -> list[list[float]]:
    """Signed hashing of words, scaled to length one."""
    out = []
    for t in texts:
        v = np.zeros(dims)
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dims] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).astype(np.float32).tolist())
    return out


def embedded(df: DataFrame, text_col: str, embed: Embed = hashed_embedding, model: str = "hashed-64", batch: int = 8) -> DataFrame:
    """Adds embedding and embedding_model; texts go to `embed` in batches."""
    on_path(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            values = s.tolist()
            yield pd.Series([v for a in range(0, len(values), batch) for v in embed(values[a : a + batch])])

    return df.withColumns({"embedding": run(F.col(text_col)), "embedding_model": F.lit(model)})


def parsed_reply(reply, schema: str):
    """A model's reply without its thinking and code fence, as a struct; null if it doesn't fit."""
    bare = F.regexp_replace(reply, r"(?is)<think>.*?</think>", "")
    bare = F.regexp_replace(bare, r"(?is)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.from_json(bare, schema, {"mode": "PERMISSIVE"})
