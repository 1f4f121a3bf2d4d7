"""The pluggable embedding function, and a deterministic stand-in that is not semantic."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Embed = Callable[[list[str]], list[list[float]]]
DIM = 64


def hashed(texts: list[str], dim: int = DIM) -> list[list[float]]:
    """Signed counts of hashed tokens, scaled to unit length and 6 decimals; a text without tokens is the first axis."""
    out = []
    for text in texts:
        v = np.zeros(dim)
        for t in re.findall(r"[a-z0-9]+", (text or "").lower()):
            h = zlib.crc32(t.encode())
            v[h % dim] += 1 if h & 0x40000000 else -1
        if not v.any():
            v[0] = 1.0
        out.append(np.round(v / np.linalg.norm(v), 6).tolist())
    return out


def embedded(rows: DataFrame, column: str, embed: Embed = hashed, to: str = "embedding") -> DataFrame:
    """rows + an array<float> of the embedding of a text column: one call of `embed` per Arrow batch."""
    schema = T.StructType([f for f in rows.schema.fields if f.name != to] + [T.StructField(to, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns=[to], errors="ignore").assign(**{to: list(embed([t or "" for t in pdf[column]]))})

    return rows.mapInPandas(run, schema)
