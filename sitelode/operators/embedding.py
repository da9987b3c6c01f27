"""Embedders behind one interface, and filling in missing embeddings."""

from __future__ import annotations

import re
import zlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.functions.vectors import parse_vector, vector_json

BATCH = 32


class Embedder(Protocol):
    """Anything that turns a list of texts into rows of a float matrix."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Deterministic embeddings: hashed counts of words, of length 1; a text without words is zero."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in enumerate(texts):
            for word in re.findall(r"[^\W_]+", (text or "").lower()):
                code = zlib.crc32(word.encode())
                out[row, code % self.dim] += 1.0 if code & (1 << 31) else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


def embed(text: Column, embedder: Embedder, batch: int = BATCH) -> Column:
    """``array<float>`` of a text column; the embedder sees ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        texts = [v or "" for v in values]
        rows = [r for at in range(0, len(texts), batch) for r in embedder.encode(texts[at : at + batch])]
        return pd.Series(rows, dtype=object)

    return run(text)


def embed_missing(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """``chunks`` with JSON embeddings where ``embedding`` was null; others stay as they are."""
    todo = F.col("embedding").isNull()
    made = vector_json(embed(F.col("content"), embedder))
    done = chunks.filter(~todo)
    return done.unionByName(chunks.filter(todo).withColumn("embedding", made))


def load_embeddings(chunks: DataFrame) -> DataFrame:
    """``(id, v)`` of the chunks whose embedding is a JSON array; null and broken ones are left out."""
    return chunks.filter("embedding is not null").select("id", parse_vector(F.col("embedding")).alias("v")).filter("v is not null")
