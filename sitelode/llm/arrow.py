"""Small helpers shared by the Arrow-batched operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a longest run of letters and digits (Python's spelling of it).
WORD = r"[^\W_]+"
#: The same for Spark's regular expressions.
WORD_JVM = r"[\p{L}\p{N}]+"
_WORD_OR_END = re.compile(WORD + r"|\n")


def per_distinct(values: pd.Series, fn: Callable[[str], object]) -> list:
    """``fn`` of each value, called once for each distinct one; null stays None."""
    done: dict[str, object] = {}
    out = []
    for v in values:
        if v is None or v != v:
            out.append(None)
            continue
        if v not in done:
            done[v] = fn(v)
        out.append(done[v])
    return out


def hash_words(words: list[str]) -> np.ndarray:
    """Stable 64-bit hashes of ``words``, each distinct word hashed once."""
    if not words:
        return np.zeros(0, np.uint64)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False).astype(np.uint64)[codes]


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting outruns ``np.unique``, which hashes, on long arrays that are partly in order."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``begin[i]`` to ``begin[i] + size[i]``, of all ``i`` in turn."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def line_tokens(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of ``lines`` (none with a line end), found in all at once: places in the distinct words, these, words of each line."""
    tokens = np.array(_WORD_OR_END.findall("\n".join(lines).lower() + "\n"), dtype=object)
    codes, distinct = pd.factorize(tokens)
    if not lines:
        return np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64)
    ends = np.flatnonzero(codes == np.flatnonzero(distinct == "\n")[0])
    return np.delete(codes, ends), distinct, np.diff(ends, prepend=-1) - 1


def any_of(flags: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The flags (bits) of consecutive runs of ``size`` places, joined by or; an empty run has none."""
    out = np.zeros(len(size), flags.dtype)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.bitwise_or.reduceat(flags, (np.cumsum(size) - size)[some])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` consecutive word hashes, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + words[k : n + k] + np.uint64(k + 1))
    return total


def map_rows(
    df: DataFrame, schema: T.StructType | str, fn: Callable[[pd.DataFrame], pd.DataFrame]
) -> DataFrame:
    """``mapInPandas`` with one call of ``fn`` per Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield fn(batch)

    return df.mapInPandas(run, schema)


def site_of(url: Column) -> Column:
    """The host of ``url``: lower-case, without user, port and one leading ``www.``.

    A url without ``//`` or null gives null.
    """
    host = F.regexp_extract(F.lower(url), r"^[^/?#]*//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))
