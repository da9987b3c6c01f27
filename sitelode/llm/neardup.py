"""Problem 5: near-duplicate texts by b-bit MinHash."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.llm.arrow import WORD, mix, shingle_hashes
from sitelode.operators.components import connected_components
from sitelode.operators.dedupe import distinct_rows
from sitelode.session import broadcast_if_small, materialised

SHINGLE, SIMILARITY = 5, 0.8
#: Minima in the signature: BANDS x ROWS; low bits kept of each.
BANDS, ROWS, BITS = 48, 4, 2
#: Standard errors below the threshold at which an estimate is still verified.
SLACK = 4.0

_WORDS = re.compile(WORD)
_PER_LONG = 64 // BITS


def _signatures(shingle: int):
    """``(key, shingles, packed, bands)`` of each text; texts with too few words give no row."""
    seeds = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [_WORDS.findall(t.lower()) for t in batch["text"]]
            flat = np.array([w for ws in words for w in ws], dtype=object)
            codes, distinct = pd.factorize(flat) if len(flat) else (np.zeros(0, int), [])
            hashed = pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False).astype(np.uint64)
            at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
            keep, sets, packs, bands = [], [], [], []
            for i in range(len(words)):
                marks = np.unique(shingle_hashes(hashed[codes[at[i] : at[i + 1]]], shingle))
                if not len(marks):
                    continue
                minima = np.empty(BANDS * ROWS, np.uint64)
                step = max(1, (1 << 20) // len(marks))
                for s in range(0, len(seeds), step):  # bounded memory for very long texts
                    minima[s : s + step] = mix(marks[None, :] ^ seeds[s : s + step, None]).min(1)
                low = (minima & np.uint64((1 << BITS) - 1)).reshape(-1, _PER_LONG)
                packs.append((low << (np.arange(_PER_LONG, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).view(np.int64))
                by_band = minima.reshape(BANDS, ROWS)
                key = np.arange(BANDS, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(ROWS):
                        key = mix(key * np.uint64(31) + by_band[:, r])
                bands.append(key.view(np.int64))
                keep.append(i)
                sets.append(marks.view(np.int64))
            if keep:  # Arrow can't tell the type of an empty column of lists
                yield pd.DataFrame({"key": batch["key"].to_numpy()[keep], "shingles": sets, "packed": packs, "bands": bands})

    return run


_SIGNED = "key long, shingles array<long>, packed array<long>, bands array<long>"


def estimate(one: Column, two: Column) -> Column:
    """The Jaccard similarity that two packed b-bit signatures show, corrected for chance.

    Equal positions are counted by bit counts; a share of 2^-b of unequal minima
    has equal low bits, which is taken off.
    """
    mask = sum(1 << (BITS * i) for i in range(_PER_LONG))
    mask -= (1 << 64) if mask >= 1 << 63 else 0

    def unequal(x: Column, y: Column) -> Column:
        diff = x.bitwiseXOR(y)
        any_bit = diff
        for b in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(diff, b))
        return F.bit_count(any_bit.bitwiseAND(F.lit(mask)))

    misses = F.aggregate(F.zip_with(one, two, unequal), F.lit(0), lambda a, x: a + x)
    chance = 2.0**-BITS
    return (1 - misses / (BANDS * ROWS) - chance) / (1 - chance)


def _classes(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(id, same)`` of each row with a text, and ``(key, text)`` of each class of equal texts.

    ``same`` is a hash of the text's words, ``key`` the least id of the class.
    """
    own = distinct_rows(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id")
    own = own.filter("id is not null and text is not null")
    plain = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    same = materialised(own.select("id", F.md5(plain).alias("same")))
    heads = same.groupBy("same").agg(F.min("id").alias("key"), F.count("*").alias("n"))
    again = materialised(heads.filter("n > 1").select("same", "key"))
    members = same.join(broadcast_if_small(again, 64), "same", "left").select("id", F.coalesce("key", "id").alias("key"))
    extra = members.filter("id <> key").select("id")
    texts = own.join(broadcast_if_small(materialised(extra), 16), "id", "left_anti").select(F.col("id").alias("key"), "text")
    return members, texts


def similar_classes(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``(a, b, similarity)``, a < b: the keys of different texts that reach ``similarity``."""
    signed = materialised(texts.mapInPandas(_signatures(shingle), _SIGNED))
    banded = signed.select("key", F.explode("bands").alias("band"))
    # Only buckets of several texts are joined; counts are summed map-side first.
    full = banded.groupBy("band").count().filter("count > 1").select("band")
    shared = materialised(banded.join(broadcast_if_small(materialised(full), 16), "band", "left_semi"))
    left, right = shared.select("band", F.col("key").alias("a")), shared.select("band", F.col("key").alias("b"))
    pairs = left.join(right, "band").filter("a < b").select("a", "b").distinct()
    sketch = signed.select("key", "packed")
    error = ((1 - 2.0**-BITS) ** -1) * 0.5 / (BANDS * ROWS) ** 0.5
    likely = (
        pairs.join(sketch.select(F.col("key").alias("a"), F.col("packed").alias("pa")), "a")
        .join(sketch.select(F.col("key").alias("b"), F.col("packed").alias("pb")), "b")
        .filter(estimate(F.col("pa"), F.col("pb")) >= similarity - SLACK * error)
        .select("a", "b")
    )
    sets = signed.select("key", "shingles")
    both = F.size(F.array_intersect("sa", "sb"))
    share = both / (F.size("sa") + F.size("sb") - both)
    return (
        likely.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
        .select("a", "b", share.alias("similarity"))
        .filter(F.col("similarity") >= similarity)
    )


def near_duplicates(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "content",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
) -> tuple[DataFrame, DataFrame]:
    """Links between different texts and the membership of rows in classes of equal texts.

    Returns ``(key_a, key_b, similarity)``, one row per pair of classes whose sets
    of ``shingle`` consecutive words have a Jaccard similarity of at least
    ``similarity``, and ``(id, key)``, the class (its least id) of every row with
    a text.  Equal word sequences are one class, signed once, so a group of
    copies costs one signature and no pairs.  Candidates share one of BANDS bands
    of ROWS minima; their b-bit signatures are compared by bit counts, and what
    reaches the threshold less SLACK standard errors is verified on the shingle
    sets themselves.

    Null texts: no row.  Texts of fewer than ``shingle`` words: a class, but no
    link.  Repeated rows: once.  Other columns are ignored; an empty table gives
    empty results.
    """
    members, texts = _classes(df, id_col, text_col)
    links = similar_classes(texts, shingle, similarity)
    return links.select(F.col("a").alias("key_a"), F.col("b").alias("key_b"), "similarity"), members


def duplicate_groups(df: DataFrame, id_col: str = "id", text_col: str = "content", **options) -> DataFrame:
    """``(id, class_id, group_id, n_links)``: one row per row with a text.

    ``class_id`` is the least id with the same words, ``group_id`` the least id
    connected by links, ``n_links`` the number of other classes linked to its own.
    """
    links, members = near_duplicates(df, id_col, text_col, **options)
    links = materialised(links)
    degree = (
        links.select(F.explode(F.array("key_a", "key_b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    )
    parts = connected_components(links, "key_a", "key_b")
    return (
        members.join(degree, "key", "left")
        .join(parts.withColumnRenamed("node", "key"), "key", "left")
        .select(
            "id", F.col("key").alias("class_id"), F.coalesce("component", "key").alias("group_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )


def duplicate_pairs(df: DataFrame, id_col: str = "id", text_col: str = "content", **options) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: every pair of rows that are alike, copies too.

    The links of :func:`near_duplicates` with classes opened to their rows; the
    rows of one class are alike if they have a shingle at all.
    """
    links, members = near_duplicates(df, id_col, text_col, **options)
    members = materialised(members)
    one = members.select(F.col("key").alias("key_a"), F.col("id").alias("x"))
    two = members.select(F.col("key").alias("key_b"), F.col("id").alias("y"))
    across = links.join(one, "key_a").join(two, "key_b").select("x", "y")
    size = options.get("shingle", SHINGLE)
    enough = F.size(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) >= size
    several = members.groupBy("key").count().filter("count > 1").select("key")
    real = df.filter(enough).select(F.col(id_col).alias("id")).distinct()
    inside = members.join(several, "key").join(real, "id").select("key", "id")
    twins = inside.select("key", F.col("id").alias("x")).join(inside.select("key", F.col("id").alias("y")), "key").filter("x < y")
    every = across.unionByName(twins.select("x", "y"))
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
