"""Semantic chunking: sentences, breakpoints where the topic changes, pieces of a least size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitelode.functions.vectors import cosine
from sitelode.operators.dedupe import not_yet
from sitelode.operators.embedding import Embedder

MIN_CHARS, PERCENTILE = 1_000, 0.95


def sentences(text: Column) -> Column:
    """A text split on the white space behind ``.``, ``?`` or ``!``."""
    return F.split(text, r"(?U)(?<=[.?!])\s+", -1)


def grow_pieces(parts: list[str], breaks: list[bool], min_chars: int) -> list[str]:
    """Sentences joined by spaces, cut behind the ``breaks`` where the piece has ``min_chars`` already."""
    pieces, begin = [], 0
    for i, cut in enumerate(breaks):
        piece = " ".join(parts[begin : i + 1])
        if cut and len(piece) >= min_chars:
            pieces.append(piece)
            begin = i + 1
    if begin < len(parts):
        pieces.append(" ".join(parts[begin:]))
    return pieces


def semantic_split(parts: list[str], embedder: Embedder, min_chars: int = MIN_CHARS, percentile: float = PERCENTILE) -> list[str]:
    """Pieces of one text: a break where neighbouring sentence windows differ more than the percentile of the text."""
    if len(parts) < 2:
        return parts
    windows = [" ".join(parts[max(0, i - 1) : i + 2]) for i in range(len(parts))]
    v = np.asarray(embedder.encode(windows), np.float64)
    size = np.linalg.norm(v, axis=1)
    size[size == 0] = 1
    v = v / size[:, None]
    apart = 1 - (v[:-1] * v[1:]).sum(1)
    return grow_pieces(parts, list(apart > np.percentile(apart, percentile * 100)), min_chars)


def breakpoints(rows: DataFrame, group: str, order: str, vector: str, percentile: float = PERCENTILE) -> DataFrame:
    """``(group, order, distance, is_break)`` between each row and the next of its group.

    The last row of a group has no distance.  Windows share one partitioning by
    ``group``, so the rows are shuffled once.
    """
    by = Window.partitionBy(group).orderBy(order)
    apart = rows.select(
        group, order, (1 - cosine(F.col(vector), F.lead(vector).over(by))).alias("distance")
    )
    limit = F.percentile("distance", percentile).over(Window.partitionBy(group))
    return apart.withColumn("is_break", F.col("distance") > limit).filter("distance is not null")


def section_label(title: Column, kind: Column, index: Column) -> Column:
    """The title (else the page type, else ``section``), from the second chunk on with ``_part`` and its number."""
    given = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    base = F.trim(F.coalesce(given(title), given(kind), F.lit("section")))
    return F.when(index == 0, base).otherwise(F.concat(base, F.lit("_part"), (index + 1).cast("string")))


def chunk_pages(pages: DataFrame, embedder: Embedder, done: DataFrame | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(page_id, section, chunk_index, content, embedding)`` of the pages that have no chunks yet.

    ``done`` are the chunks so far: pages in it are not split again (an anti
    join).  Null and empty contents give no chunk.  Row-local: a page's
    sentences never leave its row, so one long page costs one task its own text
    and nothing is regrouped.
    """
    todo = pages if done is None else not_yet(pages, done, "id", "page_id")
    todo = todo.filter("content is not null and content <> ''")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pieces = [semantic_split([s for s in p], embedder, min_chars) for p in batch["parts"]]
            yield pd.DataFrame({"id": batch["id"], "title": batch["title"], "page_type": batch["page_type"], "pieces": pieces})

    parts = todo.select("id", "title", "page_type", sentences(F.col("content")).alias("parts"))
    made = parts.mapInPandas(split, "id long, title string, page_type string, pieces array<string>")
    return made.select("id", "title", "page_type", F.posexplode("pieces").alias("chunk_index", "content")).select(
        F.col("id").alias("page_id"),
        section_label(F.col("title"), F.col("page_type"), F.col("chunk_index")).alias("section"),
        "chunk_index", "content", F.lit(None).cast("string").alias("embedding"),
    )
