"""Exact vector search, re-ranking for diversity, and retrieval of chunk records."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitelode.functions.text import slugify
from sitelode.functions.vectors import cosine, squared_distance, unit

RECALL, FINAL, RELEVANCE = 25, 3, 0.7
#: Queries held by a task at once.
QUERY_BLOCK = 4_096
# Words of a question that no slug is made of; sizes of the slugs.
STOPWORDS = "price prices cost costs rate rates how much buy purchase order shop discount offer offers".split()
SLUG_LEAST, NGRAMS = 6, (4, 3, 2)


def build_index(rows: DataFrame, id_col: str, vector_col: str, use_cosine: bool = True) -> DataFrame:
    """``(id, v)``: the index is a table of vectors, of length 1 for cosine."""
    v = unit(F.col(vector_col)) if use_cosine else F.transform(vector_col, lambda x: x.cast("double"))
    return rows.select(F.col(id_col).alias("id"), v.alias("v"))


def _scored(index: DataFrame, query: list[float], use_cosine: bool) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    score = F.aggregate(F.zip_with("v", unit(q), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) if use_cosine else -squared_distance(F.col("v"), q)
    return index.select("id", score.alias("score"))


def search(index: DataFrame, query: list[float], top_k: int = 3, use_cosine: bool = True, digits: int = 9) -> DataFrame:
    """``(id, score)`` of the ``top_k`` best rows, best first, ties by the smaller id.

    The score is the cosine, or the negative squared distance, rounded so that
    equal vectors tie.  Planned as
    TakeOrderedAndProject: each partition keeps ``top_k`` rows, nothing is
    shuffled.  Fewer rows than ``top_k``: all of them.
    """
    scored = _scored(index, query, use_cosine).withColumn("score", F.round("score", digits))
    return scored.orderBy(F.desc("score"), "id").limit(top_k)


def search_batch(
    index: DataFrame, queries: DataFrame, top_k: int = 3, use_cosine: bool = True, digits: int = 6, skip_self: bool = False
) -> DataFrame:
    """``(query_id, rank, id, score)`` of the best rows for each of many queries, ranks from 1.

    ``queries`` is ``(query_id, v)``, a stated set.  It is taken in blocks of
    QUERY_BLOCK; a block is scored against every partition of the index by
    matrix products, each Arrow batch keeps its ``top_k`` rows per query, and
    only those are shuffled.  Nothing grows with queries x rows but the products.
    """
    parts = []
    # Blocks come to the driver one at a time: a query set is small beside the index.
    rows = queries.select("query_id", "v").orderBy("query_id").toLocalIterator()
    while block := list(islice(rows, QUERY_BLOCK)):
        ids = np.array([r["query_id"] for r in block])
        q = np.array([r["v"] for r in block], np.float64)
        if use_cosine:
            q = q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-12)
        parts.append(index.select("id", "v").mapInPandas(_block_scorer(ids, q, top_k, use_cosine, digits, skip_self), "query_id long, id long, score double"))
    if not parts:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k).select("query_id", "rank", "id", "score")


def _block_scorer(ids: np.ndarray, q: np.ndarray, top_k: int, use_cosine: bool, digits: int, skip_self: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.array(list(batch["v"]), np.float64).reshape(len(batch), -1)
            own = batch["id"].to_numpy()
            for at in range(0, len(ids), 256):
                some = q[at : at + 256]
                score = some @ x.T
                if not use_cosine:
                    score = 2 * score - (x**2).sum(1) - (some**2).sum(1)[:, None]
                score = score.round(digits)
                if skip_self:
                    score[ids[at : at + 256, None] == own] = -np.inf
                order = np.lexsort((np.broadcast_to(own, score.shape), -score), axis=1)[:, :top_k]
                kept = np.take_along_axis(score, order, 1)
                ok = np.isfinite(kept)
                yield pd.DataFrame({
                    "query_id": np.repeat(ids[at : at + 256], ok.sum(1)), "id": own[order][ok], "score": kept[ok],
                })

    return run


def mmr_order(query: np.ndarray, docs: np.ndarray, top_n: int, weight: float = RELEVANCE) -> list[int]:
    """Positions of the documents picked one by one for relevance less likeness to those picked; ties: the first."""
    unit_rows = lambda m: m / (np.linalg.norm(m, axis=-1, keepdims=True) + 1e-12)
    docs, query = unit_rows(np.asarray(docs, np.float64)), unit_rows(np.asarray(query, np.float64))
    relevance = (docs @ query).round(9)
    gain, likeness, picked = relevance.copy(), np.full(len(docs), -np.inf), []
    while len(picked) < min(top_n, len(docs)):
        best = int(gain.argmax())
        picked.append(best)
        likeness = np.maximum(likeness, (docs @ docs[best]).round(9))
        gain = (weight * relevance - (1 - weight) * likeness).round(9)
        gain[picked] = -np.inf
    return picked


def mmr_rerank(candidates: DataFrame, top_n: int = FINAL, weight: float = RELEVANCE) -> DataFrame:
    """``(query_id, rank, id, score)``: each query's candidates re-ranked, ranks from 1, score the cosine.

    ``candidates`` is ``(query_id, rank, id, score, v, q)`` with the vectors of
    the candidate and its query; a query has few candidates (a recall depth), so
    a group is small by construction.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        order = mmr_order(np.array(rows["q"].iloc[0]), np.array(list(rows["v"])), top_n, weight)
        out = rows.iloc[order]
        return pd.DataFrame({"query_id": out["query_id"], "rank": np.arange(1, len(out) + 1, dtype=np.int32), "id": out["id"], "score": out["score"]})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, rank int, id long, score double")


def slug_candidates(question: Column) -> Column:
    """Slugs of a question: all words but stopwords, then its last 4, 3 and 2; under 6 characters none; each once."""
    words = F.filter(F.split(F.trim(F.coalesce(question, F.lit(""))), r"(?U)\s+"), lambda w: (w != "") & ~F.lower(w).isin(STOPWORDS))
    tails = [F.when(F.size(words) >= n, slugify(F.array_join(F.slice(words, -n, n), " "))) for n in NGRAMS]
    every = F.array(slugify(F.array_join(words, " ")), *tails)
    return F.array_distinct(F.filter(every, lambda s: s.isNotNull() & (F.char_length(s) >= SLUG_LEAST)))


def match_slugs(chunks: DataFrame, pages: DataFrame, slugs: DataFrame) -> DataFrame:
    """``(query_id, slug, chunk_id)``: chunks of the pages whose url or title contains a slug.

    ``slugs`` is ``(query_id, slug)``.  A slug has at least SLUG_LEAST
    characters, so a text that contains it has its first SLUG_LEAST as a run:
    texts and slugs meet by an equi-join on such runs and are then compared, so
    the work follows the matches, not pages x slugs.  Only matching pages are
    joined with their chunks.  Slugs shorter than that are ignored.
    """
    named = slugs.filter(F.char_length("slug") >= SLUG_LEAST)
    keyed = named.select("slug", F.substring("slug", 1, SLUG_LEAST).alias("run")).distinct()
    texts = pages.select(F.col("id").alias("page_id"), F.explode(F.array(F.lower("url"), F.lower("title"))).alias("text"))
    starts = F.sequence(F.lit(1), F.char_length("text") - (SLUG_LEAST - 1))
    runs = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(SLUG_LEAST))))
    shown = texts.filter(F.char_length("text") >= SLUG_LEAST).distinct().select("page_id", "text", F.explode(runs).alias("run"))
    matched = shown.join(keyed, "run").filter(F.contains(F.col("text"), F.col("slug"))).select("page_id", "slug").distinct()
    return chunks.select(F.col("id").alias("chunk_id"), "page_id").join(matched, "page_id").join(named, "slug").select(
        "query_id", "slug", "chunk_id"
    ).distinct()


def fetch_records(hits: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Hits with the text of their chunk and the title, url and type of its page.

    Late materialisation: texts are read for the hits only; a hit whose chunk is
    gone is dropped.
    """
    text = chunks.select(F.col("id").alias("chunk_id"), "page_id", F.col("content").alias("text"))
    page = pages.select(F.col("id").alias("page_id"), "title", "url", "page_type")
    return hits.withColumnRenamed("id", "chunk_id").join(text, "chunk_id").join(page, "page_id").select(
        "query_id", "rank", "chunk_id", "title", "url", "page_type", "text", "score"
    )


def search_allowed(vectors: DataFrame, queries: DataFrame, allowed: DataFrame, top_k: int = 3, digits: int = 6) -> DataFrame:
    """``(query_id, rank, id, score)``: the best rows by cosine of those that each query may find.

    ``allowed`` is ``(query_id, id)``: exactly these pairs are scored, whatever
    other queries may find, so a query gets ``top_k`` rows unless it has fewer.
    """
    pairs = allowed.select("query_id", "id").distinct().join(vectors.select("id", "v"), "id")
    scored = pairs.join(queries.select("query_id", F.col("v").alias("q")), "query_id").select(
        "query_id", "id", F.round(cosine(F.col("v"), F.col("q")), digits).alias("score")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k).select("query_id", "rank", "id", "score")


def retrieve(
    questions: DataFrame, chunks: DataFrame, pages: DataFrame, question_vectors: DataFrame, vectors: DataFrame,
    recall: int = RECALL, final: int = FINAL, weight: float = RELEVANCE, prefilter: bool = False,
) -> DataFrame:
    """Ranked hits for a table of questions: recall by cosine, filter by slug, re-rank, fetch.

    ``questions`` is ``(query_id, question)``, ``question_vectors`` ``(query_id, v)``,
    ``vectors`` ``(id, v)``.  A question of which some slug matches chunks keeps
    only those; by default after the recall (a slug found only outside it leaves
    nothing), with ``prefilter`` before it.
    """
    slugs = questions.select("query_id", F.explode(slug_candidates(F.col("question"))).alias("slug"))
    allowed = match_slugs(chunks, pages, slugs).select("query_id", F.col("chunk_id").alias("id")).distinct()
    if prefilter:
        free = question_vectors.join(allowed.select("query_id").distinct(), "query_id", "left_anti")
        found = search_allowed(vectors, question_vectors, allowed, recall).unionByName(search_batch(vectors, free, recall))
    else:
        wide = search_batch(vectors, question_vectors, recall)
        limited = allowed.select("query_id").distinct().withColumn("limited", F.lit(True))
        marked = wide.join(limited, "query_id", "left").join(allowed.withColumn("named", F.lit(True)), ["query_id", "id"], "left")
        found = marked.filter("limited is null or named").select("query_id", "rank", "id", "score")
    candidates = found.join(vectors.select("id", "v"), "id").join(question_vectors.withColumnRenamed("v", "q"), "query_id")
    return fetch_records(mmr_rerank(candidates, final, weight), chunks, pages)
