"""Problem 9: evaluation texts inside training texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelode.llm.arrow import WORD, hash_words, map_rows, mix, shingle_hashes
from sitelode.session import broadcast_if_small, materialised

RUN, SHINGLE = 12, 5
#: Marks of items up to which the workers hold them all; beyond, a join finds them.
WANTED = 1 << 20
_WORDS = re.compile(WORD)


def words_of(text: str) -> list[str]:
    """The words of a text: longest runs of letters and digits, lower-cased."""
    return _WORDS.findall(text.lower())


def _window_minima(hashes: np.ndarray, window: int, shingle: int) -> np.ndarray:
    """The MinHash minimum of every window of ``window`` words, over its shingles; distinct."""
    inner = min(shingle, window)
    marks = mix(shingle_hashes(hashes, inner))
    span = window - inner + 1
    if len(marks) < span:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(marks, span)
    return np.unique(views.min(1)).view(np.int64)


def item_units(items: DataFrame, id_col: str, text_col: str, run: int, shingle: int) -> DataFrame:
    """``(item_id, size, mark)``: the size class of each item and its window minima."""

    def units(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for item, text in zip(batch["item_id"], batch["text"]):
            words = words_of(text)
            size = min(run, len(words))
            if size:
                out += [(item, size, m) for m in _window_minima(hash_words(words), size, shingle)]
        return pd.DataFrame(out, columns=["item_id", "size", "mark"])

    own = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    own = own.filter("item_id is not null and text is not null").distinct()
    return map_rows(own, "item_id long, size int, mark long", units)


def _batch_minima(hashes: np.ndarray, left: np.ndarray, sizes: list[int], shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(size, minima, starts)`` of the windows of every size over all texts of a batch, in one pass.

    ``left`` counts the words of the text from each word to its end.  The minima
    over one shingle more are those before with the next shingle's: no window is
    swept twice.
    """
    marks: dict[int, np.ndarray] = {}
    low, width = np.zeros(0, np.uint64), 0
    for size in sorted(sizes):
        inner = min(shingle, size)
        if inner not in marks:
            marks = {inner: mix(shingle_hashes(hashes, inner))}
            low, width = marks[inner], 1
        own = marks[inner]
        while width < size - inner + 1:
            n = len(own) - width
            if n <= 0:
                low = np.zeros(0, np.uint64)
                break
            low = np.minimum(low[:n], own[width:])
            width += 1
        starts = np.flatnonzero(left[: len(low)] >= size)
        yield size, low[starts], starts


def doc_marks(docs: DataFrame, sizes: list[int], shingle: int, wanted: dict[int, np.ndarray] | None = None) -> DataFrame:
    """``(key, size, mark)`` of each text, for every size class; only those in ``wanted`` where it is given."""

    def marks(batch: pd.DataFrame) -> pd.DataFrame:
        words = [words_of(text) for text in batch["text"]]
        many = np.array([len(w) for w in words])
        hashes = hash_words([w for ws in words for w in ws])
        left = np.repeat(np.cumsum(many), many) - np.arange(many.sum())
        row = np.repeat(np.arange(len(words)), many)
        found = []
        for size, minima, starts in _batch_minima(hashes, left, sizes, shingle):
            if wanted is not None:
                own = wanted[size]
                at = np.minimum(np.searchsorted(own, minima), len(own) - 1)
                hit = own[at] == minima
                minima, starts = minima[hit], starts[hit]
            own = pd.DataFrame({"row": row[starts], "size": np.int32(size), "mark": minima.view(np.int64)})
            found.append(own.drop_duplicates())
        out = pd.concat(found) if found else pd.DataFrame({"row": [], "size": [], "mark": []})
        return pd.DataFrame({"key": batch["key"].to_numpy()[out["row"].to_numpy(int)], "size": out["size"], "mark": out["mark"]})

    return map_rows(docs.select("key", "text"), "key string, size int, mark long", marks)


def _runs(words: list[str], size: int) -> set[str]:
    """The runs of ``size`` consecutive words, each as one string."""
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    run: int = RUN,
    shingle: int = SHINGLE,
) -> DataFrame:
    """``(doc_id, item_id)``: documents that share ``run`` consecutive words with an item.

    An item of fewer words must stand in the document whole.  Items are split by
    size: those of at least ``run`` words are searched by their windows of
    ``run`` words, each shorter size class by windows of its own size, so that
    what is searched for is always as long as what it is compared with, however
    long the document.  A window is sketched by the minimum hash of its word
    shingles; an equal window has an equal minimum, so no leak is lost, and a
    document sends out about two minima per (window - shingle + 1) words.
    Candidates with an equal minimum are then verified by exact containment of
    the item's word runs in the document's.

    Null texts and texts without words never match.  Equal documents are
    searched once.  Repeated rows give one row.  Other columns are ignored; an
    empty table on either side gives an empty result.
    """
    units = materialised(item_units(items, item_id, item_text, run, shingle))
    sizes = sorted(r["size"] for r in units.select("size").distinct().collect())  # at most ``run`` numbers
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).filter("text is not null")
    keyed = own.select("doc_id", F.md5("text").alias("key"), "text")
    wanted = materialised(units.select("size", "mark").distinct())
    if wanted.limit(WANTED + 1).count() <= WANTED:
        # Bounded: the marks that are looked for go to the workers, which send out nothing else.
        few = wanted.toPandas()
        own_marks = {s: np.sort(few["mark"][few["size"] == s].to_numpy(np.int64).view(np.uint64)) for s in sizes}
        hits = doc_marks(keyed, sizes, shingle, own_marks)
    else:
        hits = doc_marks(keyed, sizes, shingle).join(wanted, ["size", "mark"], "left_semi")
    pairs = materialised(hits.join(units, ["size", "mark"]).select("key", "item_id", "size").distinct())
    texts = keyed.join(pairs.select("key").distinct(), "key", "left_semi")
    item_texts = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item")).distinct()

    longest = item_texts.agg(F.max(F.char_length("item"))).first()[0] or 0
    item_runs: dict[tuple[str, int], set[str]] = {}

    def verify(batch: pd.DataFrame) -> pd.DataFrame:
        now, words, doc_runs, keep = None, [], {}, []
        for text, item, size in zip(batch["text"], batch["item"], batch["size"]):
            if text != now:  # rows of one text lie together
                now, words, doc_runs = text, words_of(text), {}
            if size not in doc_runs:
                doc_runs[size] = _runs(words, size)
            own = item_runs.get((item, size))
            if own is None:
                if len(item_runs) > 10_000:
                    item_runs.clear()
                own = item_runs[item, size] = _runs(words_of(item), size)
            keep.append(not own.isdisjoint(doc_runs[size]))
        return batch.loc[keep, ["key", "item_id"]]

    distinct_texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    checked = map_rows(
        distinct_texts.join(pairs, "key").join(broadcast_if_small(item_texts, 4 * longest + 16), "item_id"), "key string, item_id long", verify
    ).distinct()
    return keyed.select("doc_id", "key").join(checked, "key").select("doc_id", "item_id").distinct()


def leaked_items(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """``(item_id, n_docs)``: every item and the number of documents it leaked into, 0 too."""
    found = leaks(docs, items, **columns).groupBy("item_id").agg(F.count("*").alias("n"))
    ids = items.select(F.col(columns.get("item_id", "item_id")).alias("item_id")).filter("item_id is not null").distinct()
    return ids.join(found, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"))
