"""Breadth-first crawling of a link graph, and fetching with retries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from queue import Empty, Queue
from threading import Thread

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelode.functions.html import all_hrefs
from sitelode.functions.urls import absolute_url, is_internal, is_page_url, normalize_url
from sitelode.schemas import FETCHED
from sitelode.session import materialised

MAX_DEPTH = 3
ATTEMPTS, DELAY, BACKOFF = 2, 1.5, 2.0
POLITE = (0.2, 0.8)
#: Seconds that a fetch may take.
TIMEOUT = 15.0


def with_retry(call: Callable[[], str], attempts: int = ATTEMPTS, delay: float = DELAY, backoff: float = BACKOFF, sleep=time.sleep) -> str:  # noqa: ANN001
    """``call()``, tried again after growing waits; the last error is raised."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if attempt == attempts:
                raise
            sleep(delay * backoff ** (attempt - 1) + random.uniform(0, 1))
    raise ValueError("attempts must be at least 1")


def _within(fetch: Callable[[str], str], url: str, timeout: float | None) -> str:
    """``fetch(url)``, a TimeoutError after ``timeout`` seconds."""
    if timeout is None:
        return fetch(url)
    done: Queue = Queue()

    def run() -> None:
        try:
            done.put((fetch(url), None))
        except Exception as e:  # noqa: BLE001
            done.put((None, e))

    Thread(target=run, daemon=True).start()
    try:
        html, error = done.get(timeout=timeout)
    except Empty:
        raise TimeoutError(f"no answer within {timeout} s") from None
    if error is not None:
        raise error
    return html


def fetch_pages(urls: DataFrame, fetch: Callable[[str], str], attempts: int = ATTEMPTS, polite: tuple[float, float] = (0.0, 0.0), timeout: float | None = TIMEOUT,
    spread: int | None = None,
) -> DataFrame:
    """``(url, depth, html, error)``: each URL fetched by ``fetch(url) -> html``; a failure leaves its error.

    A fetch that takes more than ``timeout`` seconds fails (its thread is left
    behind; None: no limit).  Between fetches a task waits a random time within
    ``polite`` (POLITE is a considerate choice for sites of others).  The URLs are
    spread over ``spread`` tasks, by default one a core.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url, depth in zip(batch["url"], batch["depth"]):
                try:
                    html, error = with_retry(lambda u=url: _within(fetch, u, timeout), attempts), None
                except Exception as e:  # noqa: BLE001
                    html, error = None, f"{type(e).__name__}: {e}"
                out.append((url, depth, html, error))
                if polite[1]:
                    time.sleep(random.uniform(*polite))
            yield pd.DataFrame(out, columns=FETCHED.names).astype({"depth": "int32"})

    many = spread or urls.sparkSession.sparkContext.defaultParallelism
    return urls.select("url", "depth").repartition(many, "url").mapInPandas(run, FETCHED)


def page_links(pages: DataFrame) -> DataFrame:
    """``(url, depth, link)``: normalised links of fetched pages that lead to pages of the same site."""
    found = pages.filter("html is not null").select("url", "depth", F.explode(F.array_distinct(all_hrefs(F.col("html")))).alias("href"))
    whole = found.select("url", "depth", absolute_url("href", "url").alias("full")).filter("full is not null")
    kept = whole.filter(is_internal(F.col("full"), F.col("url")) & is_page_url(F.col("full")))
    return kept.select("url", "depth", normalize_url(F.col("full")).alias("link")).distinct()


def crawl(seeds: DataFrame, fetch: Callable[[str], str], max_depth: int = MAX_DEPTH, **options) -> DataFrame:
    """``(url, depth, html, error)`` of every page reached from the seeds within ``max_depth`` links.

    One round per depth (at most ``max_depth`` + 1): the frontier is fetched, its
    links are extracted, those seen before are dropped by an anti join.  Pages
    that fail are kept with their error and not tried again.
    """
    frontier = materialised(seeds.select(normalize_url(F.col("url")).alias("url"), F.lit(0).alias("depth")).distinct())
    visited = None
    for depth in range(max_depth + 1):
        got = materialised(fetch_pages(frontier, fetch, **options))
        visited = got if visited is None else visited.unionByName(got)
        if depth == max_depth:
            break
        links = page_links(got).select(F.col("link").alias("url")).distinct()
        frontier = materialised(links.join(visited.select("url"), "url", "left_anti").select("url", F.lit(depth + 1).alias("depth")))
        if frontier.isEmpty():
            break
    return visited


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``(url, depth)``: nodes reached from the seeds over ``(src, dst)`` edges, with their least depth."""
    frontier = seeds.select("url", F.lit(0).alias("depth")).filter("url is not null").distinct()
    visited = frontier = materialised(frontier)
    pairs = materialised(edges.select("src", "dst").filter("src is not null and dst is not null and src <> dst").distinct())
    for depth in range(1, max_depth + 1):
        step = pairs.join(frontier, pairs["src"] == frontier["url"], "left_semi").select(F.col("dst").alias("url")).distinct()
        frontier = materialised(step.join(visited.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited
