"""Command line: ``python -m sitelode pipeline|ask ...``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelode.functions.urls import page_type
from sitelode.operators.embedding import HashEmbedder
from sitelode.plans.pipeline import answer_questions, build_site
from sitelode.schemas import RAW_PAGES
from sitelode.session import build_session
from sitelode.sources.dumps import read_dumps
from sitelode.sources.store import Store

log = logging.getLogger("sitelode")


def _raw(dump: DataFrame) -> DataFrame:
    """Pages of a dump in the layout of the table ``pages``; what a dump hasn't is null."""
    own = {
        "id": F.xxhash64("url"), "url": F.col("url"), "content": F.col("content"), "page_type": page_type(F.col("url")),
        "scraped_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    }
    return dump.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_PAGES])


def main(argv: list[str] | None = None) -> int:
    """Build a store from a dump of scraped pages, or ask a built store a question."""
    parser = argparse.ArgumentParser(prog="sitelode")
    parser.add_argument("--store", required=True, help="folder of the tables")
    parser.add_argument("--dim", type=int, default=384, help="length of the vectors")
    jobs = parser.add_subparsers(dest="job", required=True)
    build = jobs.add_parser("pipeline", help="clean, chunk and embed scraped pages")
    build.add_argument("--dump", required=True, help="scrape dump files")
    build.add_argument("--force", action="store_true", help="chunk all given pages anew")
    ask = jobs.add_parser("ask", help="answer a question from the store")
    ask.add_argument("question")
    given = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = build_session()
    store, embedder = Store(spark, given.store), HashEmbedder(given.dim)
    if given.job == "pipeline":
        log.info("building %s from %s", given.store, given.dump)
        log.info("%d chunks", build_site(store, _raw(read_dumps(spark, given.dump)), embedder, given.force).count())
        return 0
    chunks, pages = store.read("chunks"), store.read("cleaned_pages")
    if chunks is None or pages is None:
        log.error("no tables in %s", given.store)
        return 1
    asked = spark.createDataFrame([(1, given.question)], "query_id long, question string")
    print(answer_questions(asked, chunks, pages, embedder).first()["answer"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
