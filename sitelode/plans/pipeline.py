"""Whole pipelines: raw pages to cleaned pages, chunks, embeddings and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelode.functions import contacts, text, urls
from sitelode.functions.html import extract
from sitelode.operators.answers import answers
from sitelode.operators.chunking import chunk_pages
from sitelode.operators.embedding import Embedder, embed, embed_missing, load_embeddings
from sitelode.operators.search import retrieve
from sitelode.sources.store import Store, images_array


def scrape(fetched: DataFrame) -> DataFrame:
    """Raw pages of fetched HTML ``(url, html)``, in the layout of the table ``pages``; failed pages are left out."""
    rows = fetched.filter("html is not null").select("url", extract("html").alias("f"))
    return rows.select(
        F.xxhash64("url").alias("id"), "url", "f.title", "f.meta_desc", "f.content",
        F.to_json("f.links").alias("links"), F.to_json("f.images").alias("images"), urls.page_type(F.col("url")).alias("page_type"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("scraped_at"),
    )


def clean(pages: DataFrame, now: str | None = None) -> DataFrame:
    """Cleaned pages of raw ones: encoding, markup, boilerplate, contacts; row-local, one pass.

    Null contents count as empty, null titles and descriptions as empty, a null
    type as generic; broken image lists are empty.
    """
    at = F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    fixed = pages.withColumn("_fixed", text.fix_encoding(F.col("content")))
    return fixed.select(
        "id", "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("meta_desc", F.lit("")).alias("meta_desc"),
        text.remove_tiny_lines(text.clean_text(F.col("_fixed"))).alias("content"),
        F.coalesce("page_type", F.lit("generic")).alias("page_type"), "scraped_at",
        contacts.first_email(F.col("_fixed")).alias("email"), contacts.phone(F.col("_fixed")).alias("phone"),
        F.to_json(images_array(F.col("images"))).alias("images"), at.alias("created_at"), at.alias("updated_at"),
    )


def build_site(store: Store, raw: DataFrame, embedder: Embedder, force: bool = False) -> DataFrame:
    """Save raw pages, clean, chunk what has no chunks yet or changed, embed what has no vector; returns the chunks.

    The chunks of a page whose cleaned content differs from the one before are
    made anew, with ``force`` those of all given pages.
    """
    store.save_pages(raw)
    before = store.read("cleaned_pages")
    cleaned = store.save_cleaned(clean(raw))
    old = store.read("chunks")
    if before is not None and old is not None:
        was = before.select("id", F.md5("content").alias("_was"))
        changed = cleaned.join(was, "id").filter(~F.md5("content").eqNullSafe(F.col("_was"))).select(F.col("id").alias("page_id"))
        old = old.join(changed, "page_id", "left_anti").select(old.columns)
    todo = cleaned.join(raw.select("url").distinct(), "url", "left_semi") if force else cleaned
    made = chunk_pages(todo, embedder, None if force else old)
    rows = made.select(
        F.xxhash64("page_id", "chunk_index").alias("id"), "page_id", "section", "chunk_index", "content", "embedding",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )
    full = embed_missing(rows, embedder)
    if force or old is None:
        return store.save_chunks(full, replace_existing=force)
    return store.write("chunks", old.unionByName(full))


def answer_questions(
    questions: DataFrame, chunks: DataFrame, pages: DataFrame, embedder: Embedder, histories: DataFrame | None = None, **options
) -> DataFrame:
    """``(query_id, question, answer)`` for a table of ``(query_id, question)``."""
    asked = questions.select("query_id", embed(F.col("question"), embedder).alias("v"))
    hits = retrieve(questions, chunks, pages, asked, load_embeddings(chunks), **options)
    return answers(questions, hits, histories, titles=False)
