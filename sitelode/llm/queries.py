"""Queries pN_... over the test tables, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm import body, canonical, leakage, nearest, neardup, repeated, residue, split, tokens, truncation
from sitelode.operators.dedupe import distinct_rows
from sitelode.session import read_table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Titles and contents of pages that are not in the one form."""
    return canonical.respelled(read_table(spark, root, "pages"), ["title", "content"])


def p1_normalised(spark: SparkSession, root: str) -> DataFrame:
    """Every distinct record of pages, title and content in the one form."""
    pages = read_table(spark, root, "pages").select("id", "title", "content")
    return canonical.normalise(distinct_rows(pages, "id"), ["title", "content"])


def p1_titles(spark: SparkSession, root: str) -> DataFrame:
    """Titles of pages that differ in spelling and case only: key, distinct spellings, records."""
    pages = distinct_rows(read_table(spark, root, "pages").select("id", "title"), "id")
    values = canonical.folded_values(pages, "title")
    return values.groupBy("key").agg(F.count("*").alias("spellings"), F.sum("n").alias("records"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Records of pages with template residue, filler or an error message for a text."""
    return residue.residue_records(read_table(spark, root, "pages")).select("id")


def p2_kept(spark: SparkSession, root: str) -> DataFrame:
    """The records of pages that remain without those of p2_found."""
    return residue.without_residue(read_table(spark, root, "pages").select("id", "url", "content"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows of cleaned_pages and chunks that the splitter cuts."""
    parts = [
        split.oversized(read_table(spark, root, t)).select(F.lit(t).alias("tbl"), "id") for t in ("cleaned_pages", "chunks")
    ]
    return parts[0].unionByName(parts[1])


def p3_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of every oversized row of cleaned_pages and chunks."""
    parts = [
        split.split_rows(read_table(spark, root, t).select("id", "content").distinct())
        .filter("n_pieces > 1")
        .select(F.lit(t).alias("tbl"), "id", "piece_no", "piece")
        for t in ("cleaned_pages", "chunks")
    ]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines outside the main body, of records of several lines that are no cases of p2."""
    pages = read_table(spark, root, "pages")
    model = body.fit_from_kept(pages, read_table(spark, root, "cleaned_pages"))
    cases = residue.residue_records(pages).select("id")
    return body.boilerplate_lines(pages, model).join(cases, "id", "left_anti")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of cleaned pages with a similarity of 0.6 over runs of three words."""
    return neardup.duplicate_pairs(read_table(spark, root, "cleaned_pages"), shingle=3, similarity=0.6)


def p5_groups(spark: SparkSession, root: str) -> DataFrame:
    """Class, group and number of links of every cleaned page."""
    return neardup.duplicate_groups(read_table(spark, root, "cleaned_pages"), shingle=3, similarity=0.6)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of chunks of which one is among the five most similar of the other."""
    return nearest.neighbour_pairs(read_table(spark, root, "chunks"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines repeated over a site's records."""
    return repeated.repeated_lines(read_table(spark, root, "pages"), exact=True)


def p7_cleaned(spark: SparkSession, root: str) -> DataFrame:
    """Every record of pages without the near-duplicate lines of its site."""
    return repeated.without_repeated(read_table(spark, root, "pages"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return tokens.encode_texts(read_table(spark, root, "documents"))


def p8_decoded(spark: SparkSession, root: str) -> DataFrame:
    """Every document's text, encoded and decoded again."""
    return tokens.decode_texts(tokens.encode_texts(read_table(spark, root, "documents")))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents and the evaluation items that leaked into them."""
    return leakage.leaks(read_table(spark, root, "documents"), read_table(spark, root, "eval_items"))


def p9_items(spark: SparkSession, root: str) -> DataFrame:
    """Every evaluation item and the number of documents it leaked into."""
    return leakage.leaked_items(read_table(spark, root, "documents"), read_table(spark, root, "eval_items"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncation.truncated_documents(read_table(spark, root, "documents"))


def p10_sources(spark: SparkSession, root: str) -> DataFrame:
    """Documents, cut documents and their share, of each source."""
    return truncation.source_shares(read_table(spark, root, "documents"))


def p10_limits(spark: SparkSession, root: str) -> DataFrame:
    """The hidden storage limits that the lengths of a source's texts show."""
    return truncation.hidden_limits(read_table(spark, root, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_normalised, p1_titles, p2_found, p2_kept, p3_found, p3_pieces, p4_found, p5_found, p5_groups, p6_found, p7_found, p7_cleaned, p8_ids, p8_decoded, p9_found, p9_items, p10_found, p10_sources, p10_limits)
}
