"""Scrape dumps: text files of url, content, blank line and a rule of 50 ``=`` per page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "=" * 50


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """``(url, content)`` of every page in the dump files under ``path``.

    Files are split at the rule, not by lines: a content may hold line ends.
    Spark streams records up to the rule, so no file is read whole.
    """
    rows = spark.read.option("lineSep", RULE).text(path)
    record = F.regexp_replace("value", r"^\s+", "")
    return rows.filter(F.trim(F.regexp_replace("value", r"\s+", "")) != "").select(
        F.trim(F.substring_index(record, "\n", 1)).alias("url"),
        F.regexp_replace(F.regexp_replace(record, r"^[^\n]*\n?", ""), r"\s+$", "").alias("content"),
    )


def write_dumps(pages: DataFrame, path: str) -> None:
    """Append ``(url, content)`` in the dump format, one file per task."""
    record = F.concat(F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n\n" + RULE))
    pages.select(record.alias("value")).write.mode("append").text(path)
