"""Distinct rows, and keep-latest upserts on plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitelode.session import broadcast_if_small


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """``df.distinct()`` where equal rows share ``key``; moves only repeated keys' rows.

    The keys alone are shuffled to find those that come again; rows whose key is
    unique (or null: such rows are compared whole) stay where they are, so wide
    texts are not shuffled.  An empty table gives an empty result.
    """
    again = df.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(key)
    again = broadcast_if_small(again, 24)
    alone = df.filter(F.col(key).isNotNull()).join(again, key, "left_anti")
    more = df.join(again, key, "left_semi").unionByName(df.filter(F.col(key).isNull())).distinct()
    return alone.select(df.columns).unionByName(more.select(df.columns))


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: list[str],
    order: list[str],
    keep_from_existing: list[str] | None = None,
) -> DataFrame:
    """``existing`` with ``incoming`` merged in: one row per key, the incoming one wins.

    Among incoming rows of one key the greatest by ``order`` (descending, nulls
    last) wins.  Columns in ``keep_from_existing`` (an id, a creation time) are
    carried over from the existing row where there is one.  Null keys are equal
    to each other.  The output has the columns of ``existing``; the result must
    be written to a new place, Spark cannot overwrite what it reads.
    """
    keep = keep_from_existing or []
    both = existing.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.desc("_src"), *[F.col(c).desc_nulls_last() for c in order])
    whole = Window.partitionBy(*keys)
    for c in keep:
        old = F.max(F.when(F.col("_src") == 0, F.col(c))).over(whole)
        both = both.withColumn(f"_old_{c}", old)
    best = both.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1")
    return best.select(
        *[F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in existing.columns]
    )


def replace_by_key(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``existing`` without the rows of keys that ``incoming`` has, plus ``incoming``."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").select(existing.columns).unionByName(
        incoming.select(existing.columns)
    )


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order`` (descending, nulls last)."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def not_yet(df: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key has no row in ``done``: incremental pickup by an anti join."""
    there = done.select(F.col(done_key or key).alias(key)).distinct()
    return df.join(there, key, "left_anti")
