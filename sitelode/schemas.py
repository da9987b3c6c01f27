"""Explicit schemas of the corpus tables; nothing is inferred from data."""

from pyspark.sql import types as T


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols])


_S, _L, _I, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampNTZType()

#: Records as the scraper stores them: links and images hold JSON arrays.
RAW_PAGES = _struct(
    ("id", _L), ("url", _S), ("title", _S), ("meta_desc", _S), ("content", _S),
    ("links", _S), ("images", _S), ("page_type", _S), ("scraped_at", _S),
)

#: One row per kept page; (url, page_type) is the key.
CLEANED_PAGES = _struct(
    ("id", _L), ("url", _S), ("title", _S), ("meta_desc", _S), ("content", _S),
    ("page_type", _S), ("scraped_at", _S), ("email", _S), ("phone", _S),
    ("images", _S), ("created_at", _S), ("updated_at", _S),
)

#: Pieces of cleaned pages; embedding is a JSON array or null.
CHUNKS = _struct(
    ("id", _L), ("page_id", _L), ("section", _S), ("chunk_index", _I),
    ("content", _S), ("embedding", _S), ("created_at", _S),
)

#: Retrieval hits, one row per (query_id, rank).
HITS = _struct(
    ("query_id", _L), ("rank", _I), ("chunk_id", _L), ("title", _S), ("url", _S),
    ("page_type", _S), ("text", _S), ("score", T.DoubleType()),
)

#: What a fetcher returns for one URL.
FETCHED = _struct(("url", _S), ("depth", _I), ("html", _S), ("error", _S))

#: What the HTML extractor returns for one page.
EXTRACTED = _struct(
    ("title", _S), ("meta_desc", _S), ("content", _S),
    ("links", T.ArrayType(_S)), ("images", T.ArrayType(_S)),
)
