"""Problem 8: encoding texts with a public byte-level BPE tokenizer.

The merges run in Spark's higher-order functions: a word is an array of hex
pieces (one per byte at first) with the ranks of its adjacent pairs, the first
pair of the lowest rank is merged, and the fold ends when no pair has a rank.
Ranks come from a literal map, split into buckets because a lookup in a Spark map
is a linear scan.  A long word is encoded in overlapping windows and joined at
tokens that two windows share, which gives the same tokens as the whole word.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitelode.session import materialised

#: Where the public vocabularies lie; a parameter of every function.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text before the merges (fixed value of the vocabulary); ``(?U)``
#: gives Java's ``\\s`` the Unicode meaning.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that are resolved from a literal dictionary: a documented bound.
HOT_WORDS = 16_384
#: Bytes of a window of a long word, and bytes that a window shares with the next; the longest token has 128.
WINDOW, OVERLAP = 768, 256


@lru_cache(maxsize=4)
def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes -> rank (the token's id) of a tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _bucketed(entries: dict[str, object], kind: str, per_bucket: int = 4) -> tuple[Column, int]:
    """A literal array of small maps, and its length; key k lies in map crc32(k) % length."""
    n = max(1, len(entries) // per_bucket)
    buckets: list[dict] = [{} for _ in range(n)]
    for key, value in entries.items():
        buckets[zlib.crc32(key.encode()) % n][key] = value
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=True)), f"array<map<string,{kind}>>"), n


def _lookup(table: tuple[Column, int], key: Column) -> Column:
    """The value of ``key``, null where there is none."""
    buckets, n = table
    return F.try_element_at(F.get(buckets, F.pmod(F.crc32(key.cast("binary")), F.lit(n)).cast("int")), key)


def rank_table(path: str = VOCABULARY) -> tuple[Column, int]:
    """The literal rank map of a vocabulary, keyed by a token's bytes in hex."""
    return _bucketed({k.hex().upper(): v for k, v in load_ranks(path).items()}, "int")


def token_table(path: str = VOCABULARY) -> Column:
    """The literal array id -> token bytes in hex."""
    ranks = load_ranks(path)
    tokens = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token.hex().upper()
    return F.from_json(F.lit(json.dumps(tokens)), "array<string>")


def words_of(text: Column) -> Column:
    """The words that the vocabulary's pattern splits a text into, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def encode_bytes(code: Column, path: str = VOCABULARY) -> Column:
    """The token ids of a run of bytes (hex), by a fold of ranked merges.

    Each step merges the first pair of the lowest rank, as the vocabulary's own
    rule does, and looks up the ranks of the two pairs that it makes.
    """
    table = rank_table(path)
    none = F.lit(2**31 - 1)
    rank = lambda x, y: F.coalesce(_lookup(table, F.concat(x, y)), none)
    size = (F.length(code) / 2).cast("int")
    single = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(code, i * 2 + 1, F.lit(2)))
    pairs = F.when(size > 1, F.transform(F.sequence(F.lit(0), size - 2), lambda i: rank(
        F.substring(code, i * 2 + 1, F.lit(2)), F.substring(code, i * 2 + 3, F.lit(2))
    ))).otherwise(F.array().cast("array<int>"))

    def merged(state: Column, at: Column) -> Column:
        """``at`` counts from 1: pieces at and at + 1 become one."""
        pieces, ranks = state["pieces"], state["ranks"]
        n = F.size(pieces)
        key = F.concat(F.get(pieces, at - 1), F.get(pieces, at))
        before = F.when(at > 1, F.array(rank(F.get(pieces, at - 2), key))).otherwise(F.array().cast("array<int>"))
        after = F.when(at + 1 < n, F.array(rank(key, F.get(pieces, at + 1)))).otherwise(F.array().cast("array<int>"))
        return F.struct(
            F.concat(F.slice(pieces, F.lit(1), at - 1), F.array(key), F.slice(pieces, at + 2, n)).alias("pieces"),
            F.concat(F.slice(ranks, F.lit(1), F.greatest(at - 2, F.lit(0))), before, after, F.slice(ranks, at + 2, n)).alias("ranks"),
        )

    def step(state: Column, _: Column) -> Column:
        low = F.array_min(state["ranks"])
        # The state passes a lambda, so that each of its parts is computed once.
        once = F.transform(
            F.array(F.array_position(state["ranks"], low).cast("int")), lambda at: merged(state, at)
        )[0]
        return F.when(low.isNull() | (low == none), state).otherwise(once)

    start = F.struct(single.alias("pieces"), pairs.alias("ranks"))
    end = F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), start, step)["pieces"]
    return F.transform(end, lambda p: _lookup(table, p))


def encode_word(word: Column, path: str = VOCABULARY) -> Column:
    """The token ids of one word, as one window."""
    return encode_bytes(F.hex(F.encode(word, "UTF-8")), path)


def _windows(code: Column, window: int, overlap: int) -> Column:
    """``(begin, code)`` of the overlapping windows of a run of bytes (hex), the first at byte 0."""
    step = window - overlap
    size = (F.length(code) / 2).cast("int")
    last = F.greatest(F.ceil((size - overlap) / step).cast("int") - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct((i * step).alias("begin"), F.substring(code, i * step * 2 + 1, F.lit(window * 2)).alias("code")),
    )


def _spans(begin: Column, ids: Column, sizes: Column) -> Column:
    """``(at, id)`` of the tokens of a window, at the byte where each begins."""
    ends = F.aggregate(
        F.sequence(F.lit(0), F.size(ids) - 1),
        F.array(begin.cast("int")),
        lambda out, i: F.concat(out, F.array(F.element_at(out, -1) + F.get(sizes, F.get(ids, i)))),
    )
    return F.zip_with(F.slice(ends, F.lit(1), F.size(ids)), ids, lambda at, i: F.struct(at.alias("at"), i.alias("id")))


def encode_distinct(words: DataFrame, path: str = VOCABULARY, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """``words``, a table of distinct ``word``, with the token ids of each in ``ids``.

    Words of at most ``window`` bytes are encoded as one.  A longer word is cut
    into windows that overlap, each is encoded by itself, and the parts are
    joined at the first token that both windows have at the same bytes: a row of
    tokens is the encoding of its bytes exactly if each two neighbours are, and
    every two neighbours then come from one window.  A word with two windows that
    share no token (none is known) is encoded as a whole.
    """
    spread = max(8, 2 * words.sparkSession.sparkContext.defaultParallelism)
    size = F.octet_length("word")
    whole = words.filter(size <= window).repartition(spread, "word").withColumn("ids", encode_word(F.col("word"), path))
    long = words.filter(size > window)
    if long.isEmpty():
        return materialised(whole)
    long = materialised(long.select("*", F.xxhash64("word").alias("_key"), F.md5("word").alias("_more")))
    by_rank = sorted((rank, len(token)) for token, rank in load_ranks(path).items())
    lengths = dict(by_rank)
    sizes = F.from_json(F.lit(json.dumps([lengths.get(i, 0) for i in range(by_rank[-1][0] + 1)])), "array<int>")
    parts = long.select("_key", "_more", F.inline(_windows(F.hex(F.encode("word", "UTF-8")), window, overlap)))
    codes = parts.select("code").distinct().repartition(spread, "code")
    coded = materialised(codes.withColumn("ids", encode_bytes(F.col("code"), path)))
    spans = parts.join(coded, "code").select("_key", "_more", "begin", _spans(F.col("begin"), F.col("ids"), sizes).alias("tokens"))
    own = Window.partitionBy("_key", "_more").orderBy("begin")
    shared = F.array_min(F.transform(F.array_intersect("tokens", F.lead("tokens").over(own)), lambda t: t["at"]))
    cut = spans.select("_key", "_more", "begin", "tokens", shared.alias("end"), F.row_number().over(own).alias("n"), F.count("*").over(
        Window.partitionBy("_key", "_more")).alias("of"))
    cut = cut.withColumn("start", F.lag("end").over(own))
    inside = F.filter("tokens", lambda t: (t["at"] >= F.coalesce("start", F.lit(0))) & (F.col("end").isNull() | (t["at"] < F.col("end"))))
    joined = cut.groupBy("_key", "_more").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("begin", F.transform(inside, lambda t: t["id"]).alias("ids")))), lambda x: x["ids"])).alias("ids"),
        F.bool_and((F.col("n") == F.col("of")) | F.col("end").isNotNull()).alias("whole"),
    )
    made = materialised(long.join(joined, ["_key", "_more"]))
    good = made.filter("whole").select(*words.columns, "ids")
    rest = made.filter("not whole").select(*words.columns)
    every = whole.unionByName(good)
    if not rest.isEmpty():
        every = every.unionByName(rest.withColumn("ids", encode_word(F.col("word"), path)))
    return materialised(every)


def decode_ids(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of token ids: their binary pieces concatenated, read as UTF-8."""
    tokens = token_table(path)
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(tokens, i)), "")), "UTF-8")


def encode_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str = VOCABULARY,
    hot_words: int = HOT_WORDS,
) -> DataFrame:
    """``(doc_id, ids)``: the token ids of each row's text, without special tokens.

    Every distinct word is encoded once (:func:`encode_distinct`).  The most
    frequent words (nearly all tokens of a corpus), at most ``hot_words``, go into
    a literal dictionary and are resolved inside each row without a shuffle; the
    rest, none of them frequent, is joined by word, and only texts that have such
    words are put together by key.

    Null and empty text: an empty list.  Repeated rows: one row each.  Other
    columns are ignored.  An empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = materialised(
        own.select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    )
    encoded = encode_distinct(counts, path)
    least = _frequent(counts, hot_words)
    hot = encoded.filter(F.col("n") >= least).select("word", "ids").collect() if least else []
    table = _bucketed({r["word"]: r["ids"] for r in hot}, "array<int>")
    # Texts are told apart by two hashes, equal ones are put together once.
    split = own.select("doc_id", F.md5("text").alias("key"), words_of(F.col("text")).alias("words"))
    found = F.transform("words", lambda w: F.transform(F.array(_lookup(table, w)), lambda i: F.struct(
        i.alias("ids"), F.when(i.isNull(), w).alias("word")))[0])
    known = materialised(split.select("doc_id", "key", found.alias("found")))
    unknown = F.exists("found", lambda x: x["word"].isNotNull())
    empty = F.array().cast("array<int>")
    done = known.filter(F.col("found").isNull() | ~unknown).select(
        "doc_id", F.when(F.col("found").isNull(), empty).otherwise(F.flatten(F.transform("found", lambda x: x["ids"]))).alias("ids")
    )
    part = known.filter(unknown)
    rest = (
        part.select("key", F.posexplode("found").alias("pos", "x"))
        .filter("x.word is not null")
        .select("key", "pos", F.col("x.word").alias("word"))
        .distinct()
        .join(encoded.filter(F.col("n") < least).select("word", "ids") if least else encoded.select("word", "ids"), "word")
        .groupBy("key")
        .agg(F.collect_list(F.struct("pos", "ids")).alias("rest"))
    )
    numbered = F.transform("found", lambda x, i: F.struct(i.alias("pos"), x["ids"].alias("ids")))
    every = F.array_sort(F.concat(F.filter(numbered, lambda x: x["ids"].isNotNull()), F.col("rest")))
    mended = part.join(rest, "key").select("doc_id", F.flatten(F.transform(every, lambda x: x["ids"])).alias("ids"))
    return done.unionByName(mended)


def _frequent(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words reach, 0 where there is none.

    Counts are put into classes a sixteenth of a doubling wide, so that what
    comes to the driver is bounded.
    """
    kind = F.floor(16 * F.log2("n"))
    sizes = counts.groupBy(kind.alias("kind")).agg(F.count("*").alias("c"), F.min("n").alias("least")).orderBy(F.desc("kind")).collect()
    total, least = 0, 0
    for r in sizes:
        total += r["c"]
        if total > most:
            break
        least = r["least"]
    return least


def decode_texts(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, text)`` of rows of token ids; a null list gives null, an empty one the empty text."""
    return encoded.select(F.col(id_col).alias("doc_id"), decode_ids(F.col(ids_col), path).alias("text"))
