"""Problem 10: texts cut off by field limits or on the way."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitelode.llm.arrow import per_distinct
from sitelode.operators.dedupe import distinct_rows
from sitelode.session import broadcast_if_small, materialised

#: A length is a limit where at least this many texts of a source have it,
LEAST = 5
#: and so many standard deviations more than lengths near it (within NEAR of it) let expect.
PEAK, NEAR = 5.0, 40

#: Marks of omission at the end of a text (fixed values).
MARK = r"\s*(?:\[(?:\.\.\.|…|more|truncated|cut)\]|\((?:\.\.\.|…|more|continued|truncated)\)|…|\.\.\.+)\s*$"

_MARK = re.compile(MARK, re.I)
_DONE = re.compile(r"[.!?。！？।॥。؟…]['\"”’»›)\]」』）]*$")
_SENTENCE = re.compile(r"[.!?。！？।؟](?:['\"”’»)\]」』）]|\s|$)|[。！？।]")
_TAIL_SYMBOLS = re.compile(r"[\s\U0001f000-\U0001faff☀-➿️‍\U0001f3fb-\U0001f3ff]+$")
_BULLET = re.compile(r"[-*•·‣–]\s+|\d+[.)]\s+")
_CODE = re.compile(r"[{};]|</?\w+|=>|\)\s*$|^\s*(?:for|if|while|def|return|import|var|let|const)\b.*[({=]")
_URL = re.compile(r"(?:https?://|www\.)\S+$")
_SIGNED = re.compile(r"[—–-]\s?\w[\w’'-]*(?: [\w’'-]+)*(?:, \w[\w’'-]*(?: [\w’'-]+)*)?$")
_ROLE = re.compile(r"(?:head|director|editor|manager|chief|founder|owner|professor|dr)\b.{0,40}, \w[\w’'-]+$|(?:head|director|editor|manager|chief) of [\w’' -]+$", re.I)
_TAGS = re.compile(r"(?:#\w[\w-]*\s*)+$")
_FIELD = re.compile(r"[^\W\d_][\w/-]*(?: [\w/-]+){0,2}:\s+\S+(?: \S+){0,4}$")
_SPEAKER = re.compile(r"(?:q|a|agent|customer|user|client|visitor|assistant|support|question|answer)\s?:", re.I)
_CODE_NUMBER = re.compile(r"SKU\s+[A-Z]+-\d{5}$")

COMPLETE, CUT, OPEN = 0, 1, 2


def _shape(text: str) -> str:
    """A short text with letters and digits masked: the form of an entry's last part."""
    return re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", "a", text))


def judge_end(text: str) -> int:
    """How a text ends: COMPLETE, CUT, or OPEN (complete by its looks, but also what a cut may leave).

    A mark of omission is taken off first.  Ends of sentences, with closing
    quotes and symbols behind them, are complete; signatures, links, tags, code
    with its brackets closed and texts without any sentence are too.  Entries of
    lists and sheets are compared with the entries before them.  Other ends are
    cuts.
    """
    body = text.strip()
    if not body:
        return COMPLETE
    marked = bool(_MARK.search(body)) and bool(_SENTENCE.search(body) or len(body) > 40)
    if marked:
        body = _MARK.sub("", body)
        if not body:
            return COMPLETE
    bare = _TAIL_SYMBOLS.sub("", body)
    if not bare:
        return COMPLETE
    if _DONE.search(bare):
        return COMPLETE
    lines = [x.strip() for x in re.split(r"[\n\r]+", bare)]
    last, before = lines[-1], [x for x in lines[:-1] if x]
    sentences = bool(_SENTENCE.search(bare))
    if bare.endswith("�") and len(bare) > 20:
        return CUT
    if _BULLET.match(last) or (last in ("-", "*", "•", "·") and before):
        entry = _BULLET.sub("", last, count=1)
        if last in ("-", "*", "•", "·") or not entry:
            return CUT
        peers = [_BULLET.sub("", x, count=1) for x in before if _BULLET.match(x)]
        if not peers:
            return CUT if marked or "," not in entry and sentences else COMPLETE
        tail = _shape(entry.rsplit(",", 1)[1]) if "," in entry else None
        known = {_shape(x.rsplit(",", 1)[1]) if "," in x else None for x in peers} | {" a", " $0", " 0 a a"}
        if marked or (tail not in known and (tail is not None or None not in known)):
            return CUT
        if tail is None and None not in {_shape(x.rsplit(",", 1)[1]) if "," in x else None for x in peers}:
            return CUT
        if tail == " 0 a a":
            words = entry.rsplit(" ", 1)[-1]
            return COMPLETE if any(x.endswith(" " + words) for x in peers) or words == "stock" else CUT
        return OPEN
    if marked:
        return CUT
    if _URL.search(last):
        return OPEN
    if _TAGS.fullmatch(last):
        return OPEN
    if last.startswith("SKU"):
        return COMPLETE if _CODE_NUMBER.match(last) else CUT
    if _SPEAKER.match(last):
        return CUT
    if _FIELD.match(last):
        return OPEN if re.search(r"\d$|cm$|kg$|\w$", last) and not re.search(r"\bx$|:\s*$", last) else CUT
    if any(c in last for c in "{}<>;") and re.search(r"[{}]|</?\w|;\s*$|\w\(", last) and not re.search(r"[^\W\d_]{3,}(?: [^\W\d_]+){7,}", last):
        opened = sum(last.count(c) for c in "({[") - sum(last.count(c) for c in ")}]")
        return COMPLETE if opened <= 0 and re.search(r"[;}>)]$", last) else CUT
    if re.search(r"[;}>]$", last) and not sentences:
        return COMPLETE
    if _SIGNED.match(last) and before:
        return COMPLETE
    if _ROLE.match(last) and before:
        return COMPLETE
    if not sentences:
        # No sentence ends in the text: a title, a price, a short note, unless a sentence has begun.
        words = bare.split()
        if len(words) <= 3 or len(bare) < 28 or not re.search(r"[^\W\d_]", bare) or len(set(words)) == 1:
            return OPEN
        starts = [i for i, w in enumerate(words) if i and w[0].isupper() and not words[i - 1][-1:] in ",:;"]
        later = "\n" in bare or (len(starts) >= 2 and len(words) >= 5) or len(words) >= 12
        return CUT if later else OPEN
    return CUT


def _count(text: Column, part: str) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))


def lengths(text: Column) -> dict[str, Column]:
    """The lengths of a text as the stores that may have held it count them."""
    chars = F.char_length(text)
    quotes, slashes = _count(text, '"'), _count(text, "\\")
    lf, cr, tabs, crlf = _count(text, "\n"), _count(text, "\r"), _count(text, "\t"), _count(text, "\r\n")
    amp, lt, gt, apos = _count(text, "&"), _count(text, "<"), _count(text, ">"), _count(text, "'")
    utf16 = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    other = F.char_length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    measures = {
        "chars": chars,
        "utf8": F.octet_length(text),
        "utf16": utf16,
        "html": chars + 4 * amp + 3 * lt + 3 * gt + 5 * quotes,
        "html_all": chars + 4 * amp + 3 * lt + 3 * gt + 5 * quotes + 4 * apos,
        "html_tags": chars + 4 * amp + 3 * lt + 3 * gt,
        "json": chars + quotes + slashes + lf + cr + tabs,
        "json_ascii": utf16 + quotes + slashes + lf + cr + tabs + 5 * (other + (utf16 - chars)),
        "utf8_json": F.octet_length(text) + quotes + slashes + lf + cr + tabs,
        "crlf": chars + lf - crlf,
        "lf": chars - crlf,
        "utf8_crlf": F.octet_length(text) + lf - crlf,
    }
    return {k: v.cast("long") for k, v in measures.items()}


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(doc_id, source, measure, length)`` of every text, without a mark at its end."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    bare = own.filter("text is not null").withColumn("bare", F.regexp_replace("text", "(?i)" + MARK, ""))
    each = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("length")) for k, v in lengths(F.col("bare")).items()])
    return bare.select("doc_id", "source", F.inline(each))


def hidden_limits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(source, measure, length, n)``: lengths that too many texts of a source share.

    Each text is measured as stores with other encodings, entity escaping, JSON
    escaping and line ends would; texts are counted by (source, measure, length)
    map-side, equal texts of a source once.  A length is a limit where at least LEAST texts have it, and PEAK
    standard deviations more than the lengths near it let expect.  A byte limit
    also shows as lengths one to three below it, where a character did not fit.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).filter("text is not null")
    keyed = own.select("doc_id", F.xxhash64(F.coalesce("source", F.lit("")), "text").alias("key"))
    again = materialised(keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first"))
    extra = materialised(keyed.join(broadcast_if_small(again, 16), "key").filter("doc_id <> first").select("doc_id"))
    once = own.join(broadcast_if_small(extra, 8), "doc_id", "left_anti")
    counts = _measured(once, "doc_id", "text", "source").groupBy("source", "measure", "length").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source", "measure").orderBy("length")
    wide = by.rangeBetween(-NEAR, NEAR)
    near = counts.withColumn("around", F.sum("n").over(wide) - F.col("n"))
    usual = F.col("around") / (2 * NEAR)
    own = near.filter((F.col("n") >= LEAST) & (F.col("n") - usual >= PEAK * F.sqrt(usual + 1) - 1))
    return own.select("source", "measure", "length", "n")


def truncated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, cut, measure, length)`` of every distinct document.

    ``cut`` says whether the text was cut within a word, sentence, line or list
    entry; ``measure`` and ``length`` name the hidden limit that it reaches, if
    one (the first by name).  An end that no complete text has is a cut anywhere; an end that is
    complete by its looks (the price of a list entry, a link) only where the text
    reaches a limit of its source.

    Null, empty and blank texts are not cut.  A null source has its own limits.
    Repeated rows: once.  Other columns are ignored; an empty table gives an
    empty result.
    """
    own = distinct_rows(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), "doc_id"
    )
    limits = materialised(hidden_limits(own, "doc_id", "text", "source"))

    @F.pandas_udf("int")
    def end(text: pd.Series) -> pd.Series:
        return pd.Series(per_distinct(text, judge_end), dtype="Int32")

    judged = own.select("doc_id", "source", "text", end.asNondeterministic()("text").alias("end"))
    bare = judged.withColumn("bare", F.regexp_replace("text", "(?i)" + MARK, ""))
    each = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("length")) for k, v in lengths(F.col("bare")).items()])
    per_source = broadcast_if_small(
        limits.groupBy(F.coalesce("source", F.lit("")).alias("_s")).agg(F.collect_set(F.struct("measure", "length")).alias("limits")), 4096
    )
    met = F.array_sort(F.array_intersect(each, F.col("limits")))
    return (
        bare.join(per_source, F.coalesce("source", F.lit("")) == F.col("_s"), "left")
        .withColumn("met", F.get(met, F.lit(0)))
        .select(
            "doc_id", "source",
            F.coalesce((F.col("end") == CUT) | ((F.col("end") == OPEN) & F.col("met").isNotNull()), F.lit(False)).alias("cut"),
            "met.measure", "met.length",
        )
    )


def truncated_documents(docs: DataFrame, **columns) -> DataFrame:
    """``(doc_id)`` of the documents that were cut."""
    return truncated(docs, **columns).filter("cut").select("doc_id").distinct()


def source_shares(docs: DataFrame, **columns) -> DataFrame:
    """``(source, n_docs, n_cut, share, at_limit)`` of every source, null included."""
    return (
        truncated(docs, **columns).groupBy("source")
        .agg(F.count("*").alias("n_docs"), F.sum(F.col("cut").cast("long")).alias("n_cut"),
             F.sum((F.col("cut") & F.col("measure").isNotNull()).cast("long")).alias("at_limit"))
        .select("source", "n_docs", "n_cut", (F.col("n_cut") / F.col("n_docs")).alias("share"), "at_limit")
    )
