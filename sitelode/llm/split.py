"""Problem 3: splitting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelode.llm.arrow import per_distinct

LIMIT, OVERLAP = 1_000, 50
#: Strengths of the boundary after a segment, weakest first.
HARD, WORD, SENTENCE, LINE, PARAGRAPH = range(5)

_LINE = re.compile(r"[^\n]*\n+|[^\n]+\Z")
_SENTENCE = re.compile(r"""[.!?…]+["'”’»)\]]*\s+|[。！？]+[」』”）]*\s*""")
_WORD = re.compile(r"\S*\s+|\S+\Z")


def _cuts(text: str, most: int) -> list[tuple[str, int]]:
    """Atomic segments of at most ``most`` characters and the strength behind each."""
    out: list[tuple[str, int]] = []
    for line in _LINE.findall(text):
        end = PARAGRAPH if line.endswith("\n\n") else LINE
        at, parts = 0, []
        for m in _SENTENCE.finditer(line):
            parts.append(line[at : m.end()])
            at = m.end()
        if at < len(line):
            parts.append(line[at:])
        for i, part in enumerate(parts):
            after = end if i == len(parts) - 1 else SENTENCE
            if len(part) <= most:
                out.append((part, after))
                continue
            words = _WORD.findall(part)
            for j, word in enumerate(words):
                last = after if j == len(words) - 1 else WORD
                pieces = [word[k : k + most] for k in range(0, len(word), most)]
                out += [(p, HARD) for p in pieces[:-1]]
                out.append((pieces[-1], last))
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """Pieces of ``text``, each of at most ``limit`` characters.

    Agglomerative: the atomic segments (sentences; words of a sentence that is
    too long; slices of a word that is too long) are neighbours in a list, the
    boundaries between them lie in a heap, and the weakest one (slice, word,
    sentence, line, paragraph; then the smallest sum, then the leftmost) is
    removed while the merged segment and the overlap still fit.  Every piece
    but the first begins with the last ``overlap`` characters of the piece
    before, so the text is ``pieces[0] + "".join(p[overlap:] for p in rest)``.

    A text within the limit, the empty one too, is its own only piece.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half of the limit")
    if len(text) <= limit:
        return [text]
    room = limit - overlap
    atoms = _cuts(text, room)
    n = len(atoms)
    size = [len(a) for a, _ in atoms]
    after = [s for _, s in atoms]
    last = list(range(n))  # the last atom of the segment that begins at i
    nxt = list(range(1, n + 1))
    prev = list(range(-1, n - 1))
    alive = [True] * n

    def fits(i: int, j: int) -> bool:
        return size[i] + size[j] <= (limit if i == 0 else room)

    heap = [(after[i], size[i] + size[i + 1], i, size[i], size[i + 1]) for i in range(n - 1) if fits(i, i + 1)]
    heapq.heapify(heap)
    while heap:
        _, _, i, si, sj = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or size[i] != si or size[j] != sj:
            continue  # an older state of this boundary
        size[i] += size[j]
        after[i], last[i], alive[j] = after[j], last[j], False
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if fits(i, nxt[i]):
                heapq.heappush(heap, (after[i], size[i] + size[nxt[i]], i, size[i], size[nxt[i]]))
        if prev[i] >= 0 and fits(prev[i], i):
            p = prev[i]
            heapq.heappush(heap, (after[p], size[p] + size[i], p, size[p], size[i]))
    # A first piece shorter than the overlap always fits with its successor.
    while size[0] < overlap and nxt[0] < n:
        j = nxt[0]
        size[0] += size[j]
        last[0], nxt[0] = last[j], nxt[j]
    pieces: list[str] = []
    i = 0
    while i < n:
        own = "".join(a for a, _ in atoms[i : last[i] + 1])
        pieces.append(pieces[-1][-overlap:] + own if pieces and overlap else own)
        i = nxt[i]
    return pieces


def split_column(limit: int = LIMIT, overlap: int = OVERLAP):
    """A pandas UDF: text -> array of pieces, each distinct text split once."""

    @F.pandas_udf("array<string>")
    def pieces(text: pd.Series) -> pd.Series:
        return pd.Series(per_distinct(text, lambda t: split_text(t, limit, overlap)), dtype=object)

    # Else a filter on the number of pieces would run the UDF a second time.
    return pieces.asNondeterministic()


def split_rows(
    df: DataFrame, id_col: str = "id", text_col: str = "content", limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """``(id, piece_no, piece, n_pieces)``: the pieces of every row's text, in order from 0.

    Row-local, no shuffle.  Texts within the limit never leave the JVM: only
    longer ones go through the Arrow UDF.  Null text: no row.  Empty text: one
    empty piece.  Repeated rows: repeated pieces.  Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    short = F.char_length("text") <= limit
    pieces = own.filter(~short).select("id", split_column(limit, overlap)("text").alias("pieces"))
    whole = own.filter(short).select("id", F.array("text").alias("pieces"))
    return whole.unionByName(pieces).select(
        "id", F.size("pieces").alias("n_pieces"), F.posexplode("pieces").alias("piece_no", "piece")
    ).select("id", "piece_no", "piece", "n_pieces")


def oversized(df: DataFrame, id_col: str = "id", text_col: str = "content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(id, n_pieces)`` of the distinct rows that were cut into more than one piece."""
    return (
        split_rows(df, id_col, text_col, limit, overlap)
        .filter("piece_no = 0 and n_pieces > 1")
        .select("id", "n_pieces")
        .distinct()
    )
