"""Problem 1: one spelling for text that reads the same."""

from __future__ import annotations

import re
import unicodedata as U
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.llm.arrow import per_distinct
from sitelode.operators.dedupe import distinct_rows

#: Letters that look alike, as rows of Latin, Cyrillic, Greek ("-": none).
LOOKALIKES = """
A А Α|B В Β|C С -|E Е Ε|H Н Η|I І Ι|J Ј -|K К Κ|M М Μ|N - Ν|O О Ο|P Р Ρ|S Ѕ -|T Т Τ|X Х Χ|Y У Υ|Z - Ζ
a а α|c с ϲ|d ԁ -|e е ε|h һ -|i і ι|j ј ϳ|k к κ|l ӏ -|m м -|n п η|o о ο|p р ρ|q ԛ -|r г -|s ѕ -|t т τ|u - υ|v ѵ ν|w ԝ ω|x х χ|y у γ|b ь β
"""
#: Pairs above that are alike only in some faces; used to mend a word, never to call it mixed by themselves.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
_PLAIN = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
_ARABIC_LIKE = ("ARABIC", "SYRIAC", "NKO", "MONGOLIAN", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL",
                "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "KHMER", "MYANMAR")


#: Code points with the property Default_Ignorable_Code_Point that aren't of category Cf, as ranges.
IGNORABLE = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164),
             (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF))
#: Characters of category Cf that are seen (number, verse and abbreviation signs).
SEEN = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"
BLANK_BRAILLE = "\u2800"


def _replacement(ch: str) -> str | None:
    """What a character becomes by itself, None where it stays."""
    kind = U.category(ch)
    if ch in "\n\r\t":
        return None
    if kind in ("Zs", "Zl", "Zp"):
        return "\n" if kind in ("Zl", "Zp") else (None if ch == " " else " ")
    if kind == "Cc":
        return "\n" if ch in "\x0b\x0c\x85" else ""
    if kind == "Cf":
        return None if ch in SEEN else ""
    if any(a <= ord(ch) <= b for a, b in IGNORABLE):
        return ""
    if ch == BLANK_BRAILLE:
        return " "
    how = U.decomposition(ch).split(" ")[0]
    if how in _PLAIN:
        return U.normalize("NFKC", ch)
    if how == "<compat>":
        plain = U.normalize("NFKC", ch)
        if U.name(ch, "").startswith(("KANGXI RADICAL", "CJK RADICAL")):
            return plain
        # Ligatures, digraphs and letter-like numerals read as plain letters; signs such as an ellipsis do not.
        if kind[0] == "L" or kind == "Nl":
            return plain if all(U.category(c)[0] in "LM" for c in plain) else None
    return None


class _Single(dict):
    """Code -> replacement of a character, "" where it goes, None where it stays; found when first asked for."""

    def __missing__(self, code: int) -> str | None:
        got = self[code] = "" if code == 0x7F else _replacement(chr(code))
        return got


_SINGLE = _Single()
#: Characters that are looked up; letters of the usual alphabets and CJK ideographs and syllables never change.
_SPECIAL = re.compile(
    "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa9\xab-\xb9\xbb-\xbf\u0130-\u0149\u017f\u01c4-\u01cc\u01f1-\u01f3\u02b0-\u0385\u0387\u03cf-\u03ff"
    "\u0482-\u0489\u0530-\u3000\u3004-\u3040\u3094-\u30a0\u30fb\u30ff-\u33ff\u4dc0-\u4dff\ua000-\uabff\ud7a4-\U00016fff\U0001bca0-\U0001bca3\U0001b000-\U0001f2ff\U0001fa70-\U0001ffff\U0002f800-\U0002fa1f\U000e0000-\U0010ffff]"
)


@lru_cache(maxsize=1)
def _maps() -> dict[str, dict[str, dict[str, str]]]:
    """Look-alikes by (to, from) script."""
    maps: dict[str, dict[str, dict[str, str]]] = {a: {b: {} for b in SCRIPTS} for a in SCRIPTS}
    for row in LOOKALIKES.replace("\n", "|").split("|"):
        letters = row.split()
        for a, x in zip(SCRIPTS, letters):
            for b, y in zip(SCRIPTS, letters):
                if a != b and x != "-" and y != "-":
                    maps[b].setdefault(a, {})[x] = y
    return maps


_LATIN, _GREEK, _CYRILLIC, _ACCENT = "A-Za-zÀ-ɏ", "Ͱ-Ͽ", "Ѐ-ԯ", "\u0300-\u036f"
#: A word that may hold letters of two scripts, and the place where one does.
_ALPHABETIC = re.compile(f"[{_LATIN}{_GREEK}{_CYRILLIC}{_ACCENT}]+")
_MIXED = re.compile(
    f"[{_LATIN}][{_ACCENT}]*[{_GREEK}{_CYRILLIC}]|[{_GREEK}][{_ACCENT}]*[{_LATIN}{_CYRILLIC}]|[{_CYRILLIC}][{_ACCENT}]*[{_LATIN}{_GREEK}]"
)


#: Without letters of two of these nothing is mixed.
_SCRIPT_LETTERS = [re.compile(f"[{own}]") for own in (_GREEK, _CYRILLIC, _LATIN)]


def _may_be_mixed(text: str) -> bool:
    greek, cyrillic, latin = _SCRIPT_LETTERS
    if not greek.search(text):
        return bool(cyrillic.search(text) and latin.search(text))
    return bool(cyrillic.search(text) or latin.search(text))


@lru_cache(maxsize=1 << 14)
def _script(ch: str) -> str | None:
    if not ch.isalpha():
        return None
    code = ord(ch)
    if code < 0x250:
        return "LATIN"
    if 0x370 <= code <= 0x3FF or 0x1F00 <= code <= 0x1FFF:
        return "GREEK"
    if 0x400 <= code <= 0x52F:
        return "CYRILLIC"
    return None


@lru_cache(maxsize=1 << 16)
def one_script(word: str, main: str = "LATIN") -> str:
    """``word`` with look-alike letters of other scripts put into one script.

    The script is the one that all other letters can be put into; of several, the
    one with more letters in the word that look like no other script's, then
    ``main``, the script of the text, then the one with more letters.  A word
    that no script can hold is left.
    """
    if len({s for c in word if (s := _script(c))}) < 2:
        return word
    whole, word = word, U.normalize("NFD", word)  # an accent may stand on a look-alike letter
    scripts = [_script(c) for c in word]
    there = {s for s in scripts if s}
    maps = _maps()
    best, rank = whole, None
    for k, to in enumerate(SCRIPTS):
        if to not in there:
            continue
        if any(s and s != to and c not in maps[to].get(s, {}) for c, s in zip(word, scripts)):
            continue
        own = [c for c, s in zip(word, scripts) if s == to]
        sure = sum(not any(c in maps[o].get(to, {}) for o in SCRIPTS if o != to) for c in own)
        score = (sure, to == main, len(own), -k)
        if rank is None or score > rank:
            rank = score
            best = "".join(maps[to][s][c] if s and s != to else c for c, s in zip(word, scripts))
    return U.normalize("NFC", best)


def _is_symbol(ch: str) -> bool:
    return bool(ch) and (U.category(ch) in ("So", "Sk") or ch in "️‍♀♂")


def _is_cjk(ch: str) -> bool:
    code = ord(ch) if ch else 0
    return 0x3001 <= code <= 0x30FF or 0x31F0 <= code <= 0x31FF or 0x3400 <= code <= 0x9FFF or 0xF900 <= code <= 0xFAFF or 0xFF66 <= code <= 0xFF9D or 0xAC00 <= code <= 0xD7A3


def _joins(ch: str) -> bool:
    return bool(ch) and U.name(ch, "").startswith(_ARABIC_LIKE)


_PLAIN_TEXT = re.compile(r"[\n\r\t -~]*\Z")


def canonical(text: str) -> str:
    """The one form of ``text``; what a reader sees stays.

    Letters are composed (NFC); wide, narrow, styled, joined and positional
    variants become plain letters, digits, signs and spaces (compatibility
    normalisation, except superscripts, subscripts, fractions, enclosed and
    squared signs and the ellipsis, which look different); every space is a
    plain space; default-ignorable and control characters go, except joiners and
    selectors within an emoji and joiners between letters of scripts that need
    them; wide punctuation next to Japanese text stays; look-alike letters in a
    word of two scripts are put into one.  Case, quotes and dashes stay.
    """
    if text.isascii() and (text.isprintable() or _PLAIN_TEXT.match(text)):
        return text
    made = _once(text)
    while made != text:  # what was taken out may leave a joiner without what it joined
        text, made = made, _once(made)
    return made


#: Bits of a character: it may be replaced, it may not be composed, it is a letter of one of SCRIPTS.
_CHANGES, _COMPOSES, _LATIN_BIT, _GREEK_BIT, _CYRILLIC_BIT = 1, 2, 4, 8, 16


@lru_cache(maxsize=1 << 16)
def _kind(code: int) -> int:
    ch = chr(code)
    kind = _CHANGES if _SPECIAL.match(ch) and _SINGLE[code] is not None else 0
    if code >= 0x300 and (U.category(ch)[0] == "M" or U.category(ch) == "Lo" and not _is_cjk(ch)) or not U.is_normalized("NFC", ch):
        kind |= _COMPOSES
    return kind | sum(bit for bit, own in zip((_GREEK_BIT, _CYRILLIC_BIT, _LATIN_BIT), _SCRIPT_LETTERS) if own.match(ch))


def canonical_lines(lines: list[str]) -> list[str]:
    """:func:`canonical` of each of ``lines``; what may change a line is told from the characters of all at once."""
    out = list(lines)
    wide = [i for i, line in enumerate(lines) if not (line.isascii() and line.isprintable())]
    if not wide:
        return out
    codes = np.frombuffer("\n".join([lines[i] for i in wide]).encode("utf-32-le", "surrogatepass"), np.uint32)
    there, kinds = np.zeros(0x110000, bool), np.zeros(0x110000, np.uint8)
    there[codes] = True
    for code in np.flatnonzero(there).tolist():
        kinds[code] = _kind(code)
    size = np.array([len(lines[i]) + 1 for i in wide])
    of_line = np.bitwise_or.reduceat(kinds[codes], np.cumsum(size) - size)
    scripts = np.bitwise_count(of_line & (_LATIN_BIT | _GREEK_BIT | _CYRILLIC_BIT))
    for k in np.flatnonzero((of_line & (_CHANGES | _COMPOSES) > 0) | (scripts > 1)).tolist():
        if of_line[k] & _CHANGES or scripts[k] > 1 or not U.is_normalized("NFC", lines[wide[k]]):
            out[wide[k]] = canonical(lines[wide[k]])
    return out


def _once(text: str) -> str:
    """One pass of :func:`canonical`."""
    made = _SPECIAL.sub(_plain, text)
    if not U.is_normalized("NFC", made):
        made = U.normalize("NFC", made)
    if made.isascii() or not _may_be_mixed(made) or not _MIXED.search(made):
        return made
    words = _ALPHABETIC.findall(made)
    letters = Counter(_script(c) for w in words for c in w)
    main = max(SCRIPTS, key=lambda s: letters[s])
    return _ALPHABETIC.sub(lambda m: one_script(m.group(0), main) if _MIXED.search(m.group(0)) else m.group(0), made)


def _plain(m: re.Match) -> str:
    """What a character that may be replaced becomes where it stands."""
    ch, text, i = m.group(0), m.string, m.start()
    code = ord(ch)
    new = _SINGLE[code]
    if new is None:
        return ch
    if code in (0x200C, 0x200D, 0xFE0E, 0xFE0F) or 0xE0020 <= code <= 0xE007F:
        before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
        if code == 0x200D and _is_symbol(before) and _is_symbol(after):
            return ch
        if code in (0x200C, 0x200D) and _joins(before) and _joins(after):
            return ch
        if code == 0xFE0F and (_is_symbol(before) or after == "\u20e3"):
            return ch
        if code >= 0xE0020 and (before == "\U0001f3f4" or 0xE0020 <= ord(before or "\0") <= 0xE007F):
            return ch
    elif 0xFF01 <= code <= 0xFF65 and U.category(ch)[0] == "P":
        before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
        if _is_cjk(before) or (after and _is_cjk(after)):
            return ch
    return new


def compare_key(text: str) -> str:
    """A key for comparisons: the one form, fully case-folded, runs of space collapsed."""
    return U.normalize("NFC", " ".join(canonical(text).casefold().split()))


def folded_values(df: DataFrame, column: str) -> DataFrame:
    """``(value, key, n)``: each distinct value of ``column``, its key for comparisons, its rows.

    The values are counted map-side first and each is folded once (see
    :func:`compare_key`).  Null values: no row.  The empty value has the empty key.
    """

    @F.pandas_udf("string")
    def key(text: pd.Series) -> pd.Series:
        return pd.Series([compare_key(t) for t in text], dtype=object)

    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counted.select("value", key("value").alias("key"), "n")


def canonical_column():
    """A pandas UDF: text -> its one form, each distinct value of a batch computed once."""

    @F.pandas_udf("string")
    def one_form(text: pd.Series) -> pd.Series:
        return pd.Series(per_distinct(text, canonical), dtype=object)

    return one_form.asNondeterministic()


def needs_look(text: Column) -> Column:
    """Whether a text holds anything but printable ASCII, tabs and line ends."""
    return text.rlike(r"[^\n\r\t -~]")


def normalise(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the text ``columns`` in their one form; other columns as they are.

    Row-local, no shuffle; every row passes the UDF, which returns plain ASCII
    texts at once.  Null stays null, empty stays empty, repeated rows stay.
    """
    one = canonical_column()
    return df.select(*[one(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def respelled(df: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """``(id, field)``: distinct rows' fields whose value is not in the one form.

    Texts of printable ASCII never leave the JVM.  Null and empty values are no
    cases; repeated rows count once; an empty table gives an empty result.
    """
    one = canonical_column()
    wide = distinct_rows(df.select(F.col(id_col).alias("id"), *[F.col(c) for c in columns]), "id")
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])
    long = wide.select("id", F.explode(pairs).alias("p")).select("id", "p.field", "p.value")
    judged = long.filter(needs_look(F.col("value"))).withColumn("form", one("value"))
    return judged.filter(F.col("form") != F.col("value")).select("id", "field")
