"""Cleaning of page text: encodings, boilerplate phrases, sections."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of menus and footers, each matched between word boundaries, case ignored.
PHRASES = [
    "get in touch", "scroll down", "learn more", "view more", "read more", "contact us", "all rights reserved",
    r"©\s*\d{4}", "follow us on", r"facebook[- ]?f", "instagram", "linkedin", "behance", "twitter", "subscribe",
    "enter your email", "enter your message", "submit", "privacy policy", "terms of service", "cookie policy",
]
# Names of sections, in the order in which they are tried.
SECTION_KEYWORDS = [
    "about", "services", "our services", "what we do", "portfolio", "our work", "case studies", "blog", "news", "articles",
    "testimonials", "client", "clients", "reviews", "contact", "get in touch", "contact us", "process", "our process",
    "how we work", "team", "careers", "features", "pricing",
]
#: A line with a phrase is dropped under this length, else the phrase is blanked.
DROP_UNDER = 120
TINY_UNDER, TINY_WORDS = 60, 3
HEADING_MOST, HEADING_WORDS = 100, 6

PHRASE_PATTERN = rf"(?iU)\b(?:{'|'.join(PHRASES)})\b"
#: Line ends as a text reader takes them: LF, CR, CRLF, NEL, LS, PS.
LINE_END = "\\r\\n|[\\n\\r\u0085\u2028\u2029]"
# Spaces that become plain ones, controls that are blanked.
_SPACES = "[\u00a0\u200b\u202f]"
_CONTROLS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"


def _unescape(text: Column, normalise: bool) -> Column:
    """HTML entities resolved, and with ``normalise`` spaces mapped and NFKC; plain texts skip the UDF's work."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            t = html.unescape(t) if "&" in t else t
            if normalise and not t.isascii():
                t = unicodedata.normalize("NFKC", t.translate({0xA0: " ", 0x200B: " ", 0x202F: " "}))
            return t

        return pd.Series([one(t) for t in values], dtype=object)

    return run(text)


def trim_space(text: Column) -> Column:
    """Trimmed of Unicode white space on both sides."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fix_encoding(text: Column) -> Column:
    """Entities resolved, special spaces plain, NFKC, controls blanked, runs of space and blank lines shortened.

    Null counts as empty.
    """
    t = _unescape(F.coalesce(text, F.lit("")), normalise=True)
    t = F.regexp_replace(t, _CONTROLS, " ")
    t = F.regexp_replace(t, "[ \t]{2,}", " ")
    t = F.regexp_replace(t, " +\n", "\n")
    return trim_space(F.regexp_replace(t, "\n{3,}", "\n\n"))


def text_lines(text: Column) -> Column:
    """The lines of a text, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(text, LINE_END), trim_space), lambda line: line != "")


def has_phrase(line: Column) -> Column:
    return line.rlike(PHRASE_PATTERN)


def drops_line(line: Column) -> Column:
    """Whether a trimmed line is dropped whole: it has a phrase and is short."""
    return has_phrase(line) & (F.char_length(line) < DROP_UNDER)


def clean_lines(lines: Column) -> Column:
    """Lines without the dropped ones, phrases of long ones blanked."""
    kept = F.filter(lines, lambda line: ~drops_line(line))
    return F.transform(kept, lambda line: F.regexp_replace(line, PHRASE_PATTERN, " "))


def strip_markup(text: Column) -> Column:
    """Entities resolved once more, scripts, styles and tags blanked, special spaces and controls plain."""
    t = _unescape(F.coalesce(text, F.lit("")), normalise=False)
    t = F.regexp_replace(t, r"(?is)<(?:script|style).*?>.*?</(?:script|style)>", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = F.regexp_replace(t, _SPACES, " ")
    return F.regexp_replace(t, _CONTROLS[:-1] + "]+", " ")


def clean_text(text: Column) -> Column:
    """Markup and boilerplate lines removed; what remains, one line per line."""
    return trim_space(F.array_join(clean_lines(text_lines(strip_markup(text))), "\n"))


def remove_tiny_lines(text: Column) -> Column:
    """Short lines of up to three words of which one is a boilerplate phrase by itself are dropped."""

    def tiny(line: Column) -> Column:
        words = F.regexp_extract_all(line, F.lit(r"[A-Za-z0-9']+"), F.lit(0))
        return (F.char_length(line) < TINY_UNDER) & (F.size(words) <= TINY_WORDS) & F.exists(words, has_phrase)

    return F.array_join(F.filter(text_lines(text), lambda line: ~tiny(line)), "\n")


def is_heading(line: Column) -> Column:
    """Whether a trimmed line is a heading: it has a section's name, or is short with one to six capitalised words."""
    low = F.lower(line)
    named = low.rlike("|".join(SECTION_KEYWORDS))
    capitals = F.size(F.filter(F.split(line, r"(?U)\s+"), lambda w: w.rlike(r"^[\p{Lu}\p{Lt}]")))
    short = (F.char_length(line) <= HEADING_MOST) & (capitals > 0) & (capitals <= HEADING_WORDS)
    return named | (short & ~line.rlike(r"^\d+[.:]?\s*$"))


def section_name(heading: Column) -> Column:
    """The first section name that a heading contains, words joined by ``_``; else a slug, else ``section``."""
    low = F.lower(heading)
    out = F.lit(None).cast("string")
    for keyword in reversed(SECTION_KEYWORDS):
        out = F.when(low.contains(keyword), F.lit(keyword.replace(" ", "_"))).otherwise(out)
    slug = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(out, F.when(slug != "", slug), F.lit("section"))


def sections(text: Column) -> Column:
    """``array<struct<pos, section, content>>``: the text cut at its headings.

    What stands before the first heading is ``intro``; without a heading the
    whole text is ``main``; an empty text has none.  A heading without lines
    keeps an empty section.  One pass over the lines of the row, no shuffle.
    """
    blank = F.struct(F.lit("").alias("heading"), F.array().cast("array<string>").alias("lines"))
    start = F.array(blank)

    def step(done: Column, line: Column) -> Column:
        fresh = F.struct(line.alias("heading"), F.array().cast("array<string>").alias("lines"))
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["heading"].alias("heading"), F.concat(last["lines"], F.array(line)).alias("lines"))
        before = F.slice(done, F.lit(1), F.size(done) - 1)
        return F.when(is_heading(line), F.concat(done, F.array(fresh))).otherwise(F.concat(before, F.array(longer)))

    parts = F.aggregate(text_lines(text), start, step)
    kept = F.filter(parts, lambda p, i: (i > 0) | (F.size(p["lines"]) > 0))
    return F.transform(
        kept,
        lambda p, i: F.struct(
            i.alias("pos"),
            F.when(p["heading"] != "", section_name(p["heading"]))
            .when(F.size(kept) == 1, F.lit("main")).otherwise(F.lit("intro")).alias("section"),
            F.array_join(p["lines"], "\n").alias("content"),
        ),
    )


def slugify(text: Column) -> Column:
    """Lower-cased, every run of other than a-z and 0-9 one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(trim_space(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
