"""E-mail addresses and telephone numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"([a-zA-Z0-9_.+\-]+@[a-zA-Z0-9\-]+\.[a-zA-Z0-9\-.]+)"
PHONE = r"(\+?\d[\d\-\s().]{6,}\d)"
# Ways to hide an address, and what they stand for.
HIDDEN = [
    (r"(?i)\[email(?:\\xa0)?protected\]", "email@example.com"),
    (r"(?iU)\[email\s*protected\]", "email@example.com"),
    (r"(?iU)\s*\[at\]\s*", "@"),
    (r"(?iU)\s*\(at\)\s*", "@"),
    (r"(?iU)\s*\[dot\]\s*", "."),
    (r"(?iU)\s*\(dot\)\s*", "."),
    (r"(?iU)\bemail\s+at\s+", "email@"),
    (r"(?iU)\bdot\b", "."),
]


def canonical_email(address: Column) -> Column:
    """Trimmed, lower-cased, without quotes and angle brackets around it, dots of the domain single."""
    low = F.regexp_replace(F.lower(F.trim(address)), "^[\"'<>]+|[\"'<>]+$", "")
    local, domain = F.substring_index(low, "@", 1), F.regexp_replace(F.substring_index(low, "@", -1), r"\.{2,}", ".")
    return F.when(low.contains("@"), F.concat(local, F.lit("@"), domain)).otherwise(low)


def emails(text: Column) -> Column:
    """The addresses in a text, hidden ones too, in order and each once; null: none."""
    shown = F.coalesce(text, F.lit(""))
    for pattern, plain in HIDDEN:
        shown = F.regexp_replace(shown, pattern, plain)
    return F.array_distinct(F.transform(F.regexp_extract_all(shown, F.lit(EMAIL), F.lit(1)), canonical_email))


def first_email(text: Column) -> Column:
    return F.get(emails(text), F.lit(0))


def phone(text: Column) -> Column:
    """The candidate with the most digits (the first of equals), null where there is none.

    With a leading plus it is taken as it is; 11 to 15 digits get one, 8 to 10
    stay, other lengths give null even if another candidate would do.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHONE), F.lit(1))
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    ranked = F.transform(
        found,
        lambda c, i: F.struct(
            F.char_length(digits(c)).alias("n"), (-i).alias("first"), F.startswith(c, F.lit("+")).alias("plus"), digits(c).alias("digits")
        ),
    )
    best = F.array_max(ranked)
    return (
        F.when(best["plus"], F.concat(F.lit("+"), best["digits"]))
        .when((best["n"] > 10) & (best["n"] <= 15), F.concat(F.lit("+"), best["digits"]))
        .when((best["n"] >= 8) & (best["n"] <= 10), best["digits"])
    )
