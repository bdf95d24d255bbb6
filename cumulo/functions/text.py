"""Text expressions. All of them are built-in functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(?U)\b\d+\.?\d*\b"
WHITE = r"(?U)\s+"
WORD = r"[\p{L}\p{N}_]{2,}"


def strip(text: Column) -> Column:
    """All Unicode white space at both ends; trim() would take spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def drop_numbers(text: Column) -> Column:
    """'120/80' leaves '/', 'x2' stays."""
    return F.regexp_replace(text, NUMBER, "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, WHITE, " "))


def clean(text: Column) -> Column:
    return squeeze(drop_numbers(text))


def truncate(text: Column, most: int = 2000) -> Column:
    return F.substring(text, 1, most)


def entity_name(text: Column) -> Column:
    """Stripped, lower case, white space as one underscore."""
    return F.regexp_replace(F.lower(strip(text)), WHITE, "_")


def words(text: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def pieces(text: Column) -> Column:
    """Lower-case runs without white space."""
    return F.filter(F.split(F.lower(text), WHITE), lambda t: t != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by one space; none if there are fewer."""
    if n == 1:
        return tokens
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def ngram_range(tokens: Column, low: int, high: int) -> Column:
    return F.concat(*[ngrams(tokens, n) for n in range(low, high + 1)])


def negated_name(name: Column, negated: Column) -> Column:
    return F.when(negated, F.concat(F.lit("NEG_"), name)).otherwise(name)


def is_negated_name(name: Column) -> Column:
    """Whatever the case: a vectoriser may have lower-cased the prefix."""
    return F.lower(name).startswith("neg_")


def preview(text: Column, n: int = 80) -> Column:
    return F.substring(text, 1, n)
