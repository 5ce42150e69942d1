"""Text analyzers as column expressions, with Python twins for the query side.

A token is a maximal run of characters that are alphabetic or numeric in Unicode,
so vowel signs, which belong to their letters, do not cut a word. The index analyzer keeps
tokens shorter than 40 bytes of UTF-8, the query analyzer those shorter than 60,
and both lower-case. The splitter of the dense-matrix baseline cuts at
``space , . ; -``, keeps parts longer than two bytes and upper-cases them.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX_LIMIT = 40
QUERY_LIMIT = 60
TOKEN_PATTERN = r"[\p{IsAlphabetic}\p{N}]+"
_PYTHON_TOKEN = regex.compile(r"[\p{Alphabetic}\p{N}]+")
_BLANKS = " \t\n\r\x0b\x0c"


def raw_tokens(text: Column | str) -> Column:
    """Every token as stored, neither lower-cased nor filtered; null for a null text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(column, F.lit(TOKEN_PATTERN), F.lit(0))


def tokens(text: Column | str, limit: int = INDEX_LIMIT) -> Column:
    """The analyzer's tokens as an array, in text order; null for a null text."""
    # Lower-casing may change a token's length in bytes, so the filter comes first.
    kept = F.filter(raw_tokens(text), lambda t: F.octet_length(t) < limit)
    return F.transform(kept, F.lower)


def split_words(text: Column | str) -> Column:
    """Words of the dense-matrix baseline, upper-cased."""
    column = F.col(text) if isinstance(text, str) else text
    parts = F.filter(F.split(column, "[ ,.;-]"), lambda w: F.octet_length(w) > 2)
    return F.transform(parts, F.upper)


def query_tokens(word: str, limit: int = QUERY_LIMIT) -> list[str]:
    """Python twin of ``tokens`` for one word of a query."""
    return [t.lower() for t in _PYTHON_TOKEN.findall(word) if len(t.encode()) < limit]


def compared_form(term: Column | str) -> Column:
    """A term lower-cased and without white space around it; null stays null."""
    column = F.col(term) if isinstance(term, str) else term
    return F.lower(F.btrim(column, F.lit(_BLANKS)))


def set_bits(words: Column | str) -> Column:
    """Set bits of a list of lists of 64-bit words; null entries count as zero."""
    column = F.col(words) if isinstance(words, str) else words
    return F.coalesce(
        F.aggregate(
            F.flatten(F.filter(column, lambda inner: inner.isNotNull())),
            F.lit(0).cast("bigint"),
            lambda total, word: total + F.coalesce(F.bit_count(word), F.lit(0)),
        ),
        F.lit(0).cast("bigint"),
    )


def list_total(numbers: Column | str) -> Column:
    """Sum of a list, null entries as zero; null for a null list."""
    column = F.col(numbers) if isinstance(numbers, str) else numbers
    return F.aggregate(column, F.lit(0).cast("bigint"), lambda total, n: total + F.coalesce(n, F.lit(0)))
