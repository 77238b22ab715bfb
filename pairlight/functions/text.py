"""Column expressions over text. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlight import vocab

# White space and word characters are spelled out so that no engine's ASCII default applies.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
OTHER = r"[^\p{L}\p{N}_]"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row.

    Expressions used inside a lambda are otherwise computed again for every element.
    """
    return F.transform(F.array(value), body)[0]


def squish(text: Column) -> Column:
    """Collapse runs of white space to one space and drop it at both ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def fold(text: Column) -> Column:
    """Key under which spellings that differ in case or outer space are the same."""
    return F.lower(strip(text))


def meaningful(text: Column) -> Column:
    return ~fold(text).isin(*vocab.PLACEHOLDERS)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}+)"))


def units(text: Column) -> Column:
    """Words and what stands between them, in turn, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}+|{OTHER}+)"))


def match_key(name: Column) -> Column:
    """Key for matches that tolerate case, punctuation and spacing."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def grams(text: Column, size: int) -> Column:
    """Distinct substrings of the given length, none for shorter text."""
    last = F.length(text) - size + 1
    return F.when(
        last > 0,
        F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(size)))),
    ).otherwise(F.array().cast("array<string>"))


def chunk_windows(
    text: Column,
    size: int = vocab.CHUNK_WORDS,
    overlap: int = vocab.CHUNK_OVERLAP,
    min_chars: int = vocab.CHUNK_MIN_CHARS,
) -> Column:
    """Array of overlapping word windows; empty for blank text.

    Windows start every size - overlap words and stop once one reaches the end.
    A text that fits one window is kept whole however short it is.
    """
    if overlap >= size:
        raise ValueError(f"overlap ({overlap}) must be smaller than size ({size})")
    step = size - overlap

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.ceil((F.size(words) - size) / F.lit(step)).cast("int"))
        windows = F.transform(starts, lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "))
        return F.when(F.size(words) <= size, F.array(F.array_join(words, " "))).otherwise(
            F.filter(windows, lambda w: F.length(w) >= min_chars))

    clean = squish(F.coalesce(text, F.lit("")))
    return let(clean, lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(let(F.split(c, " "), cut)))


def name_problem(clean: Column) -> Column:
    """Null for an acceptable stripped name, else the reason to refuse it."""
    return (
        F.when(clean == "", F.lit(vocab.NAME_EMPTY))
        .when(F.length(clean) > vocab.MAX_NAME_CHARS, F.lit(vocab.NAME_TOO_LONG % vocab.MAX_NAME_CHARS))
        .when(~clean.rlike(rf"^(?:[{vocab.NAME_CHARS}]|{SPACE})+\z"), F.lit(vocab.NAME_BAD_CHARS))
    )
