"""Document search as filters."""

from __future__ import annotations

import re
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: str) -> Column:
    """Runs of ASCII letters, digits and underscores, A-Z lower-cased, whatever the language."""
    return F.split(F.translate(text, ascii_uppercase, ascii_lowercase), "[^a-z0-9_]+")


def match(text: str, words: list[str]) -> Column:
    """Any of the words is a token of the text."""
    return F.arrays_overlap(tokens(text), F.array(*map(F.lit, words)))


def multi_match(columns: list[str], words: list[str]) -> Column:
    """Any of the words is a token of any of the columns."""
    return reduce(lambda a, b: a | b, (F.coalesce(match(c, words), F.lit(False)) for c in columns))


def fuzzy(token: str, word: str, edits: int) -> Column:
    near = F.length(token).between(len(word) - edits, len(word) + edits)
    return near & (F.levenshtein(F.col(token), F.lit(word), edits) >= 0)


def boolean(must: list[Column], must_not: list[Column], should: list[Column]) -> tuple[Column, Column]:
    """(condition, score): with a must, should only adds to the score."""
    keep = F.lit(True)
    for c in must:
        keep = keep & c
    for c in must_not:
        keep = keep & ~c
    score = F.lit(0)
    for c in should:
        score = score + c.cast("int")
    return (keep if must else keep & (score > 0)), score + len(must)


def highlight(text: str, word: str) -> Column:
    return F.regexp_replace(text, "(" + re.escape(word) + ")", "<em>$1</em>")
