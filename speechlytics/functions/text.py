"""Tokens and scripts. Lengths and positions count code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used in there."""
    return F.get(F.transform(F.array(value), body), 0)


def tokenize(text: Column) -> Column:
    """Runs between any Unicode white space, without empty ones; null gives null."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def mostly_devanagari(word: Column) -> Column:
    return F.regexp_count(word, F.lit(r"[\x{0900}-\x{097F}]")) * 2 > F.length(word)


def pure_devanagari(word: Column) -> Column:
    return word.rlike(r"^[\x{0900}-\x{097F}\x{200C}\x{200D}]+$")


def truncate(text: Column, most: int, keep: int) -> Column:
    """Longer than ``most``: the first ``keep`` characters and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep), F.lit("…"))).otherwise(text)


def slug(label: Column) -> Column:
    """Lower case, spaces to underscores, no parentheses."""
    return F.translate(F.lower(label), " ()", "_")


def bar(percent: Column) -> Column:
    return F.repeat(F.lit("█"), F.floor(percent / 2).cast("int"))


def wrap(text: Column, width: int = 75) -> Column:
    """Lines of at most ``width`` characters, broken between words; a longer word has a line of its own."""
    def step(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = F.length(last) + 1 + F.length(word) <= width
        return F.when(F.size(lines) == 0, F.array(word)).when(fits, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat(last, F.lit(" "), word)))).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(tokenize(text), F.array().cast("array<string>"), step)
