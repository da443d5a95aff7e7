"""English loanwords in Hindi text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon
from .numbers import normalize_numbers
from .text import let, tokenize


def tag_loanwords(text: Column, loanwords: Iterable[str] | None = None, absorbed: Iterable[str] | None = None) -> Column:
    """Latin words of two letters or more, and loanwords that aren't absorbed, become ``[EN]word[/EN]``.

    Punctuation is dropped to look a word up; a word with punctuation inside isn't changed. Both lists may be given.
    """
    known = sorted(set(lexicon.LOANWORDS.split() if loanwords is None else loanwords) - set(lexicon.ABSORBED.split() if absorbed is None else absorbed))

    def tag(word: Column) -> Column:
        return let(F.regexp_replace(word, r"""[।,!?.\-:;"'()]""", ""), lambda clean: marked(word, clean))

    def marked(word: Column, clean: Column) -> Column:
        english = clean.rlike("^[a-zA-Z]{2,}$") | clean.isin(known)
        return F.when(english, F.replace(word, clean, F.concat(F.lit("[EN]"), clean, F.lit("[/EN]")))).otherwise(word)

    return F.array_join(F.transform(tokenize(text), tag), " ")


def post_process(text: Column) -> Column:
    """Numbers, then tags."""
    return tag_loanwords(normalize_numbers(text))
