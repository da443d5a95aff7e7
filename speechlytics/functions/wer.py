"""Word error rate. A pair's words become single characters, so that the built-in edit distance counts words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, tokenize

#: Distinct words of a pair that fit below the surrogates; more of them take characters beyond.
MOST_WORDS = 35_000


def word_errors(ref: Column, hyp: Column) -> Column:
    """Substitutions, deletions and insertions between two arrays of words, of up to a million distinct words."""
    def encoded(words: Column, seen: Column) -> Column:
        short = F.transform(words, lambda w: F.lpad(F.hex(19967 + F.array_position(seen, w)), 4, "0"))
        # The upper half of the block, and all planes above it, lie beyond the surrogates.
        code = lambda w: F.array_position(seen, w) + F.when(F.array_position(seen, w) <= MOST_WORDS, 19967).otherwise(65535 - MOST_WORDS)
        long = F.transform(words, lambda w: F.lpad(F.hex(code(w)), 8, "0"))
        return F.when(F.size(seen) <= MOST_WORDS, F.decode(F.unhex(F.array_join(short, "")), "UTF-16BE")).otherwise(F.decode(F.unhex(F.array_join(long, "")), "UTF-32"))

    def distance(pair: Column) -> Column:
        return let(F.array_distinct(F.concat(pair["r"], pair["h"])), lambda seen: F.levenshtein(encoded(pair["r"], seen), encoded(pair["h"], seen)))

    return let(F.struct(ref.alias("r"), hyp.alias("h")), distance)


def wer_percent(errors: Column, words: Column) -> Column:
    """Per sample; an empty reference counts 100."""
    return F.when(words == 0, F.lit(100.0)).otherwise(errors * 100.0 / words)


def corpus_wer(errors: Column, words: Column) -> Column:
    """Aggregate: all errors over all words, in percent."""
    return F.coalesce(F.sum(errors) * 100.0 / F.nullif(F.sum(words), F.lit(0)), F.lit(0.0))


def training_wer(labels: Column, predictions: Column, vocabulary: Column, pad: int, ignored: int = -100) -> Column:
    """Aggregate over rows of token ids: corpus WER of the decoded texts. ``ignored`` labels count as ``pad``, which is left out of the text.

    ``vocabulary``: an array of the tokens' strings by id; a token that begins a word begins with a space.
    """
    def text(ids: Column) -> Column:
        kept = F.filter(F.transform(ids, lambda t: F.when(t == ignored, pad).otherwise(t)), lambda t: t != pad)
        return tokenize(F.array_join(F.transform(kept, lambda t: F.get(vocabulary, t)), ""))

    return corpus_wer(word_errors(text(labels), text(predictions)), F.size(text(labels)))
