"""The stateless text operators on a stream, and corpus WER as a running aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import normalize_numbers
from ..functions.tagging import tag_loanwords
from ..functions.text import tokenize
from ..functions.wer import corpus_wer, word_errors


def post_processed(df: DataFrame, text: str = "text") -> DataFrame:
    """numbers_converted, english_tagged and cleaned_text; runs alike on batches and streams."""
    numbers = normalize_numbers(F.col(text))
    return df.withColumn("numbers_converted", numbers).withColumn("english_tagged", tag_loanwords(F.col("numbers_converted"))).withColumn("cleaned_text", F.col("numbers_converted"))


def running_wer(df: DataFrame, ref: str = "reference", hyp: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    """Corpus WER by the given columns; for ``outputMode("complete")`` on a stream."""
    words = tokenize(F.col(ref))
    each = df.select(*by, word_errors(words, tokenize(F.col(hyp))).alias("errors"), F.size(words).alias("words"))
    return each.groupBy(*by).agg(F.sum("errors").alias("errors"), F.sum("words").alias("words"), corpus_wer(F.col("errors"), F.col("words")).alias("wer"))
