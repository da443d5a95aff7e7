"""Consensus ("lattice") WER over the models of a row: alignment and votes stay in the row, nothing is shuffled before the last sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.align import align_models
from ..functions.text import tokenize
from ..functions.wer import word_errors

VOTES = 3


def wide_to_models(df: DataFrame, truth: str = "Human", prefix: str = "Model") -> DataFrame:
    """Every column whose name starts with ``prefix`` as one (model, text) in an array; nulls are empty texts."""
    models = [c for c in df.columns if c.startswith(prefix)]
    texts = F.array(*(F.struct(F.lit(c).alias("model"), tokenize(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias("words")) for c in models))
    return df.withColumns({"ref": tokenize(F.coalesce(F.col(truth), F.lit(""))), "models": texts})


def bins(df: DataFrame, votes: int = VOTES) -> DataFrame:
    """(ref, models) -> also ``aligned`` (words by model) and ``bins``: by position (ref, words, valid, primary).

    ``valid`` is the reference and every other word with enough votes; ``primary`` the first of those, else the reference.
    """
    aligned = align_models("ref", F.transform("models", lambda m: m["words"]))

    def position(word, i):
        words = F.filter(F.transform("aligned", lambda a: F.get(a, i)), lambda w: w != "")
        agreed = F.filter(F.array_distinct(words), lambda w: (w != word) & (F.size(F.filter(words, lambda x: x == w)) >= votes))
        return F.struct(word.alias("ref"), words.alias("words"), F.concat(F.array(word), agreed).alias("valid"), F.coalesce(F.get(agreed, 0), word).alias("primary"))

    return df.withColumn("aligned", aligned).withColumn("bins", F.transform("ref", position))


def model_errors(df: DataFrame) -> DataFrame:
    """``bins`` -> a row for each row and model: words, standard errors, and those that the lattice doesn't forgive.

    Only a substitution by a valid word is forgiven. An empty reference counts nothing.
    """
    each = df.withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("models") - 1)))
    spared = F.size(F.filter(F.zip_with("bins", F.get("aligned", F.col("pos")), lambda b, w: (w != "") & (w != b["ref"]) & F.array_contains(b["valid"], w)), lambda x: x))
    model = F.get("models", F.col("pos"))
    words = F.size("ref")
    errors = F.when(words == 0, 0).otherwise(word_errors(F.col("ref"), model["words"]))
    out = each.withColumns({"model": model["model"], "words": words, "errors": errors, "spared": spared})
    return out.withColumn("lattice_errors", F.col("errors") - F.col("spared")).drop("pos", "spared")


def by_model(errors: DataFrame, unfair: float = 0.5) -> DataFrame:
    """The result table: standard and lattice WER in percent, their difference, and whether it exceeds ``unfair`` before rounding."""
    sums = errors.groupBy("model").agg(F.sum("words").alias("words"), F.sum("errors").alias("errors"), F.sum("lattice_errors").alias("lattice_errors"))
    rate = lambda c: F.coalesce(F.col(c) * 100.0 / F.nullif(F.col("words"), F.lit(0)), F.lit(0.0))
    delta = rate("errors") - rate("lattice_errors")
    return sums.select("model", "words", "errors", "lattice_errors", F.round(rate("errors"), 2).alias("standard_wer"), F.round(rate("lattice_errors"), 2).alias("lattice_wer"), F.round(delta, 2).alias("delta"), F.when(delta > unfair, "Yes").otherwise("No").alias("fairly_penalized"))
