"""Spelled Hindi numbers to digits, as one fold over the tokens: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon
from .text import let, tokenize

_IDIOM = "|".join(f"(?:{p})" for p in lexicon.IDIOMS)
_NUMBER = "|".join([*lexicon.number_words(), *lexicon.MULTIPLIERS])
_STATE = "struct<out:array<string>,run:array<string>,total:bigint,cur:bigint,pos:int>"


def _literal_map(table: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x).cast("bigint") if isinstance(x, int) else F.lit(x) for pair in table.items() for x in pair))


def _closed(state: Column) -> Column:
    """The tokens so far with the open run written out: its value, or its own words if that is 0."""
    value = state["total"] + state["cur"]
    return F.concat(state["out"], F.when(value == 0, state["run"]).otherwise(F.array(value.cast("string"))))


def normalize_numbers(text: Column) -> Column:
    """Spelled numbers become digits; tokens are joined by single spaces.

    A run of number words folds from left to right: a small number replaces the one before it; a multiplier larger than
    the total so far multiplies all of it with the small number, else the small number alone, which is added. A number word in an idiom's neighbourhood stays,
    unless a run has begun before it. Null gives null, text without words an empty string.
    """
    # Most texts hold no number word, and of the others most hold no idiom.
    plain = F.array_join(tokenize(text), " ")
    return F.when(text.rlike(_NUMBER), let(F.struct(text.alias("t"), text.rlike(_IDIOM).alias("i")), lambda x: _folded(x["t"], x["i"]))).otherwise(plain)


def _folded(text: Column, idiom: Column) -> Column:
    small, multipliers, empty = _literal_map(lexicon.number_words()), _literal_map(lexicon.MULTIPLIERS), F.array().cast("array<string>")

    def step(s: Column, t: Column) -> Column:
        word, value, times = t["w"], t["v"], t["m"]
        number, running = value.isNotNull() | times.isNotNull(), F.size(s["run"]) > 0
        start = F.greatest(F.lit(0), s["pos"] - 10)
        near = idiom & F.substring(text, start + 1, s["pos"] + F.length(word) + 30 - start).rlike(_IDIOM)
        folds = number & (running | ~near)
        counted = F.when(s["cur"] == 0, F.lit(1).cast("bigint")).otherwise(s["cur"])
        total = F.when(times.isNull(), s["total"]).when(times > s["total"], (s["total"] + counted) * times).otherwise(s["total"] + counted * times)
        pos = s["pos"] + F.length(word) + F.when(s["pos"] == 0, 0).otherwise(1)
        state = lambda out, run, total, cur: F.struct(out.alias("out"), run.alias("run"), total.alias("total"), cur.alias("cur"), pos.cast("int").alias("pos")).cast(_STATE)
        none, word_ = F.lit(0).cast("bigint"), F.array(word)
        return (
            F.when(folds, state(s["out"], F.concat(s["run"], word_), total, F.coalesce(value, none)))
            .when(running, state(F.concat(_closed(s), word_), empty, none, none))
            .otherwise(state(F.concat(s["out"], word_), empty, none, none))
        )

    tokens = F.transform(tokenize(text), lambda w: F.struct(w.alias("w"), small[w].alias("v"), multipliers[w].alias("m")))
    first = F.struct(empty.alias("out"), empty.alias("run"), F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("cur"), F.lit(0).alias("pos")).cast(_STATE)
    return F.aggregate(tokens, first, step, lambda s: F.array_join(F.when(F.size(s["run"]) > 0, _closed(s)).otherwise(s["out"]), " "))


def spell_number(n: Column) -> Column:
    """The words of a whole number from 1 to 9,999,999: lakh, thousand, hundred, rest."""
    return let(n.cast("bigint"), _spelled)


def _spelled(n: Column) -> Column:
    below = F.array(*(F.lit(w.split("/")[0]) for w in lexicon.NUMBERS.split()))

    def part(value: Column, unit: str | None) -> Column:
        word = F.get(below, value.cast("int"))
        return F.when(value > 0, F.concat_ws(" ", word, F.lit(unit)) if unit else word)

    return F.concat_ws(" ", part(F.floor(n / 100000), "लाख"), part(F.floor(n / 1000) % 100, "हजार"), part(F.floor(n / 100) % 10, "सौ"), part(n % 100, None))
