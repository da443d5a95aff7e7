"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact length in words). Of each source the mix takes every document ``floor(target /
size)`` times, and spends the rest of the budget on one more pass over some documents: every length gives its share,
and a bounded-knapsack dynamic programme over the lengths that are left meets the remaining words exactly where a
subset does, or else as near as one gets from either side. Which documents of a length are taken follows from a seeded hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

SEED = 17
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its words.
MOST = 3.0
#: Hash ranges in which the documents of one (source, length) are counted.
RANGES = 256
#: Rules (one for each source and length) that are broadcast at most, about 60 bytes each; beyond, the join shuffles.
BROADCAST_RULES = 1 << 18
#: Words that the dynamic programme is left with, besides twice the longest length in play.
TABLE = 1 << 12


def words(col: Column) -> Column:
    return F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight; what exceeds ``most`` times a size goes to the others by weight, until none is above."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        over = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in sorted(over):
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in sorted(over))
        open_ -= over
    return out


def subset_sum(sizes: np.ndarray, counts: np.ndarray, budget: int, over: int = 0) -> np.ndarray:
    """How many of each size to take, at most ``counts``, so that the sum is ``budget``, or else as near as it gets.

    From below, or also from above by ``over`` at most; of two as near, the one from below.

    Bounded knapsack over a bit set: counts are split into powers of two, the sets of reachable sums are kept item by
    item and walked back. It stops as soon as the budget is reached.
    """
    take, items, reach, seen, mask = np.zeros(len(sizes), np.int64), [], 1, [1], (1 << (budget + over + 1)) - 1
    for k in np.argsort(-sizes, kind="stable"):
        size, left, step = int(sizes[k]), int(min(counts[k], (budget + over) // max(1, int(sizes[k])))), 1
        while size and left and not reach >> budget & 1:
            n = min(step, left)
            reach |= (reach << (n * size)) & mask
            items.append((k, n))
            seen.append(reach)
            left, step = left - n, step * 2
    at, above = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1, reach >> (budget + 1)
    more = (above & -above).bit_length()  # the least sum above the budget exceeds it by so much; 0: none
    if more and more < budget - at:
        at = budget + more
    for (k, n), before in zip(reversed(items), reversed(seen[:-1]), strict=True):
        if not before >> at & 1:
            take[k] += n
            at -= n * int(sizes[k])
    return take


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """``subset_sum`` for a budget of any size: proportional shares, then large lengths, then the dynamic programme."""
    total = int((sizes * counts).sum())
    if budget >= total or not total:
        return counts.copy() if total else np.zeros_like(counts)
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int((sizes * take).sum())
    for k in np.argsort(-sizes, kind="stable"):
        size = int(sizes[k])
        if size and rest > TABLE + 2 * size:
            n = min(int(counts[k] - take[k]), (rest - TABLE - size) // size)
            take[k] += n
            rest -= n * size
    more, short = np.zeros_like(take), 0
    for _ in range(2):  # from below; then also from above, if that may be nearer
        usable = (sizes > 0) & (sizes <= rest + short)
        more[usable] = subset_sum(sizes[usable], (counts - take)[usable], rest, short)
        short = rest - int((sizes * more).sum()) - 1
        if short < 1:
            break
    return take + more


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one source's lengths: how often all documents come, and how many of each length once more."""
    sizes, counts, target = frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), float(frame["target"].iloc[0])
    total = int((sizes * counts).sum())
    passes = int(target // total) if total else 0
    extra = fit(sizes, counts, max(0, round(target) - passes * total))
    return frame.assign(passes=passes, extra=extra)[["_key", "size", "n", "passes", "extra"]]


def _rows(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, **keep: Column) -> DataFrame:
    """The given columns of ``docs``, _key (a source as text, null last and equal to itself), size, and the seeded hash as _range and _draw."""
    text = text_or_empty(text_col)
    draw = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text))
    key = F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1"))
    parts = {"_key": key, "_size": words(text), "_range": F.pmod(draw, F.lit(RANGES)).cast("int"), "_draw": F.shiftright(draw, 8)}
    return docs.select(*(c.alias(k) for k, c in (keep | parts).items()))


def rules(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (_key, _size, _range, _draw, _row): what holds for each source and length, and each source's size and target.

    The rule: ``_passes`` over all its rows, and one more for the rows up to ``_last`` (or for ``_all``).
    """
    spark = rows.sparkSession
    by_length = rows.groupBy("_key", "_size").agg(F.count("*").alias("n"))
    # One row for each source: the targets depend on each other.
    sources = sorted(by_length.groupBy("_key").agg(F.sum(F.col("_size") * F.col("n")).alias("s")).collect(), key=lambda r: r["_key"].encode("utf-32-be"))
    shares = targets([r["s"] for r in sources], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))])
    shared = spark.createDataFrame([(r["_key"], int(r["s"]), float(t)) for r, t in zip(sources, shares, strict=True)], "_key string, source_size long, target double")
    plan = by_length.withColumnRenamed("_size", "size").join(shared, "_key").groupBy("_key").applyInPandas(_plan, "_key string, size long, n long, passes int, extra long")
    plan = materialize(plan.withColumnRenamed("size", "_size"), "lengths")

    # The range of the hash in which a length's count is used up, and the last row taken there.
    split = plan.where("extra > 0 and extra < n").select("_key", "_size", "extra")
    ranges = rows.groupBy("_key", "_size", "_range").agg(F.count("*").alias("m"))
    up_to = Window.partitionBy("_key", "_size").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    edge = ranges.join(split, ["_key", "_size"]).withColumn("_sum", F.sum("m").over(up_to)).where("_sum >= extra and _sum - m < extra")
    edge = edge.select("_key", "_size", "_range", (F.col("extra") - F.col("_sum") + F.col("m")).alias("_left"))
    order = Window.partitionBy("_key", "_size").orderBy("_draw", "_row")
    last = rows.join(edge, ["_key", "_size", "_range"]).withColumn("_n", F.row_number().over(order)).where("_n = _left")
    last = last.select("_key", "_size", F.struct("_range", "_draw", "_row").alias("_last"))
    rule = plan.select("_key", "_size", F.col("passes").alias("_passes"), (F.col("extra") == F.col("n")).alias("_all")).join(last, ["_key", "_size"], "left")
    return materialize(rule, "rules"), shared


def _broadcast(rule: DataFrame) -> DataFrame:
    return F.broadcast(rule) if rule.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rule


def mix(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target, taken (words taken, repeats counted), source for every row of ``docs``.

    Null texts and texts without words have size 0 and take nothing; a null source is a source of its own, the last.
    Rows equal in id and text are told apart by their place in the written narrow table only. Empty table: no rows.
    Texts of any length count whole; other columns are ignored.
    One row per source goes to the driver (there the targets are shared out); documents never do.
    """
    rows = _rows(docs, seed, id_col, text_col, source_col, _id=F.col(id_col), _source=F.col(source_col))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "sizes")
    rule, shared = rules(rows)
    rule = _broadcast(rule)
    more = F.when(F.col("_all") | (F.struct("_range", "_draw", "_row") <= F.col("_last")), 1).otherwise(0)
    return (
        rows.join(rule, ["_key", "_size"])
        .join(shared, "_key")
        .select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * (F.col("_passes") + more)).cast("long").alias("taken"), F.col("_source").alias("source"))
    )


def take(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken (0 to 3 times), columns as they are.

    Rows equal in id and text are taken alike. Texts without words weigh nothing and stay once. Columns may have any
    names; an empty table stays empty.
    """
    # The document travels as one column, so that its own column names can't clash.
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    full = _rows(docs, seed, id_col, text_col, source_col, _doc=whole)
    rows = materialize(_rows(docs, seed, id_col, text_col, source_col).withColumn("_row", F.lit(0)), "sizes")
    rule, _ = rules(rows)
    more = F.when(F.col("_all") | (F.struct("_range", "_draw") <= F.struct("_last._range", "_last._draw")), 1).otherwise(0)
    times = F.when(F.col("_size") == 0, 1).otherwise(F.col("_passes") + more)
    return full.join(_broadcast(rule), ["_key", "_size"]).select("_doc", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("_time")).select("_doc.*")
