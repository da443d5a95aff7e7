"""Severity buckets, systematic samples and seeded splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Values of the order column that are ranked together.
RANGE = 1 << 24
QUOTAS = {"Low (0-30%)": 9, "Medium (30-60%)": 8, "High (>60%)": 8}


def severity(wer: Column) -> Column:
    """(-0.1, 30] low, (30, 60] medium, above high; otherwise null."""
    low, medium, high = QUOTAS
    return F.when((wer > -0.1) & (wer <= 30), low).when((wer > 30) & (wer <= 60), medium).when(wer > 60, high)


def systematic_sample(df: DataFrame, wer: str = "wer_percent", order: str = "id", quotas: dict[str, int] | None = None) -> DataFrame:
    """Of each severity every step-th row by WER (ties by ``order``), up to its quota; with ``sample_id`` from 1, low to high.

    Rows are counted by WER and by range of ``order``; the wanted ranks follow from the sums, and only the rows that
    share a place with one are ranked. WERs are ratios of word counts, so there are far fewer of them than rows.
    """
    quotas = quotas or QUOTAS
    place = F.create_map(*(F.lit(x) for k, (s, q) in enumerate(quotas.items()) for x in (s, k)))
    quota = F.create_map(*(F.lit(x) for s, q in quotas.items() for x in (s, q)))
    rows = df.withColumn("severity", severity(F.col(wer))).where("severity is not null")
    span = F.floor(F.col(order) / RANGE) if isinstance(df.schema[order].dataType, NumericType) else F.lit(0).cast("long")
    rows = rows.withColumn("_span", span)
    at = ["severity", wer, "_span"]
    counts = rows.groupBy(*at).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("severity")
    sums = counts.withColumns({"_end": F.sum("_n").over(whole.orderBy(wer, "_span")), "_size": F.sum("_n").over(whole)})
    step = F.greatest(F.lit(1), F.floor(F.col("_size") / F.least("_quota", "_size")))
    sums = sums.withColumn("_quota", quota[F.col("severity")].cast("long")).withColumn("_step", step)
    ranks = F.transform(F.sequence(F.lit(0).cast("long"), F.least("_quota", "_size") - 1), lambda k: k * F.col("_step") - F.col("_end") + F.col("_n"))
    wanted = sums.select(*at, F.filter(ranks, lambda r: (r >= 0) & (r < F.col("_n"))).alias("_ranks")).where(F.size("_ranks") > 0)
    # At most the quotas' sum of places, and of rows to number in the end.
    near = rows.join(F.broadcast(wanted), at)
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*at).orderBy(order)) - 1)
    taken = ranked.where(F.array_contains("_ranks", F.col("_rank").cast("long")))
    return taken.withColumn("sample_id", F.row_number().over(Window.orderBy(place[F.col("severity")], wer, order))).drop("_rank", "_ranks", "_span")


def seeded_sample(df: DataFrame, key: str, most: int = 50) -> DataFrame:
    """The ``most`` rows with the least md5 of the key: the same on every run and engine."""
    return df.orderBy(F.md5(F.encode(F.col(key).cast("string"), "UTF-8")), key).limit(most)


def split(df: DataFrame, key: str, train: int = 90) -> DataFrame:
    """A ``split`` column: ``train`` of a hundred parts by the key's md5, the others ``test``."""
    part = F.conv(F.substring(F.md5(F.encode(F.col(key).cast("string"), "UTF-8")), 1, 6), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(part < train, "train").otherwise("test"))
