"""What both classifiers share: which rows they may learn from, and a bounded sample of them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fitted(packed: DataFrame, fit: Callable[[list[dict]], Any]) -> Any:
    """``fit`` of the sample's rows, run in one task: the sample is bounded, and the driver only gets the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    got = packed.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([])


def fold(folds: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds, F.lit(-1)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int, held_out: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 1 << 26, **columns: Column) -> DataFrame:
    """(_id, the given columns of ``docs``, a 0/1 _label): at most ``most`` labelled ids outside the held-out fold, those with the least hash of the id.

    It ends where their texts reach ``most_bytes``. Repeated labels count once, the larger wins; null labels and ids
    don't count. The narrow sample is bounded, so it is broadcast.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label is not null")
    known = known.where(fold(folds, "_id") != held_out).groupBy("_id").agg(F.max("_label").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    sizes = docs.select(F.col(id_col).alias("_id"), F.octet_length(text_col).alias("_size"))
    sizes = sizes.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("_size"))
    # At most ``most`` narrow rows.
    before = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, -1)
    chosen = sizes.withColumn("_before", F.sum("_size").over(before)).where(F.coalesce("_before", F.lit(0)) < most_bytes).select("_id", "_label")
    return docs.select(F.col(id_col).alias("_id"), *(c.alias(k) for k, c in columns.items())).join(F.broadcast(chosen), "_id")
