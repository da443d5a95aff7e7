"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and a further shard only takes rows.

A row's shard follows from its key and the number of shards alone, so equal texts go wherever their ids go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

#: Rows of one slot-numbering group.
BUCKET_ROWS = 1 << 20
# Fixed value of the published algorithm.
_MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; all keys jump together until none moves."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    while len(moving):
        at[moving] = ahead[moving]
        key[moving] = key[moving] * _MULTIPLIER + np.uint64(1)
        ahead[moving] = ((at[moving] + 1) * (float(1 << 31) / ((key[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return at.astype(np.int32)


def _assign(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(jump_hash(key, shards)), pa.array(jump_hash(key, shards + 1))], [*batch.schema.names[1:], "shard", "grown_shard"])

    return run


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    size is UTF-8 bytes + 1 (null text: 1), slots count from 0 within a shard without gaps: bucket by bucket (a hash of
    id, crc and size), inside by the key's hash, id, crc and size; rows equal in all of these take neighbouring slots. grown_shard is the shard among
    ``shards + 1``. A null id is a key like any other. Only narrow rows are shuffled, into groups of about 2**20 rows.
    """
    text = text_or_empty(text_col)
    # The key hash goes with size and crc into the bucket, so that repeated ids still spread.
    narrow = docs.select(F.xxhash64(F.col(id_col)).alias("_key"), F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    kind = narrow.schema["_id"].dataType.simpleString()
    placed = narrow.select("_key", F.col("_key").alias("_hash"), "_id", "size", "text_crc32").mapInArrow(_assign(shards), f"_hash long, _id {kind}, size long, text_crc32 long, shard int, grown_shard int")
    buckets = max(16, docs.count() // (shards * BUCKET_ROWS) + 1)
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("_id", "text_crc32", "size"), F.lit(buckets)))
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    # At most shards * buckets rows, one for about a million of the input.
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_hash", "_id", "text_crc32", "size")
    slots = placed.withColumn("_row", F.row_number().over(inside)).join(F.broadcast(starts), ["shard", "_bucket"])
    return slots.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard")
