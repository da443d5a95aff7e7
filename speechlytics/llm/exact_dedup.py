"""Exact dedup: Golomb-coded fingerprint exchange.

1. Each partition sorts the 48-bit fingerprints of its texts and sends one Golomb-Rice coded message to each owner
   (an owner holds one range of fingerprints). Copies inside a partition are sent once, with a bit that says so.
2. Each owner merges its messages and answers each sender with a bitmap: bit i is set if the i-th fingerprint of that
   message is in doubt (also in another message, or several times in its own).
3. Senders turn bitmaps into suspect fingerprints. Only rows with a suspect fingerprint are shuffled: narrow, to be
   grouped by fingerprint and SHA-256, and with their whole texts, to be verified byte by byte against one text of the
   group, in parts of a bounded number of rows. A shared hash of different texts costs time, never a wrong merge.

A message is about log2(range / n) + 2 bits a fingerprint. Owners get at most one entry for each text and sender, so a
group of copies that holds a third of all rows is spread before anything meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FREQUENT, SHARE, join_by_key, materialize, text_or_empty

BITS = 48
#: Fingerprints that one sender codes at once (8 MB).
SENDER_ROWS = 1 << 20
#: Suspect fingerprints that are broadcast at most (8 bytes each); beyond, the join shuffles.
BROADCAST_SUSPECTS = 1 << 20


def golomb_encode(values: np.ndarray, span: int) -> bytes:
    """Sorted distinct values in [0, span) -> bytes: n, Rice parameter, unary quotients, remainders."""
    n = len(values)
    k = max(0, int(np.floor(np.log2(span / n * 0.69)))) if n else 0
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8)
    return np.array([n, k, len(unary)], "<u4").tobytes() + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    n, k, m = (int(x) for x in np.frombuffer(data, "<u4", 3))
    at = 12 + (m + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data[12:at], np.uint8), count=m))
    high = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(data[at:], np.uint8), count=n * k).reshape(n, k).astype(np.int64)
    low = rest @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else np.zeros(n, np.int64)
    return np.cumsum((high << k) + low + 1) - 1


def _send(owner_bits: int):
    span = 1 << (BITS - owner_bits)

    def messages(part: list[np.ndarray], sender: str) -> Iterator[dict]:
        values, counts = np.unique(np.concatenate(part), return_counts=True)
        owners = values >> (BITS - owner_bits)
        cuts = np.flatnonzero(np.diff(owners)) + 1
        for v, c in zip(np.split(values, cuts), np.split(counts, cuts), strict=True):
            yield {"owner": int(v[0]) >> (BITS - owner_bits), "sender": sender, "payload": golomb_encode(v & (span - 1), span), "repeated": np.packbits(c > 1).tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        held, rows, k = [], 0, 0
        schema = pa.schema([("owner", pa.int64()), ("sender", pa.string()), ("payload", pa.binary()), ("repeated", pa.binary())])
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            rows += batch.num_rows
            if rows >= SENDER_ROWS:
                yield pa.RecordBatch.from_pylist(list(messages(held, f"{here}.{k}")), schema)
                held, rows, k = [], 0, k + 1
        if rows:
            yield pa.RecordBatch.from_pylist(list(messages(held, f"{here}.{k}")), schema)

    return run


def _own(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one owner: a bitmap for each sender that has a fingerprint in doubt."""
    coded = [golomb_decode(x) for x in frame["payload"]]
    values, counts = np.unique(np.concatenate(coded), return_counts=True)
    double = values[counts > 1]
    out = []
    for owner, sender, mine, repeated in zip(frame["owner"], frame["sender"], coded, frame["repeated"], strict=True):
        bits = np.isin(mine, double, assume_unique=True) | np.unpackbits(np.frombuffer(repeated, np.uint8), count=len(mine)).astype(bool)
        if bits.any():
            out.append((owner, sender, np.packbits(bits).tobytes()))
    return pd.DataFrame(out, columns=["owner", "sender", "bitmap"])


def _receive(owner_bits: int):
    """Senders read their messages again beside the bitmaps: the fingerprints whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, payload, bitmap in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                mine = golomb_decode(payload)
                keep = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(mine)).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(mine[keep] + (owner << (BITS - owner_bits)))], ["fp"])

    return run


def suspects(fingerprints: DataFrame, owner_bits: int | None = None) -> DataFrame:
    """``fp`` (48-bit long) of many rows -> the distinct ``fp`` that occur at least twice, by the exchange above."""
    spark = fingerprints.sparkSession
    if owner_bits is None:
        owner_bits = max(3, min(16, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    sent = materialize(fingerprints.select("fp").mapInArrow(_send(owner_bits), "owner long, sender string, payload binary, repeated binary"), "fingerprints")
    answers = sent.groupBy("owner").applyInPandas(_own, "owner long, sender string, bitmap binary")
    got = sent.join(answers, ["owner", "sender"]).select("owner", "payload", "bitmap")
    return materialize(got.mapInArrow(_receive(owner_bits), "fp long").distinct(), "suspects")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. The largest id of equal texts stays. Repeated rows (same
    id, same text): one is kept. A null id loses against any other; a group of null ids keeps one row, with a null
    keep_id. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.shiftrightunsigned(F.xxhash64(text), 64 - BITS).alias("fp"))
    doubt = suspects(rows)
    few = doubt.limit(BROADCAST_SUSPECTS + 1).count() <= BROADCAST_SUSPECTS
    doubt = F.broadcast(doubt) if few else doubt
    sha = F.sha2(F.encode("_text", "UTF-8"), 256).alias("text_sha256")
    alone = rows.join(doubt, "fp", "left_anti").select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)

    # Groups come from narrow rows; every suspect's bytes are then held against one text of its group.
    held = rows.join(doubt, "fp", "left_semi").select("_id", "_text", "fp", sha)
    copies = materialize(held.groupBy("fp", "text_sha256", "_id").agg(F.count("*").alias("_n")), "copies")
    key = ["fp", "text_sha256"]
    groups = materialize(copies.groupBy(*key).agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"), F.count("*").alias("_ids")), "groups")
    # Frequent groups, at most 2 ** SHARE, are verified in salted parts.
    much = max(FREQUENT, (groups.agg(F.sum("group_size")).first()[0] or 0) >> SHARE)
    parts = F.broadcast(groups.where(F.col("group_size") > much).select(*key, F.ceil(F.col("group_size") / much).alias("_parts")))
    salted = held.join(parts, key, "left").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    texts = held.groupBy(*key).agg(F.first("_text").alias("_same")).join(groups.where("group_size > 1").select(*key), key, "left_semi")
    texts = texts.join(parts, key, "left").select(*key, "_same", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1)).alias("_salt"))
    differ = salted.join(texts, [*key, "_salt"]).where("_text <> _same").select(*key)
    if differ.count():  # texts that share both hashes: grouped by their bytes
        differ = materialize(differ.distinct(), "differ")
        exact = held.join(differ, key, "left_semi").groupBy("_text", *key, "_id").agg(F.count("*").alias("_n"))
        # The text itself takes the place of its hash in the key.
        named = lambda df: df.withColumn("fp", F.concat(F.col("fp").cast("string"), F.lit(" "), "_text")).drop("_text")
        copies = copies.join(differ, key, "left_anti").withColumn("fp", F.col("fp").cast("string")).unionByName(named(exact))
        groups = copies.groupBy(*key).agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"), F.count("*").alias("_ids"))
    met = join_by_key(copies, groups, key, "_ids")
    each = met.select("_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_i"))
    together = each.select(F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"), "text_sha256")
    return alone.unionByName(together)
