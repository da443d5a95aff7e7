"""SimHash near-dedup with covering locality-sensitive hashing (Pagh, 2016).

Fingerprints are 64 bits; two texts are linked if at most ``RADIUS`` bits differ. Each bit position gets a non-zero
vector of RADIUS + 1 bits; for every non-zero vector v there is a table keyed by the positions whose vector has an odd
product with v. Up to RADIUS differing positions span less than the whole space, so some v is orthogonal to them all:
every pair within the radius meets in some table. Nothing is sampled, and nothing within the radius can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, materialize, small_batches, utf8
from .components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Buckets up to this size are compared pair by pair.
SMALL = 8
#: Larger buckets are searched breadth first: each text against the rest, or (from this size) by its possible neighbours.
DENSE = 1 << 13


def masks(radius: int = RADIUS) -> list[int]:
    """One 64-bit mask for each table: 2 ** (radius + 1) - 1 of them, each with about half of the bits."""
    codes = [1 + i % ((2 << radius) - 1) for i in range(64)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() & 1) for v in range(1, 2 << radius)]


_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit j is set if it is in over half of the shingles' XXH64; 0 for a text without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), parts), np.uint64)
    if len(hashes) < 64:
        ones = ((hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)
    else:
        columns = hashes.view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(columns[:, b], minlength=256) @ _BYTE_BITS for b in range(8)])
    return int(np.packbits(2 * ones.astype(np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "_text"):
        prints = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, fp) of every row, written once: the only stage that reads texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    return materialize(docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_text")).mapInArrow(_fingerprints, f"_id {kind}, fp long"), "simhash")


def _spread(prints: np.ndarray, radius: int, mask: int) -> Iterator[tuple[int, int]]:
    """Links that hold one bucket's texts together as far as their distances do: a breadth-first tree of each part."""
    flips = None
    if len(prints) > DENSE:  # bucket mates agree on the mask's bits
        free = [1 << i for i in range(64) if not mask >> i & 1]
        flips = np.array([sum(c) for n in range(1, radius + 1) for c in combinations(free, n)], np.uint64)
    left = np.sort(prints)
    open_ = np.ones(len(left), bool)
    for k in range(len(left)):
        if not open_[k]:
            continue
        open_[k] = False
        front = [k]
        while front:
            at = front.pop()
            if flips is None:
                near = np.flatnonzero(open_ & (np.bitwise_count(left ^ left[at]) <= radius))
            else:
                wanted = left[at] ^ flips
                where = np.minimum(np.searchsorted(left, wanted), len(left) - 1)
                near = where[(left[where] == wanted) & open_[where]]
            open_[near] = False
            front += near.tolist()
            for j in near:
                yield int(left[at]), int(left[j])


def _links(radius: int):
    masked = masks(radius)

    def closed(table: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """Of whole buckets, sorted: links within the radius."""
        u, v = [], []
        starts = np.flatnonzero(np.concatenate(([True], (table[1:] != table[:-1]) | (key[1:] != key[:-1]))))
        sizes = np.diff(np.append(starts, len(fp)))
        bucket = np.repeat(np.arange(len(starts)), sizes)
        small = np.flatnonzero((sizes > 1)[bucket] & (sizes <= SMALL)[bucket])
        b, f = bucket[small], fp[small]
        for shift in range(1, SMALL):
            near = (b[shift:] == b[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= radius)
            u.append(f[shift:][near])
            v.append(f[:-shift][near])
        for k in np.flatnonzero(sizes > SMALL):
            own = slice(starts[k], starts[k] + sizes[k])
            links = np.array(list(_spread(fp[own], radius, masked[table[starts[k]]])), np.uint64).reshape(-1, 2)
            u.append(links[:, 0])
            v.append(links[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64)]
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = [np.concatenate((a, b.view(a.dtype))) for a, b in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            table, key, _ = held
            cut = len(key) - int(np.argmax(((table != table[-1]) | (key != key[-1]))[::-1])) if table[0] != table[-1] or key[0] != key[-1] else 0
            if cut:
                yield closed(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield closed(*held)

    return run


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, number of its rows, first id reachable) for every distinct ``fp`` of (_id, fp)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")), "distinct")
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for t, m in enumerate(masks(radius)))))
    keyed = distinct.select("fp", tables.alias("_t")).select("_t.t", "_t.key", "fp")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = keyed.repartition(n, "t", "key").sortWithinPartitions("t", "key").mapInArrow(_links(radius), "u long, v long")
    linked = components(links)
    named = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "_first", "_n", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("_first").alias("component_id"))
    return materialize(named.join(least, "component").select("fp", "_n", "component_id"), "classes")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    A-Z is lower-cased; words are runs without ASCII white space; fewer words than a shingle: the whole sequence; null,
    empty or blank texts: fingerprint zero, linked like any other. component_id is the smallest id reachable over links
    (null ids don't count; null if there are only such). Repeated rows share all they have. Other columns are ignored;
    texts of any length count whole; an empty table gives no rows.
    """
    prints = fingerprints(docs, id_col, text_col)
    return join_by_key(prints, classes(prints, radius), ["fp"], "_n").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest; columns as they are.

    Of repeated rows (same id and text) one stays. Rows with a null id are kept as they are: nothing names them. Other
    columns may have any names; texts of any length count whole; an empty table stays empty.
    """
    prints = fingerprints(docs, id_col, text_col).where("_id is not null")
    found = join_by_key(prints, classes(prints, radius), ["fp"], "_n")
    gone = materialize(found.where(F.col("_id") != F.col("component_id")).select(F.col("_id").alias(id_col)).distinct(), "gone")
    own = [f"`{c}`" for c in docs.columns]
    out = docs.join(gone, id_col, "left_anti").select(*own)
    twice = prints.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_id").alias(id_col))
    if not twice.isEmpty():
        once = out.join(twice, id_col, "left_semi").dropDuplicates([id_col, text_col])
        out = out.join(twice, id_col, "left_anti").select(*own).unionByName(once.select(*own))
    return out
