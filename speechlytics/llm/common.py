"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list = []
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='speechlytics-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession, batch_bytes: int) -> str:
    """From now on, Arrow batches of the session end at about so many bytes, which a Python stage and the JVM each hold a few times; what held before."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(batch_bytes))
    return before


def materialize(df: DataFrame, name: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    The files go with ``discard``, or when the driver's Python ends, since lazy results may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = bound_batches(spark, batch_bytes)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    if not _WRITTEN:
        atexit.register(_clean)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN.append((out, spark, path))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these, once no lazy result needs it."""
    for df in frames:
        path = next(p for k, _, p in _WRITTEN if k is df)
        _delete(df.sparkSession, path)
        _WRITTEN[:] = [w for w in _WRITTEN if w[0] is not df]


def _clean() -> None:
    for _, spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


#: A key is frequent if it has over FREQUENT rows and over one in 2 ** SHARE of all: at most 2 ** SHARE keys.
FREQUENT, SHARE = 1 << 8, 14


def join_by_key(rows: DataFrame, keyed: DataFrame, on: list[str], n: str) -> DataFrame:
    """``rows`` joined with ``keyed``, which has a row for each key with its number of rows in column ``n`` (dropped).

    Frequent keys are broadcast, at most 2 ** SHARE of them; the others are joined by hash.
    """
    much = max(FREQUENT, (keyed.agg(F.sum(n)).first()[0] or 0) >> SHARE)
    many = F.broadcast(keyed.where(F.col(n) > much).drop(n))
    rest = rows.join(many, on, "left_anti").join(keyed.where(F.col(n) <= much).drop(n), on)
    return rest.unionByName(rows.join(many, on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filtered(docs: DataFrame, text_col: str, keep: Callable[[Iterator[pa.RecordBatch], str], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs`` through an Arrow stage that drops rows; it gets batches and the text column's place-holder name. Column names may hold anything."""
    safe = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    text = f"c{docs.columns.index(text_col)}"
    return safe.mapInArrow(lambda batches: keep(batches, text), safe.schema).toDF(*docs.columns)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def utf8(col: str = "text") -> Column:
    """Text as UTF-8 bytes, null as none: what the Arrow stages split, with ``bytes`` methods that touch ASCII only."""
    return F.encode(text_or_empty(col), "UTF-8")


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``, so that a stage's memory doesn't follow text length."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if col.nbytes <= most:
            yield batch
            continue
        start, held = 0, 0
        for i, value in enumerate(col):
            n = len(value.as_buffer()) if value.is_valid else 0
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
