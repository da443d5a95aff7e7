"""From ``documents`` to sharded training data: toxicity, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from speechlytics.llm import decontaminate, mixing, sharding, simhash, toxicity
from speechlytics.llm.common import bound_batches, materialize, table

#: Bytes of an Arrow batch of whole documents. Stages are lazy, so those that send documents to Python leave the session at this bound.
BATCH_BYTES = 4 << 20

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    bound_batches(spark, BATCH_BYTES)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their SimHash, the one with the smallest id stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    bound_batches(spark, BATCH_BYTES)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document comes as often as the mix takes it."""
    return mixing.take(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot in it for every row of the mix."""
    return sharding.shard(docs)


STAGES = [("toxicity", toxic), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix), ("sharding", shard)]

#: Two stages are trained or iterate: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, BATCH_BYTES)
    return STAGES[-1][1](spark, docs, sf_dir)
