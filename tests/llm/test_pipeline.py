import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from speechlytics.llm import queries, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert out.count() > 0
    assert corpus_pipeline.toxic(spark, docs, DATA).columns == names


def test_names():
    found = queries.queries()
    assert {n.split("_")[0] for n in found} == {*(f"op{k}" for k in range(1, 11)), "pipeline"}
    assert set(queries.oracle_sql()) <= set(found)


@pytest.mark.parametrize("stage", [corpus_pipeline.toxic, corpus_pipeline.decontamination])
def test_batches_of_documents_are_bounded(spark, stage):
    """The stages' lazy results are written by the caller, so the bound on Arrow batches must still hold then."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    try:
        docs = spark.range(0, 1000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 4000) AS text", "'en' AS lang", "'web' AS source", "20000L AS n_chars")
        assert stage(spark, docs, DATA).count() == 1000
        got = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]}) for b in batches), "rows long, size long").collect()
        assert sum(r.rows for r in got) == 1000
        assert max(r.size for r in got) <= 2 * corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_toxic_rows_are_scored_in_parts(spark, monkeypatch):
    """Of a batch of 4 MB no more than ``PART`` is split at a time, and every row is scored."""
    stages, parts, split = [], [], toxicity.sentences
    monkeypatch.setattr(toxicity, "filtered", lambda docs, text, run: stages.append(run))
    monkeypatch.setattr(toxicity, "sentences", lambda texts: (parts.append(sum(map(len, texts))), split(texts))[1])
    weights = np.zeros(toxicity.HASHED + 1, np.float32)
    weights[-1] = -6
    weights[split([b"vile"])[0][0]] = 20
    toxicity.drop_toxic(None, weights)
    texts = [f"{'fine ' * 1000}{'vile' if k % 7 == 0 else 'good'}" for k in range(800)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "text": texts})
    assert batch.nbytes < 4 << 20
    kept = [k for b in stages[0](iter([batch]), "text") for k in b.column(0).to_pylist()]
    assert kept == [k for k in range(len(texts)) if k % 7 or k >= 800]
    assert max(parts) <= toxicity.PART and sum(parts) == sum(len(x or "") for x in texts)
