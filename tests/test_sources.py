import pytest
from pyspark.sql import functions as F

from speechlytics.operators import lattice
from speechlytics.sources import readers
from speechlytics.streaming import transcripts


def test_csv_round_trip_and_aliases(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿Ref , Hyp,WER\n\"a, b\",a b,10\n", encoding="utf-8")
    df = readers.predictions(spark, str(tmp_path / "p.csv"))
    assert df.columns == ["reference", "prediction", "wer_percent"]
    assert df.first().reference == "a, b"
    readers.write_csv(df, str(tmp_path / "out"))
    assert readers.csv(spark, str(tmp_path / "out")).collect() == df.collect()


def test_word_list(spark, tmp_path):
    (tmp_path / "x.txt").write_text("# c\n123\nघर/AB\n घर \nhello\n%x\n\nकर\n", encoding="utf-8")
    (tmp_path / "dict_y.txt").write_text("बात\n", encoding="utf-8")
    assert sorted(r.word for r in readers.extra_dictionaries(spark, str(tmp_path)).collect()) == ["कर", "घर"]


def test_json_files(spark, tmp_path):
    (tmp_path / "7_transcription.json").write_text('[{"text": "a"}]')
    assert readers.json_segments(spark, str(tmp_path)).collect()[0].asDict() == {"recording_id": "7", "json": '[{"text": "a"}]'}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("तीन सौ लोग", "x")], "text string, source string").write.parquet(str(tmp_path / "in"))
    stream = transcripts.post_processed(spark.readStream.schema("text string, source string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").select(F.col("numbers_converted")).first()[0] == "300 लोग"


def test_tables_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "c.csv").write_text("user_id,recording_id,language,duration,rec_url_gcp,transcription_url_gcp,metadata_url_gcp\n1,2,hi,30,u,t,m\n", encoding="utf-8")
    assert readers.catalog(spark, str(tmp_path / "c.csv")).first().duration == 30
    (tmp_path / "m.csv").write_text("path,text,duration\na.wav,x,1.5\nb.wav,y,2\n", encoding="utf-8")
    assert readers.manifest(spark, str(tmp_path / "m.csv")).columns == ["audio", "sentence", "duration_s"]
    assert readers.manifest(spark, str(tmp_path / "m.csv"), 1).first().audio == "a.wav"
    (tmp_path / "t.csv").write_text("id,prediction\n1,घर\n", encoding="utf-8")
    assert readers.texts(spark, str(tmp_path / "t.csv"))[1] == "prediction"
    with pytest.raises(ValueError):
        readers.texts(spark, str(tmp_path / "c.csv"))
    (tmp_path / "w.csv").write_text("any name,x\nघर,1\nघर,2\n,3\n", encoding="utf-8")
    assert [r.word for r in readers.first_column(spark, str(tmp_path / "w.csv")).collect()] == ["घर"]
    (tmp_path / "wide.csv").write_text("Human,Model A,Model B,other\na b,a b,,z\n", encoding="utf-8")
    wide = readers.wide_models(spark, str(tmp_path / "wide.csv"))
    assert wide.first()["Model B"] == ""
    got = lattice.by_model(lattice.model_errors(lattice.bins(lattice.wide_to_models(wide)))).orderBy("model").collect()
    assert [(r.model, r.errors) for r in got] == [("Model A", 0), ("Model B", 2)]
    readers.write_dataset(wide, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).collect() == wide.collect()


def test_running_wer(spark, tmp_path):
    rows = [("a b", "a x", "m"), ("c", "c", "m"), ("d e", "d e f", "n")]
    spark.createDataFrame(rows, "reference string, prediction string, model string").write.parquet(str(tmp_path / "in"))
    stream = transcripts.running_wer(spark.readStream.schema("reference string, prediction string, model string").parquet(str(tmp_path / "in")), by=("model",))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("wers").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.model: (r.errors, r.words) for r in spark.table("wers").collect()} == {"m": (1, 3), "n": (1, 2)}
