"""Sources and sinks. CSV headers may differ between files; a byte-order mark is dropped on reading and not written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mostly_devanagari, strip

CATALOG = "user_id long, recording_id long, language string, duration int, rec_url_gcp string, transcription_url_gcp string, metadata_url_gcp string"
TEXT_COLUMNS = ("text", "raw_asr_output", "prediction", "hypothesis")
_PREDICTIONS = {"reference": ("reference", "ref", "ground_truth"), "prediction": ("prediction", "hypothesis", "hyp", "pred"), "wer_percent": ("wer_percent", "wer_score", "wer")}
_MANIFEST = {"audio": ("audio", "audio_file", "path", "file"), "sentence": ("sentence", "text", "reference"), "duration_s": ("duration_s", "duration")}


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def renamed(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """The first header found of each name's aliases, ignoring case and outer blanks, gets the name."""
    heads = {c.strip().lower(): c for c in reversed(df.columns)}
    found = {heads[a]: name for name, known in aliases.items() if (a := next((k for k in known if k in heads), None))}
    return df.withColumnsRenamed(found)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, CATALOG)


def manifest(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    df = renamed(csv(spark, path), _MANIFEST)
    return df.limit(n) if n else df


def texts(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The table and the name of its text column; an error if it has none."""
    df = csv(spark, path)
    found = next((c for c in TEXT_COLUMNS if c in df.columns), None)
    if not found:
        raise ValueError(f"none of {', '.join(TEXT_COLUMNS)} is among {', '.join(df.columns)}")
    return df, found


def first_column(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-null values of the first column, as ``word``."""
    df = csv(spark, path)
    return df.select(F.col(f"`{df.columns[0]}`").alias("word")).dropna().distinct()


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return renamed(csv(spark, path), _PREDICTIONS)


def wide_models(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path).na.fill("")


def json_segments(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, json) of each file of a folder; ``ingest.parse_segments`` reads the text."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").withColumnRenamed("value", "json")
    return df.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_transcription)?\.json$", 1).alias("recording_id"), "json")


def parse_word_list(lines: DataFrame, col: str = "value") -> DataFrame:
    """Words of plain or hunspell lists: no comments, flags, numbers, or words that aren't mostly Devanagari."""
    line = strip(F.col(col))
    words = lines.where((line != "") & ~line.rlike("^[#%]")).select(strip(F.split(line, "/")[0]).alias("word"))
    return words.where((F.col("word") != "") & ~F.col("word").rlike(r"^\d+$") & mostly_devanagari(F.col("word"))).distinct()


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_word_list(spark.read.text(path))


def extra_dictionaries(spark: SparkSession, folder: str) -> DataFrame:
    """Every *.txt of a folder but those called dict_*."""
    lines = spark.read.text(folder, pathGlobFilter="*.txt").where(~F.input_file_name().rlike(r"/dict_[^/]*$"))
    return parse_word_list(lines)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
