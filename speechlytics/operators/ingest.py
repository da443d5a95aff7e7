"""Segments of recordings: URLs, transcripts, gating, signals, catalog statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

SHORTEST, LONGEST = 1.0, 30.0
SEGMENT = "array<struct<text:string,start:double,end:double>>"


def fallback_url(url: Column, host: str, pattern: str) -> Column:
    """The same recording under another host; null for URLs that ``pattern`` isn't in. Its two groups are the path kept."""
    return F.when(url.rlike(pattern), F.concat(F.lit(host), F.regexp_extract(url, pattern, 1), F.lit("/"), F.regexp_extract(url, pattern, 2)))


def sibling_urls(transcription: Column) -> Column:
    """The audio and metadata files that may lie beside a transcription, in the order to try."""
    return F.array(*(F.replace(transcription, F.lit("_transcription.json"), F.lit(s)) for s in (".wav", ".mp3", "_metadata.json")))


def download_tasks(catalog: DataFrame) -> DataFrame:
    """Two tasks (url, dest, label) for each recording."""
    rid = F.col("recording_id").cast("string")
    tasks = F.array(
        F.struct(F.col("rec_url_gcp").alias("url"), F.concat(rid, F.lit("_audio.wav")).alias("dest"), F.lit("audio").alias("label")),
        F.struct(F.col("transcription_url_gcp").alias("url"), F.concat(rid, F.lit("_transcription.json")).alias("dest"), F.lit("transcription").alias("label")),
    )
    return catalog.select("recording_id", F.explode(tasks).alias("t")).select("recording_id", "t.*")


def parse_segments(json: Column) -> Column:
    """A JSON list of segments, or a single one."""
    text = strip(json)
    return F.from_json(F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text), SEGMENT)


def segments(recordings: DataFrame, col: str = "segments", rid: str = "recording_id", shortest: float = SHORTEST, longest: float = LONGEST) -> DataFrame:
    """A manifest row for each usable segment: audio file, sentence, duration; the file's number counts skipped segments too."""
    each = recordings.select(F.col(rid), F.posexplode(col).alias("pos", "s"))
    start = F.coalesce("s.start", F.lit(0.0))
    each = each.select(rid, "pos", strip(F.coalesce("s.text", F.lit(""))).alias("sentence"), start.alias("start"), F.coalesce("s.end", F.lit(0.0)).alias("end"))
    each = each.withColumn("duration_s", F.col("end") - F.col("start"))
    each = each.where((F.col("sentence") != "") & F.col("duration_s").between(shortest, longest))
    return each.withColumn("audio", F.format_string("%s_seg%04d.wav", F.col(rid).cast("string"), "pos"))


def slice_samples(signal: Column, start: Column, end: Column, rate: int) -> Column:
    first = (start * rate).cast("int")
    return F.slice(signal, first + 1, F.greatest((end * rate).cast("int") - first, F.lit(0)))


def peak_normalize(signal: Column, peak: float = 0.95) -> Column:
    """Scaled so that the largest magnitude is ``peak``; silence stays."""
    top = F.array_max(F.transform(signal, lambda x: F.abs(x.cast("double"))))
    return F.transform(signal, lambda x: F.when(top > 0, x.cast("double") / top * peak).otherwise(x.cast("double")))


def duration_stats(df: DataFrame, col: str = "duration_s") -> DataFrame:
    d = F.col(col)
    return df.agg(F.count("*").alias("n"), F.sum(d).alias("total_s"), (F.sum(d) / 3600).alias("hours"), F.avg(d).alias("mean_s"), F.median(d).alias("median_s"), F.min(d).alias("min_s"), F.max(d).alias("max_s"))


def usable(signal: Column, rate: int, shortest: float = SHORTEST, longest: float = LONGEST) -> Column:
    """Whether a slice (or what trimming left of it) holds samples and lasts as long as a segment may."""
    return (F.size(signal) > 0) & (F.size(signal) / rate).between(shortest, longest)


def with_files(df: DataFrame, files: DataFrame, *columns: str) -> DataFrame:
    """The rows all of whose ``columns`` name a file of the one-column listing ``files``."""
    listed = files.toDF("_file").distinct()
    for c in columns:
        df = df.join(listed, df[c] == listed["_file"], "left_semi")
    return df


def outcomes(df: DataFrame, ok: Column, *by: str) -> DataFrame:
    """How many rows succeeded and how many failed; a null counts as failed."""
    return df.groupBy(*by).agg(F.count_if(F.coalesce(ok, F.lit(False))).alias("succeeded"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"))


def json_schema(json: Column) -> Column:
    """The schema of a JSON text, as a type."""
    return F.schema_of_variant(F.parse_json(json))
