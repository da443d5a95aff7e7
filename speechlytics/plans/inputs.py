"""Deterministic transcripts made from the driver's tables, for the queries and their oracles alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, tokenize

MODELS = 6
#: Syllables that Devanagari test words are made of.
SYLLABLES = "क|का|मि|री|सु|ने|हो|पा|जि|ल|था|दे"
#: Loanword sentences by remainder.
SENTENCES = "नई वेबसाइट कल खुलेगी|टीवी पर वीडियो देखना ठीक नहीं|यह लैपटॉप और वह सर्वर, दोनों broken हैं|check-in कब होगा"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ref, models): benchmark items and six altered versions of each."""
    base = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), tokenize(F.coalesce("text", F.lit(""))).alias("ref"))

    def version(k: int):
        placed = F.transform("ref", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        if k != 5:
            placed = F.filter(placed, lambda x: (x["i"] * 31 + F.col("id") + 7 * k) % 11 != 0)
        rule, tail = {4: (lambda i: (i * 13 + F.col("id")) % 19, "z"), 5: (lambda i: (i * 5 + F.col("id")) % 23, "v")}.get(k, (lambda i: (i * 17 + F.col("id")) % 7, "q"))
        return F.transform(placed, lambda x: F.when(rule(x["i"]) == 0, F.concat(x["w"], F.lit(tail))).otherwise(x["w"]))

    return base.withColumn("models", F.array(*(F.struct(F.lit(f"Model {k}").alias("model"), version(k).alias("words")) for k in range(MODELS))))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, k, ref, hyp), one row for each item and model."""
    each = models(spark, sf_dir).select("id", "ref", F.posexplode("models").alias("k", "m"))
    return each.select("id", "k", "ref", F.col("m.words").alias("hyp"))


def hindi_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two or three syllables by part key, some with a fault."""
    syllable = lambda n: F.split_part(F.lit(SYLLABLES), F.lit("|"), (n % 12 + 1).cast("int"))
    k = F.col("p_partkey")
    word = F.concat(syllable(k), syllable(F.floor(k / 12)), F.when(k % 3 == 0, syllable(F.floor(k / 5))).otherwise(""))

    def faulty(word):
        return (
            F.when(k % 29 == 0, F.concat(word, F.lit("ाी"))).when(k % 31 == 0, F.concat(word, F.lit("्"))).when(k % 37 == 0, F.concat(F.lit("ि"), word))
            .when(k % 41 == 0, F.concat(word, F.lit("a"))).when(k % 43 == 0, F.concat(word, F.lit("ककक"))).when(k % 47 == 0, F.concat(word, F.lit("_"), word))
            .when(k % 53 == 0, F.lit("word")).when(k % 59 == 0, F.concat(F.lit("अा"), word)).when(k % 61 == 0, F.repeat(word, 6)).otherwise(word)
        )

    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), let(word, faulty).alias("word"))


def hindi_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ref, hyp) of four words each, made different in one of several ways."""
    words = hindi_words(spark, sf_dir)
    k = F.col("id")

    def heard(ref):
        return (
            F.when(k % 8 == 0, F.replace(ref, F.lit("ना"), F.lit("नी"))).when(k % 8 == 1, F.concat(ref, F.lit(" है"))).when(k % 8 == 2, F.replace(ref, F.lit("बात"), F.lit("बात्म")))
            .when(k % 8 == 3, F.concat(F.lit("तीन "), ref)).when(k % 8 == 4, F.concat(ref, F.lit(" Mobile फोन"))).when(k % 8 == 5, F.concat(ref, F.lit(" रामपुर रामपुर")))
            .when(k % 8 == 6, F.replace(ref, F.lit("बात"), F.lit("सड़कें"))).otherwise(ref)
        )

    said = let(F.col("word"), lambda w: F.concat_ws(" ", F.lit("यह"), w, F.lit("बात"), F.concat(w, F.lit("ना"))))
    both = let(said, lambda ref: F.struct(ref.alias("ref"), heard(ref).alias("hyp")))
    return words.select("id", both.alias("p")).select("id", "p.ref", "p.hyp")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, json): one to three segments from each event, as text; a single one is not always in a list."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    start = F.round("value", 2)
    text = lambda i: F.when((k + i) % 13 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))
    one = lambda i: F.struct(text(i).alias("text"), F.round(start + i, 2).alias("start"), F.round(start + i + (k + 7 * i) % 40, 2).alias("end"))
    several = F.to_json(F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), one))
    return e.select(k.alias("recording_id"), F.when(k % 6 == 0, F.to_json(one(F.lit(0)))).otherwise(several).alias("json"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording catalog from orders."""
    k = F.col("o_orderkey").cast("string")
    base = F.when(F.col("o_orderkey") % 5 == 0, F.lit("https://example.org/other/")).otherwise(F.concat(F.lit("https://example.org/recordings/hi/"), F.col("o_custkey").cast("string"), F.lit("/")))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("recording_id"), F.concat(base, k, F.lit("_audio.wav")).alias("rec_url_gcp"), F.concat(base, k, F.lit("_transcription.json")).alias("transcription_url_gcp"), F.col("o_totalprice").alias("duration_s"))
