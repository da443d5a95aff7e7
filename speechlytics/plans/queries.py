"""The library's queries by name, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import registry, text, wer
from ..functions.numbers import normalize_numbers, spell_number
from ..functions.tagging import post_process as post_process_text
from ..functions.tagging import tag_loanwords as tag
from ..operators import ingest, lattice, sampling, spelling, taxonomy
from . import inputs

#: Details of fixes are the caller's; these stand for them.
FIX_DETAILS = {label: f"see the notes on {label.lower()}" for label in taxonomy.FIXES}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BACKUP = "https://example.org/backup/"
#: User and file of a recording's URL.
RECORDING = r"recordings/hi/(\d+)/(.+)"


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.pairs(spark, sf_dir)
    rows = rows.select("id", "k", F.size("ref").alias("words"), wer.word_errors(F.col("ref"), F.col("hyp")).alias("errors"), "ref", "hyp")
    return rows.withColumn("wer_percent", wer.wer_percent(F.col("errors"), F.col("words")))


@query
def wer_per_sample(spark, sf_dir):
    return _errors(spark, sf_dir).select("id", "k", "words", "errors", F.round("wer_percent", 6).alias("wer_percent"))


@query
def wer_corpus(spark, sf_dir):
    rows = _errors(spark, sf_dir)
    return rows.groupBy("k").agg(F.sum("errors").alias("errors"), F.sum("words").alias("words"), F.round(wer.corpus_wer(F.col("errors"), F.col("words")), 6).alias("wer"))


@query
def wer_macro(spark, sf_dir):
    return _errors(spark, sf_dir).groupBy("k").agg(F.round(F.avg("wer_percent"), 6).alias("mean_wer"), F.round(F.min("wer_percent"), 6).alias("min_wer"), F.round(F.max("wer_percent"), 6).alias("max_wer"))


@query
def wer_improvement(spark, sf_dir):
    """Each model against model 0: absolute and relative difference, the latter only if the baseline isn't 0."""
    rates = _errors(spark, sf_dir).groupBy("k").agg(wer.corpus_wer(F.col("errors"), F.col("words")).alias("wer"))
    base = F.max(F.when(F.col("k") == 0, F.col("wer"))).over(Window.partitionBy())  # over one row for each model
    rates = rates.withColumn("base", base).where("k > 0")
    return rates.select("k", F.round(F.col("base") - F.col("wer"), 6).alias("absolute"), F.round((F.col("base") - F.col("wer")) / F.nullif(F.col("base"), F.lit(0.0)) * 100, 6).alias("relative"))


def _predictions(spark, sf_dir):
    """Per-sample WER with a unique id and a spread over all severities."""
    return _errors(spark, sf_dir).select((F.col("id") * 6 + F.col("k")).alias("id"), (F.col("errors") * (F.col("id") % 5 + 1) * 100.0 / F.col("words")).alias("wer_percent"))


@query
def severity_buckets(spark, sf_dir):
    return _predictions(spark, sf_dir).groupBy(sampling.severity(F.col("wer_percent")).alias("severity")).agg(F.count("*").alias("n"))


@query
def systematic_sample(spark, sf_dir):
    return sampling.systematic_sample(_predictions(spark, sf_dir)).select("id", "severity", F.round("wer_percent", 6).alias("wer_percent"))


@query
def sample_ids(spark, sf_dir):
    return sampling.systematic_sample(_predictions(spark, sf_dir)).select("sample_id", "id")


def _labelled(spark, sf_dir):
    return inputs.hindi_pairs(spark, sf_dir).withColumn("labels", taxonomy.classify(F.col("ref"), F.col("hyp")))


@query
def error_taxonomy(spark, sf_dir):
    return _labelled(spark, sf_dir).select("id", F.array_join("labels", " | ").alias("error_categories"))


@query
def taxonomy_histogram(spark, sf_dir):
    return taxonomy.histogram(_labelled(spark, sf_dir)).select("category", "occurrences", F.round("percent", 6).alias("percent"))


@query
def top3_fixes(spark, sf_dir):
    return taxonomy.top_fixes(_labelled(spark, sf_dir), details=FIX_DETAILS)


@query
def category_examples(spark, sf_dir):
    return taxonomy.examples(_labelled(spark, sf_dir)).select("category", "n", "id")


@query
def word_diff(spark, sf_dir):
    """Words that were added or deleted, sorted."""
    rows = inputs.hindi_pairs(spark, sf_dir)
    ref, hyp = text.tokenize(F.col("ref")), text.tokenize(F.col("hyp"))
    joined = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), " ")
    return rows.select("id", joined(hyp, ref).alias("added"), joined(ref, hyp).alias("deleted"))


def _amounts(spark, sf_dir):
    rows = inputs.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_extendedprice").alias("n"))
    return rows


@query
def number_roundtrip(spark, sf_dir):
    return _amounts(spark, sf_dir).select("l_orderkey", "l_linenumber", normalize_numbers(spell_number(F.col("n"))).alias("digits"))


@query
def number_normalize(spark, sf_dir):
    sentence = F.concat(F.lit("उसने  "), spell_number(F.col("n")), F.lit(" रुपये दिये"))
    return _amounts(spark, sf_dir).select("l_orderkey", "l_linenumber", normalize_numbers(sentence).alias("converted"))


@query
def idiom_guard(spark, sf_dir):
    """A number beside an idiom stays, far from one it is converted."""
    words = spell_number(F.col("event_id") % 99 + 1)
    far = " और फिर बहुत देर के बाद हम सब घर लौटे "
    sentence = F.when(F.col("event_id") % 3 == 0, F.concat(words, F.lit(" पहला"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("दोनों भाई" + far * 2), words)).otherwise(F.concat(F.lit("दो-चार बातें "), words))
    return inputs.read(spark, sf_dir, "events").select("event_id", normalize_numbers(sentence).alias("converted"))


def _sentence():
    return F.split_part(F.lit(inputs.SENTENCES), F.lit("|"), (F.col("event_id") % 4 + 1).cast("int"))


@query
def tag_loanwords(spark, sf_dir):
    sentence = F.concat(_sentence(), F.lit(" "), F.col("event_type"))
    return inputs.read(spark, sf_dir, "events").select("event_id", tag(sentence).alias("tagged"))


@query
def post_process(spark, sf_dir):
    sentence = F.concat(spell_number(F.col("event_id") % 900 + 1), F.lit(" स्टूडेंट ने "), _sentence())
    return inputs.read(spark, sf_dir, "events").select("event_id", post_process_text(sentence).alias("processed"))


@query
def align_positions(spark, sf_dir):
    rows = lattice.bins(inputs.models(spark, sf_dir))
    each = rows.select("id", F.posexplode("aligned").alias("k", "words"))
    return each.select("id", "k", F.posexplode("words").alias("pos", "word"))


@query
def lattice_bins(spark, sf_dir):
    rows = lattice.bins(inputs.models(spark, sf_dir)).select("id", F.posexplode("bins").alias("pos", "b"))
    return rows.select("id", "pos", F.array_join(F.array_sort("b.valid"), " ").alias("valid"), F.col("b.primary").alias("primary"))


@query
def lattice_wer_by_model(spark, sf_dir):
    return lattice.by_model(lattice.model_errors(lattice.bins(inputs.models(spark, sf_dir))))


def _dictionary(spark, sf_dir):
    """The built-in words and some of the test words' stems."""
    stems = inputs.hindi_words(spark, sf_dir).where("id % 7 = 0 and id % 29 <> 0").select("word")
    return spelling.merge(spelling.builtin_dictionary(spark), stems)


def _verdicts(spark, sf_dir):
    words = inputs.hindi_words(spark, sf_dir)
    more = words.select(F.concat("word", F.lit("वाला")).alias("word")).union(words.where("id % 7 = 0").select(F.concat("word", F.lit("़")).alias("word")))
    return spelling.classify(words.select("word").union(more), _dictionary(spark, sf_dir))


@query
def spell_classify(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query
def spell_counts(spark, sf_dir):
    return spelling.counts(_verdicts(spark, sf_dir), "classification").select("classification", "n", F.round("percent", 6).alias("percent"))


@query
def spell_crosstab(spark, sf_dir):
    names = {"HIGH": "high", "MEDIUM": "medium", "LOW": "low", "N/A": "none"}
    return spelling.crosstab(_verdicts(spark, sf_dir)).withColumnsRenamed(names)


@query
def spell_top_reasons(spark, sf_dir):
    return _verdicts(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(10)


@query
def spell_review_sample(spark, sf_dir):
    return sampling.seeded_sample(_verdicts(spark, sf_dir).where("confidence = 'LOW'"), "word").select("word", "reason")


@query
def spell_high_incorrect(spark, sf_dir):
    return _verdicts(spark, sf_dir).where("classification = 'INCORRECT' and confidence = 'HIGH'").select("word", "reason")


@query
def dictionary_union(spark, sf_dir):
    return _dictionary(spark, sf_dir)


@query
def json_segments(spark, sf_dir):
    rows = inputs.segments(spark, sf_dir).select("recording_id", F.posexplode(ingest.parse_segments(F.col("json"))).alias("pos", "s"))
    return rows.select("recording_id", "pos", F.col("s.text").alias("text"), F.round("s.start", 2).alias("start"))


@query
def segment_gate(spark, sf_dir):
    rows = inputs.segments(spark, sf_dir).withColumn("segments", ingest.parse_segments(F.col("json")))
    return ingest.segments(rows).select("audio", "sentence", F.round("duration_s", 2).alias("duration_s"))


@query
def segment_stats(spark, sf_dir):
    stats = ingest.duration_stats(inputs.catalog(spark, sf_dir))
    return stats.select("n", *(F.round(c, 4).alias(c) for c in stats.columns if c != "n"))


@query
def url_fallback(spark, sf_dir):
    return inputs.catalog(spark, sf_dir).select("recording_id", ingest.fallback_url(F.col("rec_url_gcp"), BACKUP, RECORDING).alias("url"))


@query
def sibling_urls(spark, sf_dir):
    return inputs.catalog(spark, sf_dir).select("recording_id", F.array_join(ingest.sibling_urls(F.col("transcription_url_gcp")), " ").alias("urls"))


@query
def download_tasks(spark, sf_dir):
    return ingest.download_tasks(inputs.catalog(spark, sf_dir))


@query
def peak_normalize(spark, sf_dir):
    rows = inputs.read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(ingest.peak_normalize(F.col("embedding"))).alias("pos", "x"))
    return rows.select("vec_id", "pos", F.round("x", 6).alias("sample"))


@query
def sample_slice(spark, sf_dir):
    part = ingest.slice_samples(F.col("embedding"), F.lit(0.25), F.lit(1.1), 8)
    return inputs.read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(part).alias("pos", "x")).select("vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("sample"))


@query
def train_eval_split(spark, sf_dir):
    return sampling.split(inputs.read(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "split")


@query
def script_filters(spark, sf_dir):
    words = inputs.hindi_words(spark, sf_dir)
    return words.select("id", text.mostly_devanagari(F.col("word")).alias("mostly"), text.pure_devanagari(F.col("word")).alias("pure"))


@query
def display_columns(spark, sf_dir):
    rows = inputs.read(spark, sf_dir, "customer")
    percent = F.col("c_custkey") % 101
    return rows.select("c_custkey", text.truncate(F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit(" segment text")), 35, 33).alias("short"), text.slug(F.concat(F.lit("Model ("), "c_mktsegment", F.lit(")"))).alias("slug"), text.bar(percent).alias("bar"))


@query
def sql_functions(spark, sf_dir):
    """The text functions called from SQL."""
    registry.register(spark)
    sentence = F.concat(spell_number(F.col("event_id") % 900 + 1), F.lit(" स्टूडेंट ने "), _sentence())
    rows = inputs.read(spark, sf_dir, "events").select("event_id", sentence.alias("text"))
    return spark.sql("SELECT event_id, post_process(text) AS processed, word_errors(text, normalize_numbers(text)) AS errors FROM {rows}", rows=rows)


@query
def call_scalar(spark, sf_dir):
    """One text given by hand."""
    return registry.call(spark, "post_process", "तीन सौ पचास स्टूडेंट आए").toDF("processed")


@query
def download_outcomes(spark, sf_dir):
    rows = inputs.catalog(spark, sf_dir).select(F.col("rec_url_gcp").contains("recordings").alias("ok"), (F.col("recording_id") % 3).alias("part"))
    return ingest.outcomes(rows, F.col("ok"), "part")


@query
def recordings_with_files(spark, sf_dir):
    tasks = ingest.download_tasks(inputs.catalog(spark, sf_dir))
    listing = tasks.where("recording_id % 7 <> 0 and not (label = 'audio' and recording_id % 11 = 0)").select("dest")
    wide = inputs.catalog(spark, sf_dir).select("recording_id", F.concat(F.col("recording_id").cast("string"), F.lit("_audio.wav")).alias("audio"), F.concat(F.col("recording_id").cast("string"), F.lit("_transcription.json")).alias("json"))
    return ingest.with_files(wide, listing, "audio", "json").select("recording_id")


@query
def slice_gate(spark, sf_dir):
    part = ingest.slice_samples(F.col("embedding"), F.lit(0.25), (F.col("vec_id") % 9) / 2, 8)
    return inputs.read(spark, sf_dir, "embeddings").select("vec_id", F.size(part).alias("samples"), ingest.usable(part, 8, 0.5, 3.0).alias("usable"))


@query
def json_schema(spark, sf_dir):
    rows = inputs.segments(spark, sf_dir)
    return rows.select("recording_id", ingest.json_schema(F.col("json")).startswith("ARRAY").alias("is_list"))


@query
def wrapped(spark, sf_dir):
    rows = inputs.read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(text.wrap(F.coalesce("text", F.lit("")))).alias("line", "words"))
    return rows.select("item_id", "line", F.regexp_count("words", F.lit(" ")).alias("spaces"), (F.length("words") <= 75).alias("fits"))


@query
def training_metric(spark, sf_dir):
    """Token ids by line item; every ninth label is to be ignored."""
    vocabulary = F.array(*(F.lit(f" w{k}" if k else "") for k in range(50)))
    ids = inputs.read(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 9, -100).otherwise((F.col("l_partkey") % 49 + 1).cast("int")).alias("label"), (F.col("l_partkey") % 49 + F.when(F.col("l_suppkey") % 5 == 0, 2).otherwise(1)).cast("int").alias("guess"), "l_linenumber")
    ids = ids.withColumn("guess", F.when(F.col("guess") > 49, 1).otherwise(F.col("guess")))
    each = ids.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "label", "guess"))).alias("t"))
    each = each.select(F.concat(F.transform("t", lambda x: x["label"]), F.array(F.lit(-100))).alias("labels"), F.concat(F.transform("t", lambda x: x["guess"]), F.array(F.lit(0))).alias("guesses"))
    return each.agg(F.round(wer.training_wer(F.col("labels"), F.col("guesses"), vocabulary, 0), 6).alias("wer"))
