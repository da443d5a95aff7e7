"""Error taxonomy of (reference, hypothesis) pairs: one array of labels, by built-ins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, tokenize

# Fixed value: vowel signs and nasals.
MATRAS = "[ािीुूेैोौंःँृ]"
# Number words and loanwords that the labels look for.
NUMBER_WORDS = "एक दो तीन चार पांच छह सात आठ नौ दस सौ हजार लाख करोड़"
MARKERS = "[a-zA-Z]{2,}|(?:कम्प्यूटर|मोबाइल|फोन|इंटरनेट|ऑनलाइन|ऑफलाइन|डाउनलोड|अपलोड|सॉफ्टवेयर|हार्डवेयर|डिजिटल|पॉलिसी|रिपोर्ट|प्रोजेक्ट|मैनेजर|मीटिंग|स्कूल|कॉलेज|यूनिवर्सिटी|हॉस्पिटल|बस|ट्रेन|एयरपोर्ट|टिकट|होटल)"
# The proposed fix of each label.
FIXES = {
    "Matra/Vowel Marker Error": "Phoneme-Aware Post-Processing with Soundex-like Mapping",
    "Conjunct Consonant Error": "Custom BPE Vocabulary with Conjunct-Preserving Tokenization",
    "Number/Digit Handling": "Rule-Based Number Normalizer Post-Processor",
    "English Loanword Error": "Bilingual Lexicon-Constrained Decoding",
    "Short Word Insertion/Deletion": "Attention-Weighted Silence Detection",
    "Word Substitution": "Context-Aware Re-Scoring with Hindi LM",
    "Repetition/Hallucination": "N-gram Repetition Penalty + Length Normalization",
    "Proper Noun Confusion": "Hot-Word Biasing with Domain-Specific Entity List",
    "Other/Phonetic Similarity": "Phonetic Similarity Re-Ranking",
}


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def classify(ref: Column, hyp: Column) -> Column:
    """The labels of a pair, in a fixed order; never empty."""
    found = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [F.struct(t.alias("t"), tokenize(t).alias("words"), found(t, MATRAS).alias("matras"), F.regexp_replace(t, MATRAS, "").alias("bare")) for t in (ref, hyp)]
    return let(F.struct(parts[0].alias("r"), parts[1].alias("h")), lambda p: _labels(p["r"], p["h"]))


def _labels(r: Column, h: Column) -> Column:
    found = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    differ = lambda f: F.size(symmetric_difference(f(r), f(h))) > 0
    numbers = F.array(*map(F.lit, NUMBER_WORDS.split()))
    unlike = lambda f: f(r) != f(h)
    first = F.array(
        F.when(unlike(lambda x: x["matras"]) & (~unlike(lambda x: x["bare"]) | (F.abs(F.size(r["matras"]) - F.size(h["matras"])) > 2)), "Matra/Vowel Marker Error"),
        F.when(unlike(lambda x: F.regexp_count(x["t"], F.lit("्"))), "Conjunct Consonant Error"),
        F.when(unlike(lambda x: x["t"].rlike("[0-9०-९]")) | unlike(lambda x: F.arrays_overlap(x["words"], numbers)), "Number/Digit Handling"),
        F.when(differ(lambda x: found(x["t"], MARKERS)) | differ(lambda x: found(x["t"], "[a-zA-Z]+")), "English Loanword Error"),
        F.when(differ(lambda x: F.filter(x["words"], lambda w: F.length(w) <= 2)), "Short Word Insertion/Deletion"),
    )
    repeats = F.exists(F.zip_with(h["words"], F.slice(h["words"], 2, F.greatest(F.size(h["words"]), F.lit(1))), lambda a, b: F.coalesce((a == b) & ~F.contains(r["t"], a), F.lit(False))), lambda x: x)
    changed = F.filter(symmetric_difference(r["words"], h["words"]), lambda w: F.length(w) > 3)

    def rest(x: Column) -> Column:
        more = F.array(
            F.when((F.size(x["first"]) == 0) & (F.size(x["changed"]) > 0), "Word Substitution"),
            F.when(repeats, "Repetition/Hallucination"),
            F.when(F.exists(x["changed"], lambda w: w.rlike(r"^\p{Lu}")), "Proper Noun Confusion"),
        )
        return F.concat(x["first"], F.filter(more, lambda y: y.isNotNull()))

    labels = let(F.struct(F.filter(first, lambda x: x.isNotNull()).alias("first"), changed.alias("changed")), rest)
    return let(labels, lambda x: F.when(F.size(x) == 0, F.array(F.lit("Other/Phonetic Similarity"))).otherwise(x))


def histogram(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Rows by label, and their share of all rows in percent."""
    each = df.select(F.posexplode(labels).alias("place", "category"))
    counts = each.groupBy("category").agg(F.count("*").alias("occurrences"), F.count_if(F.col("place") == 0).alias("firsts"))
    # Every row has a first label; the window runs over one row for each label.
    return counts.select("category", "occurrences", (F.col("occurrences") * 100.0 / F.sum("firsts").over(Window.partitionBy())).alias("percent"))


def top_fixes(df: DataFrame, k: int = 3, labels: str = "labels", order: str = "id", details: dict[str, str] | None = None) -> DataFrame:
    """The k most frequent labels (ties: first seen by ``order``, then the label's place) with their proposed fixes and, where given, ``details`` of these by label."""
    spark = df.sparkSession
    fixes = spark.createDataFrame([(c, f, (details or {}).get(c)) for c, f in FIXES.items()], "category string, proposed_fix string, implementation_detail string")
    seen = df.select(F.col(order).alias("_o"), F.posexplode(labels).alias("_p", "category"))
    counts = seen.groupBy("category").agg(F.count("*").alias("occurrences"), F.min(F.struct("_o", "_p")).alias("_first"))
    top = counts.orderBy(F.desc("occurrences"), "_first").limit(k)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("occurrences"), "_first")))
    return top.join(F.broadcast(fixes), "category", "left").select("rank", "category", "occurrences", F.coalesce("proposed_fix", F.lit("N/A")).alias("proposed_fix"), *(["implementation_detail"] if details else []))


def examples(df: DataFrame, k: int = 5, labels: str = "labels", order: str = "id") -> DataFrame:
    """The first k rows of each label."""
    each = df.withColumn("category", F.explode(labels))
    return each.withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy(order))).where(F.col("n") <= k)
