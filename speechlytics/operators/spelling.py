"""Spelling verdicts of Devanagari words against a dictionary: three joins, each only over the rows still open, then one CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import let, mostly_devanagari, pure_devanagari, strip

# Character sets of the rules, here and below; and the reasons that they give.
VOWELS, SIGNS, NASALS = "अआइईउऊऋएऐओऔ", "ािीुूृेैोौॅॉ", "ंँः"
CONSONANTS = "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह"


def builtin_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in lexicon.dictionary()], "word string")


def merge(*dictionaries: DataFrame) -> DataFrame:
    """The union of one-column dictionaries, without repeats."""
    out = dictionaries[0].toDF("word")
    for d in dictionaries[1:]:
        out = out.union(d.toDF("word"))
    return out.distinct()


def structure_fault(word: Column) -> Column:
    """The first structural fault as a reason, else null."""
    return (
        F.when(word.rlike(r"[\x{0900}-\x{097F}].*[a-zA-Z]|[a-zA-Z].*[\x{0900}-\x{097F}]"), "Invalid: mixed Roman + Devanagari script")
        .when(word.rlike("[ािीुूृेैोौ]{2,}"), "Invalid: repeated matra (ाा / ीी / etc.)")
        .when(word.rlike(r"(.)\1{2,}"), "Invalid: triple character repetition")
        .when(word.rlike(f"^[{SIGNS}{NASALS}]"), "Invalid: starts with vowel sign / nasal")
        .when(word.endswith("्"), "Suspicious: ends with halant")
        .when(word.rlike(f"[{VOWELS}][{SIGNS}]"), "Invalid: vowel sign after independent vowel")
    )


def normalized(word: Column) -> Column:
    """No nukta; ँ, ॉ and ॅ as ं, ो and े."""
    return F.translate(word, "ँॉॅ़", "ंोे")


def classify(words: DataFrame, dictionary: DataFrame, col: str | None = None, suffixes: list[str] | None = None) -> DataFrame:
    """Distinct non-null words of the first (or given) column -> word, classification, confidence, reason.

    The first rule wins: not Devanagari; in the dictionary; structural fault; a nukta or nasal variant of a dictionary
    word; root and suffix, in the order of the suffixes; short; plausible structure; unusually long; the rest.
    """
    suffixes = suffixes or lexicon.SUFFIXES.split()
    known = dictionary.toDF("_known").distinct()
    rows = words.select(strip(F.col(col or words.columns[0])).alias("word")).where("word is not null").distinct()
    # Bound once: the verdict asks for the fault several times.
    rows = rows.withColumns({"_skip": (F.col("word") == "") | ~mostly_devanagari(F.col("word")), "_fault": let(F.col("word"), structure_fault), "_plain": normalized(F.col("word"))})
    rows = rows.join(known.withColumn("_hit", F.lit(True)), F.col("word") == F.col("_known"), "left").drop("_known")
    rows = rows.join(known.withColumn("_variant", F.lit(True)), F.col("_plain") == F.col("_known"), "left").drop("_known")
    rows = rows.withColumn("_variant", F.col("_variant") & (F.col("_plain") != F.col("word")))
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(suffixes)))
    is_open = ~F.col("_skip") & F.col("_hit").isNull() & F.col("_fault").isNull() & ~F.coalesce("_variant", F.lit(False))
    ends = F.filter(table, lambda x: F.col("word").endswith(x["s"]) & (F.length("word") > F.length(x["s"])))
    roots = rows.where(is_open).select("word", F.explode(ends).alias("x")).select("word", F.expr("x.k"), F.expr("x.s"), F.expr("substring(word, 1, length(word) - length(x.s))").alias("root"))
    # The root as it is goes before its variant without nukta and with plain nasal.
    roots = roots.select("word", F.explode(F.array(F.struct((F.col("k") * 2).alias("o"), "s", "root", F.col("root").alias("try"), F.lit("Root '").alias("how")), F.struct((F.col("k") * 2 + 1).alias("o"), "s", "root", F.translate("root", "ँ़", "ं").alias("try"), F.lit("Root variant '").alias("how")))).alias("x")).select("word", "x.*")
    found = roots.join(known, F.col("try") == F.col("_known")).groupBy("word").agg(F.min_by(F.concat("how", "try", F.lit("' + suffix '"), "s", F.lit("'")), "o").alias("_root"))
    rows = rows.join(found, "word", "left")
    word, size, pure = F.col("word"), F.length("word"), pure_devanagari(F.col("word"))
    verdict = lambda c, f, r: F.struct(F.lit(c).alias("classification"), F.lit(f).alias("confidence"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    case = (
        F.when(F.col("_skip"), verdict("SKIP", "N/A", "Not Devanagari text"))
        .when(F.col("_hit"), verdict("CORRECT", "HIGH", "Found in reference dictionary"))
        .when(F.col("_fault").isNotNull(), verdict("INCORRECT", "HIGH", F.col("_fault")))
        .when(F.col("_variant"), verdict("CORRECT", "HIGH", F.concat(F.lit("Nukta/nasal variant of '"), "_plain", F.lit("'"))))
        .when(F.col("_root").isNotNull(), verdict("CORRECT", "MEDIUM", F.col("_root")))
        .when((size <= 2) & pure & word.rlike(f"^[{CONSONANTS}{VOWELS}]"), verdict("CORRECT", "MEDIUM", "Short valid Devanagari word (likely particle/suffix)"))
        .when(pure & size.between(2, 15), verdict("CORRECT", "MEDIUM", "Valid Devanagari structure (2-15 chars, no violations)"))
        .when(pure & (size > 15), verdict("INCORRECT", "LOW", "Unusually long word (>15 chars) — possible concatenation error"))
        .otherwise(verdict("INCORRECT", "LOW", "Not in dictionary, ambiguous structure — needs manual review"))
    )
    return rows.select("word", case.alias("v")).select("word", "v.*")


def counts(verdicts: DataFrame, col: str) -> DataFrame:
    """Rows by value, and their share in percent."""
    n = F.count("*")
    return verdicts.groupBy(col).agg(n.alias("n")).select(col, "n", (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("percent"))


def crosstab(verdicts: DataFrame) -> DataFrame:
    """Classification by confidence, zero where there is none."""
    return verdicts.groupBy("classification").pivot("confidence", ["HIGH", "MEDIUM", "LOW", "N/A"]).count().na.fill(0)
