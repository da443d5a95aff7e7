"""Sentence, spelling and WER fixtures with expected values."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from speechlytics.functions import align, numbers, registry, tagging, text, wer
from speechlytics.functions.align import align_words
from speechlytics.operators import ingest, lattice, sampling, spelling, taxonomy

SENTENCES = [
    ("किराया चार सौ सत्रह रुपये है", "किराया 417 रुपये है", "किराया 417 रुपये है"),
    ("दो लाख तीस हजार पेड़ लगे", "230000 पेड़ लगे", "230000 पेड़ लगे"),
    ("सन एक हजार नौ सौ बारह", "सन 1912", "सन 1912"),
    ("दस-बीस आम लाओ", "दस-बीस आम लाओ", "दस-बीस आम लाओ"),
    ("हमें सात सर्वर laptop के साथ दो", "हमें 7 सर्वर laptop के साथ 2", "हमें 7 [EN]सर्वर[/EN] [EN]laptop[/EN] के साथ 2"),
    ("तीन लाख नर्स और स्कूल", "300000 नर्स और स्कूल", "300000 नर्स और स्कूल"),
    ("एक लाख चौवन", "100054", "100054"),
    ("तीन सौ हजार", "301000", "301000"),
    ("शून्य सौ", "100", "100"),
    ("पांच शून्य", "पांच शून्य", "पांच शून्य"),
    ("एक दो", "2", "2"),
    ("सौ, लोग", "सौ, लोग", "सौ, लोग"),
    ("check-in करो", "check-in करो", "check-in करो"),
    ("reset, करो", "reset, करो", "[EN]reset[/EN], करो"),
    ("पहला भाग दो", "पहला भाग दो", "पहला भाग दो"),
    ("दो  सौ   लोग", "200 लोग", "200 लोग"),
    ("एक करोड दो लाख तीन हजार", "10203000", "10203000"),
    ("", "", ""),
    (None, None, None),
]


def test_sentences(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SENTENCES)], "i int, s string")
    got = df.select("i", numbers.normalize_numbers(F.col("s")).alias("n"), tagging.post_process(F.col("s")).alias("t")).orderBy("i").collect()
    assert [(r.n, r.t) for r in got] == [s[1:] for s in SENTENCES]


def test_round_trip(spark):
    n = spark.range(1, 200_001, 37)
    wrong = n.where(numbers.normalize_numbers(numbers.spell_number(F.col("id"))) != F.col("id").cast("string"))
    assert wrong.count() == 0


def test_tokenize(spark):
    df = spark.createDataFrame([("a b c\x1cd  e",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(text.tokenize(F.col("s"))).collect()] == [["a", "b", "c", "d", "e"], [], None]


@pytest.mark.parametrize(("ref", "hyp", "errors"), [("a b c", "a b c", 0), ("a b c", "a x c d", 2), ("a b c", "", 3), ("a", "b c d", 3), ("", "a", 1)])
def test_word_errors(spark, ref, hyp, errors):
    df = spark.createDataFrame([(ref.split(), hyp.split())], "r array<string>, h array<string>")
    row = df.select(wer.word_errors(F.col("r"), F.col("h")).alias("e"), wer.wer_percent(F.lit(errors), F.size("r")).alias("w")).first()
    assert row.e == errors
    assert row.w == (100.0 if not ref else errors * 100 / len(ref.split()))


words = st.lists(st.sampled_from("abcd"), max_size=8)


@settings(max_examples=100, deadline=None)
@given(words, words)
def test_alignment_holds_the_distance(ref, hyp):
    got = align_words(ref, hyp)
    assert len(got) == len(ref)
    kept = [w for w in got if w]
    rest = iter(hyp)
    assert all(w in rest for w in kept)  # in order


def plain_alignment(ref, hyp):
    rows = [list(range(len(hyp) + 1))]
    for i, r in enumerate(ref, 1):
        row = [i]
        for j, h in enumerate(hyp, 1):
            row.append(min(rows[-1][j - 1] + (r != h), rows[-1][j] + 1, row[-1] + 1))
        rows.append(row)
    out, i, j = [""] * len(ref), len(ref), len(hyp)
    while i:
        if j and rows[i][j] == rows[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out[i] = hyp[j]
        elif rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.none() | words, st.none() | st.lists(st.none() | words, max_size=3)), max_size=8), st.sampled_from([1, 200, align.CELLS]))
def test_alignment_of_a_batch(rows, cells):
    kind = pa.list_(pa.string())
    before, align.CELLS = align.CELLS, cells
    try:
        got = align.align_batch(pa.array([r for r, _ in rows], kind), pa.array([m for _, m in rows], pa.list_(kind))).to_pylist()
    finally:
        align.CELLS = before
    assert got == [None if r is None or ms is None else [plain_alignment(r, m or []) for m in ms] for r, ms in rows]


def test_alignment_of_long_texts():
    ref = [str(k % 97) for k in range(3000)]
    hyp = [w for k, w in enumerate(ref) if k % 10] + ["x"]
    assert align_words(ref, hyp) == plain_alignment(ref, hyp)


def test_lattice(spark):
    models = ["a x c", "a x c", "a x c", "a b c", "a y c", "a b"]
    df = spark.createDataFrame([("a b c", *models), ("", *models)], ["Human", *(f"Model {k}" for k in range(6))])
    got = lattice.model_errors(lattice.bins(lattice.wide_to_models(df))).where("words > 0").orderBy("model").collect()
    assert [r.errors for r in got] == [1, 1, 1, 0, 1, 1]
    assert [r.lattice_errors for r in got] == [0, 0, 0, 0, 1, 1]
    assert sum(r.words for r in lattice.by_model(lattice.model_errors(lattice.bins(lattice.wide_to_models(df)))).collect()) == 18


SPELLED = [
    ("hello", "SKIP", "N/A"), ("घर", "CORRECT", "HIGH"), ("घरabc", "SKIP", "N/A"), ("करनाab", "INCORRECT", "HIGH"), ("काा", "INCORRECT", "HIGH"), ("ककक", "INCORRECT", "HIGH"),
    ("ाक", "INCORRECT", "HIGH"), ("क्", "INCORRECT", "HIGH"), ("अाम", "INCORRECT", "HIGH"), ("घ़र", "CORRECT", "HIGH"), ("करना", "CORRECT", "MEDIUM"), ("टम", "CORRECT", "MEDIUM"),
    ("टमट", "CORRECT", "MEDIUM"), ("कमलनयनपदमकमलनयनपद", "INCORRECT", "LOW"), ("।", "INCORRECT", "LOW"), ("एस_बी_आई", "INCORRECT", "LOW"),
]


def test_spelling(spark):
    df = spark.createDataFrame([(w,) for w, *_ in SPELLED] + [(None,)], "w string")
    known = spark.createDataFrame([("घर",), ("कर",)], "d string")
    got = {r.word: (r.classification, r.confidence) for r in spelling.classify(df, known).collect()}
    assert got == {w: (c, f) for w, c, f in SPELLED}


def test_severity_and_sample(spark):
    df = spark.range(1, 121).withColumn("wer_percent", F.col("id").cast("double"))
    got = sampling.systematic_sample(df).groupBy("severity").count().collect()
    assert {r.severity: r["count"] for r in got} == sampling.QUOTAS


def test_taxonomy(spark):
    df = spark.createDataFrame([("a b", "a b"), ("घर है", "घर की"), ("abcd", "abcd xyzw xyzw")], "r string, h string")
    got = [r[0] for r in df.select(taxonomy.classify(F.col("r"), F.col("h"))).collect()]
    assert got[0] == ["Other/Phonetic Similarity"]
    assert "Short Word Insertion/Deletion" in got[1]
    assert "Repetition/Hallucination" in got[2]


def test_segments(spark):
    df = spark.createDataFrame([(1, '{"text": " a ", "start": 0, "end": 2}'), (2, '[{"text": "", "end": 5}, {"text": "b", "start": 1, "end": 40}, {"text": "c", "start": 1, "end": 31}]')], "recording_id long, json string")
    rows = ingest.segments(df.withColumn("segments", ingest.parse_segments(F.col("json")))).orderBy("audio").collect()
    assert [(r.audio, r.sentence, r.duration_s) for r in rows] == [("1_seg0000.wav", "a", 2.0), ("2_seg0002.wav", "c", 30.0)]


def test_peak(spark):
    df = spark.createDataFrame([([0.5, -1.0],), ([0.0, 0.0],)], "x array<float>")
    assert [r[0] for r in df.select(ingest.peak_normalize(F.col("x"))).collect()] == [[0.475, -0.95], [0.0, 0.0]]


def test_word_errors_of_many_words(spark, monkeypatch):
    """More distinct words than fit below the surrogates, and the change of code around any bound."""
    many = F.transform(F.sequence(F.lit(1), F.lit(wer.MOST_WORDS + 500)), lambda k: k.cast("string"))
    assert spark.range(1).select(wer.word_errors(F.slice(many, wer.MOST_WORDS + 490, 10), many).alias("e")).first().e == wer.MOST_WORDS + 490
    monkeypatch.setattr(wer, "MOST_WORDS", 50)
    for n in (49, 50, 51, 52, 300):
        words = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit("w"), k.cast("string")))
        assert spark.range(1).select(wer.word_errors(words, F.concat(F.slice(words, 1, n - 1), F.array(F.lit("w1")))).alias("e")).first().e == 1


def test_sql_functions(spark):
    registry.register(spark)
    df = spark.createDataFrame([(s[0],) for s in SENTENCES], "s string")
    same = df.selectExpr("s", "normalize_numbers(s) n", "post_process(s) p", "word_errors(s, 'एक दो') e")
    for r in same.select("*", numbers.normalize_numbers(F.col("s")).alias("n2"), tagging.post_process(F.col("s")).alias("p2"), wer.word_errors(text.tokenize(F.col("s")), F.array(F.lit("एक"), F.lit("दो"))).alias("e2")).collect():
        assert (r.n, r.p, r.e) == (r.n2, r.p2, r.e2)
    with pytest.raises(ValueError):
        registry.call(spark, "unknown", "x")


def test_systematic_sample_of_ties(spark):
    """A third of all rows has one WER; ranks as a plain sort gives them."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.col("id") * 37 % 997) / 10.0).alias("wer_percent"))
    rows = sorted(((r.wer_percent, r.id) for r in df.collect()))
    exp = []
    for quota, keep in zip(sampling.QUOTAS.values(), (lambda w: w <= 30, lambda w: 30 < w <= 60, lambda w: w > 60), strict=True):
        own = [r for r in rows if keep(r[0])]
        exp += own[:: max(1, len(own) // quota)][:quota]
    for span in (1 << 24, 64):
        sampling.RANGE = span
        got = sampling.systematic_sample(df).orderBy("sample_id").collect()
        assert [(r.wer_percent, r.id) for r in got] == exp and [r.sample_id for r in got] == list(range(1, len(exp) + 1))
    sampling.RANGE = 1 << 24
    assert sampling.systematic_sample(df.limit(0)).count() == 0


def test_gates_files_outcomes_and_wrap(spark):
    df = spark.createDataFrame([("a", "b", True), ("a", "x", False), (None, "b", None)], "p string, q string, ok boolean")
    files = spark.createDataFrame([("a",), ("b",), ("a",)], "f string")
    assert ingest.with_files(df, files, "p", "q").count() == 1
    assert ingest.outcomes(df, F.col("ok")).first().asDict() == {"succeeded": 1, "failed": 2}
    assert [r[0] for r in spark.createDataFrame([([0.0] * 8,), ([],)], "x array<double>").select(ingest.usable(F.col("x"), 4)).collect()] == [True, False]
    assert spark.range(1).select(text.wrap(F.lit("aa bb cccccc d"), 5)).first()[0] == ["aa bb", "cccccc", "d"]
    fixes = taxonomy.top_fixes(spark.createDataFrame([(1, ["Word Substitution"])], "id int, labels array<string>"), details={"Word Substitution": "x"})
    assert fixes.first().implementation_detail == "x"
