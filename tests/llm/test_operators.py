"""The training-data operators against brute force on small tables with nulls, ties, repeated rows and clashing columns."""

import binascii
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from speechlytics.llm import components, decontaminate, exact_dedup, lm_score, mixing, pii, quality, sharding, simhash, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, row long, fp long"


def corpus(seed=0, n=60):
    rng, words = random.Random(seed), [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 80, 200]))) for _ in range(n)]
    texts += texts[:10] + ["", None, " \n\t", "A b", "a B", "a b"] + [" ".join(["x"] * 500)]
    return [(k, t, "en", ["a", "b", "c", None][k % 4], len(t or ""), "clash", k, k) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    extra = [rows[0], rows[0], (None, rows[1][1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows + extra, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    got, groups = exact_dedup.exact_dedup(docs).collect(), defaultdict(list)
    rows = docs.collect()
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    assert len(got) == len(rows)
    for r in got:
        own = next(v for t, v in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert (r.keep_id, r.group_size) == (max((i for i in own if i is not None), default=None), len(own))
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 100, 5000])
def test_golomb(n):
    values = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n))
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values, 1 << 40)) == values).all()


def test_simhash(docs, empty):
    rows, got = docs.collect(), simhash.near_duplicates(docs).collect()
    fp = {r.text: simhash.fingerprint((r.text or "").encode()) for r in rows}
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((r.doc_id, f"{fp[r.text]:016x}") for r in rows)
    label = {f: f for f in fp.values()}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(label, 2):
            if (a ^ b).bit_count() <= 3 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    first = {}
    for r in rows:
        if r.doc_id is not None:
            k = label[fp[r.text]]
            first[k] = min(first.get(k, r.doc_id), r.doc_id)
    assert all(r.component_id == first.get(label[int(r.fingerprint, 16)]) for r in got)
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in simhash.keep_one(docs).collect() if r.doc_id is not None]
    assert sorted(kept) == sorted(set(first.values()))


def test_covering():
    masks, rng = simhash.masks(), random.Random(1)
    for _ in range(2000):
        flips = sum(1 << i for i in rng.sample(range(64), 3))
        assert any(flips & m == 0 for m in masks)


def test_large_bucket():
    rng = np.random.default_rng(2)
    mask = simhash.masks()[0]
    free = [i for i in range(64) if not mask >> i & 1]
    prints = np.unique(np.array([sum(1 << i for i in free if rng.random() < 0.5) for _ in range(9000)], np.uint64))
    near = list(simhash._spread(prints, 3, mask))
    assert all((a ^ b).bit_count() <= 3 for a, b in near[:500])
    pairwise, simhash.DENSE = simhash.DENSE, 1 << 30
    try:
        assert len(near) == len(list(simhash._spread(prints, 3, mask)))  # as many links: as many parts
    finally:
        simhash.DENSE = pairwise


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 8)], "u long, v long")
    assert {r.node: r.component for r in components.components(edges).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7}
    assert components.components(edges.limit(0)).count() == 0


def test_windows():
    rng = np.random.default_rng(3)
    for _ in range(100):
        v = rng.integers(0, 20, rng.integers(1, 50)).astype(np.uint64)
        exp = set()

        def cut(l, r):
            if r - l + 1 >= 5:
                c = l + int(np.argmin(v[l : r + 1]))
                if v[c]:
                    exp.add((l, c, r))
                cut(l, c - 1)
                cut(c + 1, r)

        cut(0, len(v) - 1)
        assert set(zip(*(x.tolist() for x in substring.windows(v, 5)), strict=True)) == exp


def test_substring(spark, empty):
    rng = random.Random(4)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage, near = fresh(60), fresh(100)
    other = [*near[:50], "changed", *near[51:]]
    texts = [fresh(80) + passage + fresh(70), fresh(30) + passage, passage + fresh(200), fresh(300), fresh(20) + near, other + fresh(20), fresh(45)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(7, None), (8, "")]
    got = substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 4, 5}
    assert {(r.first_word, r.end_word) for r in got if r.doc_id == 1} == {(30, 90)}
    assert substring.passages(empty).count() == 0


def test_lattice_by_brute_force():
    lattice = lm_score.Lattice(["", "a", "ab", "b", "c", "bc", *(chr(0xDC00 + k) for k in range(256))], [True, True, True, *[False] * 259], np.zeros(262))

    def total(word, at, log):
        out = math.exp(log + lattice.weights[lattice.stop]) if at == len(word) else 0.0
        for j in range(at + 1, len(word) + 1):
            if word[at:j] in lattice.inner:
                out += total(word, j, log + lattice.weights[lattice.inner[word[at:j]]])
        if at < len(word) and word[at] not in lattice.inner:
            out += total(word, at + 1, log + sum(lattice.weights[lattice.inner[chr(0xDC00 + b)]] for b in word[at].encode()))
        return out

    for word in ("abc", "abbc", "é", "cab", "a"):
        brute = sum(total(word, j, lattice.weights[lattice.start[word[:j]]]) for j in range(len(word) + 1) if word[:j] in lattice.start)
        assert lattice.log_probability(word) == pytest.approx(math.log(brute))


def test_lm_score(docs, empty):
    rows, got = docs.collect(), lm_score.score(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for r in rows if not held(r.doc_id) for w in [*(r.text or "").lower().split(), 0])
    n, v = sum(counts.values()), len(counts)
    exp = sorted((r.doc_id is None, r.doc_id or 0, len(t := [*(r.text or "").lower().split(), 0]), sum(counts[w] > 0 for w in t), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == exp
    assert all(r.train_tokens == n and r.held_out == held(r.doc_id) and -1e9 < r.score < 0 for r in got)
    assert all(r.score == r.lattice_score for r in got)
    assert lm_score.score(empty).count() == 0


def test_lm_score_by_brute_force(spark, monkeypatch):
    """The score itself from the fitted lattice, with all words in place, in the join, and with word arcs."""
    rows = [(k, " ".join(random.Random(k).choices(["alpha", "beta", "Éa", "zzq", "x"], k=20))) for k in range(40)] + [(99, "w " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = []
    fit = lm_score.fit
    monkeypatch.setattr(lm_score, "fit", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    got = {r.doc_id: r for r in lm_score.score(df).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows}
    counts = Counter(w for k, t in rows if not held[k] for w in t.encode().lower().decode().split())
    ends = sum(not h for h in held.values())
    n = sum(counts.values()) + ends
    ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
    d = ones / (ones + 2 * twos) if ones else 0.5
    for k, t in rows:
        plain, arcs = math.log10(ends / n), math.log10(ends / n)
        for w in t.encode().lower().decode().split():
            p = math.exp(fitted[0].log_probability(w))
            plain += math.log10(1 - ends / n) + math.log10(p)
            arcs += math.log10(max(counts[w] - d, 0) / n + d * len(counts) / n * p)
        assert got[k].score == pytest.approx(plain) and got[k].score_with_words == pytest.approx(arcs)
    monkeypatch.setattr(lm_score, "HEAD", 0)  # no word is frequent: all go through the join
    again = {r.doc_id: r for r in lm_score.score(df, word_arcs=True).collect()}
    assert all(again[k].score == pytest.approx(got[k].score_with_words) and again[k].n_known == got[k].n_known for k in got)


def labelled(spark, seed=5):
    rng, words = random.Random(seed), [f"w{k}" for k in range(200)]
    rows, marks = [], []
    for k in range(400):
        lines = [" ".join(rng.choices(words, k=8)) + "." for _ in range(6)]
        bad = rng.random() < 0.4
        if bad:
            lines.insert(3, "you vile fool.")
        junk = rng.random() < 0.5
        rows.append((k, " ".join(lines) if not junk else " | ".join(lines) + " ### $$$" * 9, "en", "s", 1, None, None, None))
        marks.append((k, int(not junk), int(bad)))
    return spark.createDataFrame([*rows, (900, None, None, None, None, None, None, None), (None, "", None, None, None, None, None, None)], SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {m[0]: m for m in marks}


def test_toxicity(spark, empty):
    docs, labels, truth = labelled(spark)
    weights = toxicity.train(docs, labels)
    got = toxicity.score(docs, weights).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id][2] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 402
    assert any(s.words == 3 for r in got for s in r.offending)
    assert toxicity.drop_toxic(docs, weights).columns == docs.columns
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_toxicity_sample(spark):
    docs = spark.range(15_500).selectExpr("id AS doc_id", "'a b.' AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    assert toxicity.sample(docs, labels, "toxic", toxicity.SAMPLE, toxicity.FOLDS, toxicity.HELD_OUT).count() == 12_000


def test_quality(spark, empty):
    docs, labels, truth = labelled(spark)
    got = quality.score(docs, quality.train(docs, labels)).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 402
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def test_factorisation_is_the_pairwise_sum():
    m = quality.Machine()
    doc, feature, value = np.zeros(3, int), np.array([1, 5, 9]), np.array([0.5, 1.0, 2.0])
    z, _ = m.logits(doc, feature, value, 1)
    pairs = sum((m.factors[:, feature[i]] @ m.factors[:, feature[j]]) * value[i] * value[j] for i, j in itertools.combinations(range(3), 2))
    assert z[0] == pytest.approx(pairs)


def test_subset_sum():
    rng = random.Random(6)
    for _ in range(200):
        sizes = np.array(sorted(rng.sample(range(1, 20), 4)))
        counts, budget = np.array([rng.randrange(4) for _ in sizes]), rng.randrange(80)
        got = mixing.subset_sum(sizes, counts, budget)
        best = max(s for p in itertools.product(*(range(c + 1) for c in counts)) if (s := sum(a * b for a, b in zip(p, sizes, strict=True))) <= budget)
        assert (got <= counts).all() and (got * sizes).sum() == best


def test_fit_from_either_side():
    assert mixing.fit(np.array([20_000]), np.array([1]), 19_999).tolist() == [1]
    assert mixing.fit(np.array([20_000]), np.array([1]), 10_000).tolist() == [0]
    rng = random.Random(7)
    for _ in range(200):
        sizes = np.array(sorted(rng.sample(range(5, 60), 5)))
        counts, budget = np.ones(5, np.int64), rng.randrange(int(sizes.sum()))
        got = mixing.fit(sizes, counts, budget)
        best = min(abs(sum(p) - budget) for p in itertools.product(*((0, int(s)) for s in sizes)))
        assert (got <= counts).all() and abs((got * sizes).sum() - budget) == best


def test_mix(docs, empty):
    got = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken <= 3 * r.size
    assert sum({s: v[0].target for s, v in by.items()}.values()) == pytest.approx(sum(r.size for r in got))
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and v[0].target <= 3 * v[0].source_size + 1e-6
        assert abs(sum(r.taken for r in v) - v[0].target) <= 200
    key = lambda rows: sorted(map(repr, rows))
    assert key(got) == key(mixing.mix(docs).collect())
    assert mixing.mix(empty).count() == 0
    assert mixing.take(docs).columns == docs.columns


def jump(key, n):
    at, ahead = -1, 0
    while ahead < n:
        at = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_sharding(docs, empty):
    keys = np.random.default_rng(7).integers(-(1 << 62), 1 << 62, 500)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k) % 2**64, n) for k in keys]
    got = sharding.shard(docs).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    exp = Counter((r.doc_id, len((r.text or "").encode()) + 1, binascii.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == exp
    assert sharding.shard(empty).count() == 0


def test_myers():
    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    rng = random.Random(8)
    for _ in range(500):
        p, t = rng.choices("abc", k=rng.randint(1, 70)), rng.choices("abcd", k=rng.randint(0, 40))
        assert decontaminate.myers(p, t)[0] == distance(p, t)


def test_decontaminate(spark, docs, empty):
    item = [f"q{k}" for k in range(20)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (1, " ".join(item))], "item_id long, text string")
    changed = [*item[:4], "other", *item[5:9], *item[10:]]  # two edits of the four allowed
    rows = [(1, "x y " + " ".join(item).upper() + " z"), (2, "x " + " ".join(changed) + ", y"), (3, " ".join(item[:10])), (4, None)]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.matches(found, bench).collect()
    assert sorted({(r.doc_id, r.item_id, r.edits) for r in got}) == [(1, 1, 0), (2, 1, 2)]
    assert {(r.first_word, r.end_word) for r in got if r.doc_id == 1} == {(2, 22)}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(found, bench).collect()) == [3, 4]
    assert decontaminate.drop_contaminated(docs, bench).count() == docs.count()
    assert decontaminate.matches(empty, bench).count() == 0


def test_decontaminate_short_and_unspaced_items(spark, empty):
    bench = spark.createDataFrame([(1, "Who wrote Faust?"), (2, "Paris"), (3, "大型语言模型的训练数据需要去除基准测试。"), (4, "ความรู้พื้นฐาน"), (5, "..."), (6, "日本")], "item_id long, text string")
    rows = [(1, "he asked who wrote faust, once"), (2, "who has written faust"), (3, "in paris, paris"), (4, "parisian"), (5, "据说，大型语言模型的训练数椐需要去除、基准测试等"), (6, "大型语言"), (7, "มีความรู้พื้นฐานดี"), (8, "東京と日本と"), (9, "... !"), (10, None)]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.matches(found, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.edits, r.first_word, r.end_word) for r in got) == [(1, 1, 0, 2, 5), (3, 2, 0, 1, 2), (5, 3, 1, 2, 21), (7, 4, 0, 2, 16), (8, 6, 0, 3, 5)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(found, bench).collect()) == [2, 4, 6, 9, 10]


KEY = b"key of the tests"


def replaced(spark, rows):
    return {r.doc_id: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}


def test_pii(spark, empty):
    text = "mail Ann.Lee@site.org or ann.lee@site.org, +1 (523) 555-7040, 4111 1111 1111 1111, 45.1.2.3, token = \"49ab8b03847754d938118ecf003181de\", Mrs. Maria Lopez"
    rows = [(1, text), (2, "again ann.lee@site.org"), (3, None), (4, "nothing 12 here"), (1, text), (5, "word " * 250_000 + "ann.lee@site.org")]
    got = replaced(spark, rows)
    new = got[1].text
    assert not any(x in new for x in ("Lee", "lee@", "5557040", "555-7040", "4111 1111", "45.1.2.3", "49ab8b", "Maria", "Lopez"))
    assert [e.kind for e in got[1].entities] == ["email", "email", "phone", "card", "ip", "secret", "given_f", "surname"]
    assert all(new[e.start : e.end] == e.surrogate for e in got[1].entities)
    assert got[1].entities[0].surrogate.lower() == got[1].entities[1].surrogate == got[2].entities[0].surrogate == got[5].entities[0].surrogate
    assert got[3].text is None and got[4].text == "nothing 12 here"
    assert got[5].text == "word " * 250_000 + got[2].entities[0].surrogate
    assert pii._luhn("".join(c for c in got[1].entities[3].surrogate if c.isdigit())[:-1]) == got[1].entities[3].surrogate[-1]
    assert len({pii.surrogate("ssn", f"{k:04d}", 0, KEY) for k in range(10_000)}) == 10_000
    assert pii.replace(empty, KEY).count() == 0


def test_pii_coreference_gender_and_titles(spark):
    rows = [(1, "Mrs. Maria Lopez met Herr Anton Kern. Maria liked Kern, and Lopez left."), (2, "Frau Lopez, Mr. Aa Mr. Ea, M. Martin d'Or"), (3, "Marianne and Kernel stay")]
    got = replaced(spark, rows)
    new = {got[1].text.split()[k].strip(",.") for k in (2, 11)}
    assert len(new) == 1 and got[1].text.split()[1].lower() in pii._GIVEN["LATIN"]["f"].split()
    assert got[1].text.split()[5].lower() in pii._GIVEN["LATIN"]["m"].split()
    assert got[1].text.split()[1] == got[1].text.split()[7]
    assert got[2].text.split()[1].strip(",") == got[1].text.split()[2]
    assert [e.kind for e in got[2].entities[:3]] == ["surname"] * 3 and "Mr. " in got[2].text[15:]
    assert got[3].text == rows[2][1] and not got[3].entities


def test_pii_keeps_types(spark):
    assert pii.surrogate("phone", "+442079460958", 0, KEY)[:3] == "+44" and pii.surrogate("phone", "+35312345678", 0, KEY)[:4] == "+353"
    for ip in ("10.0.0.1", "172.16.9.9", "192.168.0.4", "127.0.0.1", "8.8.8.8", "172.32.0.1"):
        value = lambda x: int.from_bytes(bytes(map(int, x.split("."))))
        assert pii._range(value(pii.surrogate("ip", ip, 0, KEY))) == pii._range(value(ip))
    assert len({pii.surrogate("ip", f"192.168.{a}.{b}", 0, KEY) for a in range(40) for b in range(256)}) == 40 * 256
    iban = pii.surrogate("iban", "DE89370400440532013000", 0, KEY)
    assert iban[:2] == "DE" and iban[2:4] == pii._iban_check(iban) and iban != "DE89370400440532013000"
    assert not pii.find("4111 1111 1111 1112") and pii.surrogate("card", "4111111111111111", 0, KEY)[0] == "4"


def test_pii_digits_of_any_script(spark):
    rows = [(1, "+९१ ९८७६५ ४३२१०"), (2, "श्री 1 +९१ ९८७६५ ४३२१०"), (3, "+91 98765 43210"), (4, "१९२.१६८.१.१"), (5, "٤١١١ ١١١١ ١١١١ ١١١١"), (6, "१२३-४५-६७८९"), (7, "abcdefab" * 4)]
    got = replaced(spark, rows)
    assert [[e.kind for e in got[k].entities] for k in range(1, 8)] == [["phone"], ["phone"], ["phone"], ["ip"], ["card"], ["ssn"], ["hex"]]
    new = {k: got[k].entities[0].surrogate for k in got}
    assert all(new[k] not in t for k, t in rows)
    assert new[1] == new[2] and pii.canonical("phone", new[1]) == pii.canonical("phone", new[3])
    assert all("०" <= c <= "९" or c in "+ .-" for k in (1, 4, 6) for c in new[k]) and all("٠" <= c <= "٩" or c == " " for c in new[5])
    assert all(pii.find(x) == [("ip", 0, len(x))] for x in ("२५५.१.२.३", "255.249.19.9")) and not pii.find("२५६.१.२.३")


def test_pii_used_up_shapes(spark, monkeypatch):
    """More names than the lists hold, and shapes that are all in use; whether the draws are broadcast or joined."""
    consonants = "bcdfghjklmnpqrstvwxyz"
    names = [f"{a}{b}m" for a in consonants for b in "aeiou"]
    entities = [("given_f", n) for n in names] + [("surname", n) for n in names] + [("email", f"{a}@b.de") for a in "aeiou"] + [("phone", f"1{k:04d}") for k in range(6000)]
    again = {(r.kind, r.entity): r.attempt for r in pii.attempts(spark.createDataFrame(entities, "kind string, entity string"), KEY).collect()}
    new = {(k, e): pii.surrogate(k, e, again.get((k, e), 0), KEY) for k, e in entities}
    assert len({(k, s) for (k, _), s in new.items()}) == len(entities)
    assert not {(k, s) for (k, _), s in new.items()} & set(entities)
    assert pii.render("given_f", "KIM", "anna-olga") == "ANNA-OLGA" and pii.render("email", "A@b.de", "efg@c.de") == "Efg@c.de"
    assert pii.render("phone", "+1 22 33", "+198765") == "+1 98 765"
    for kind, text in (("card", "4111111111111111"), ("iban", "DE44500105175407324931"), ("secret", "a-b-c-d-"), ("hex", "0" * 32), ("ip", "1.2.3.4")):
        assert len(pii.surrogate(kind, text, pii.WIDEN, KEY)) == len(text) + 1 or kind == "ip"
    assert pii._luhn(pii.surrogate("card", "4111111111111111", 13, KEY)[:-1]) == pii.surrogate("card", "4111111111111111", 13, KEY)[-1]
    rows = [(k, f"Mrs {n.title()} Kern, a@b.de") for k, n in enumerate(names)]
    found = replaced(spark, rows)
    monkeypatch.setattr(pii, "BROADCAST_AGAIN", 0)
    assert replaced(spark, rows) == found and len({r.entities[0].surrogate for r in found.values()}) == len(names)


def test_pii_names_of_any_script(spark):
    names = ["王伟", "محمد", "יוסף", "สมชาย", "김민준", "தமிழன்", "অমিত", "रमेश", "अमित", "Γεώργιος", "Ђорђе", "Գևորգ", "Åsa", "İbrahim", "Nguyễn", "ªªª"]
    rows = [(k, f"Dr {n}, 5") for k, n in enumerate(names)] + [(50, "password: !#$%&*!#")]
    rows += [(60 + k, f"{t} Dupont.") for k, t in enumerate(("M.", "Mme", "Mlle", "Sr.", "Sra.", "Srta.", "Señorita"))]
    got = replaced(spark, rows)
    for k, n in enumerate(names):
        (e,) = got[k].entities
        assert e.kind == "surname" and got[k].text == f"Dr {e.surrogate}, 5" and e.surrogate != n
    assert got[0].entities[0].surrogate[-1] != "伟"
    assert got[50].entities[0].surrogate != "!#$%&*!#"
    assert len({got[k].entities[0].surrogate for k in range(60, 67)}) == 1 and "Dupont" not in got[60].text
    attempts = {r.entity: r.attempt for r in pii.attempts(spark.createDataFrame([("surname", n.lower()) for n in names[:9]], "kind string, entity string"), KEY).collect()}
    assert max(attempts.values(), default=0) < pii.WIDEN
    assert len({pii.surrogate("surname", f"{chr(c)}伟", 0, KEY) for c in range(0x4E00, 0x9FFF)}) == 0x9FFF - 0x4E00


def test_simhash_by_bits():
    """The fingerprint as the contract words it: bit by bit."""
    import xxhash

    for text in ("a b c d e f a b c", "One two", "", "x " * 70, "Ä ö\u00a0ü ß é", *(f"{k} {k * k} {k ** 3} t" for k in range(20))):
        words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").split(" ") if w]
        parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
        assert simhash.fingerprint(text.encode()) == sum(1 << j for j in range(64) if sum(h >> j & 1 for h in hashes) * 2 > len(hashes))


def families(seed, n, members, edits, size):
    rng, texts, owner = random.Random(seed), [], []
    for k in range(n):
        passage = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for _ in range(members):
            own = list(passage)
            for _ in range(edits):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(2)
            around = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(80))] for _ in range(2)]
            texts.append(" ".join([*around[0], *own, *around[1]]))
            owner.append(k)
    return texts, owner


@pytest.mark.parametrize(("members", "edits", "size", "frequent"), [(15, 2, 100, None), (15, 1, 60, None), (3, 2, 80, None), (12, 0, 80, 8)])
def test_substring_recall(spark, monkeypatch, members, edits, size, frequent):
    """Of all pairs that hold a similar passage, near all are connected; also where values count as frequent and are split."""
    if frequent:
        monkeypatch.setattr(substring, "FREQUENT", frequent)
        monkeypatch.setattr(substring, "ENDS", 2)
        monkeypatch.setattr(substring, "BROADCAST_WANTED", 0)
    texts, owner = families(members, 12, members, edits, size)
    got = substring.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    hashes, _, starts = substring.shingles([t.encode() for t in texts])
    own = [(hashes[a : b - substring.SHINGLE + 1] >> np.uint64(32)).astype(np.uint32) for a, b in itertools.pairwise(starts.tolist())]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if owner[i] == owner[j]]
    true = {pairs[r[0]] for r in substring.verify([(own[i], own[j]) for i, j in pairs])}
    label = list(range(len(texts)))
    for r in got:
        a, b = label[r.doc_id], label[r.other_id]
        label = [a if x == b else x for x in label]
    assert len(true) > 3 and sum(label[i] == label[j] for i, j in true) >= 0.95 * len(true)
    assert len({x for p in true for x in p} & {r.doc_id for r in got}) >= 0.95 * len({x for p in true for x in p})
    assert all(owner[r.doc_id] == owner[r.other_id] for r in got)


@pytest.mark.parametrize(("members", "edits", "size", "block"), [(100, 3, 60, None), (60, 2, 60, 16)])
def test_substring_large_groups(spark, monkeypatch, members, edits, size, block):
    """Every two windows of a value meet: whatever passage they hold, their texts are connected. Also in blocks."""
    if block:
        monkeypatch.setattr(substring, "BLOCK", block)
    texts, owner = families(members, 3, members, edits, size)
    hashes, text, starts = substring.shingles([t.encode() for t in texts])
    stretch = lambda l, r: (hashes[l : r + 1] >> np.uint64(32)).astype(np.uint32)
    groups = {}
    for k in range(substring.HASHES):
        values = substring._ranked(hashes, k)
        for l, c, r in zip(*substring.windows(values), strict=True):
            groups.setdefault((k, int(values[c])), []).append((int(text[c]), stretch(l, r)))
    true = set()
    for windows in (w for w in groups.values() if len(w) > 32):
        pairs = [(a, b) if len(a[1]) <= len(b[1]) else (b, a) for a, b in itertools.combinations(windows, 2) if a[0] != b[0]]
        true |= {(pairs[r[0]][0][0], pairs[r[0]][1][0]) for r in substring.verify([(a[1], b[1]) for a, b in pairs])}
    got = substring.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    label = list(range(len(texts)))
    for r in got:
        a, b = label[r.doc_id], label[r.other_id]
        label = [a if x == b else x for x in label]
    assert len(true) > 100 and all(label[i] == label[j] for i, j in true)
    assert {x for p in true for x in p} <= {r.doc_id for r in got}
    assert all(owner[r.doc_id] == owner[r.other_id] for r in got)


def test_substring_rows_follow_the_texts(spark):
    """A passage that many texts hold connects them all by a few rows for each text."""
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    passage = fresh(70)
    texts = [f"{fresh(60)} {passage} {fresh(60)}" for _ in range(200)]
    got = substring.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    label = list(range(len(texts)))
    for r in got:
        a, b = label[r.doc_id], label[r.other_id]
        label = [a if x == b else x for x in label]
    assert len(set(label)) == 1 and len(got) < 8 * len(texts)


def test_substring_repeats(spark):
    """Shingles that repeat inside a window; and links of small groups are all pairs."""
    texts = ["la " * 70 + f"u{k} " * 3 + "x y z " * 30 for k in range(50)]
    got = substring.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(50))
    group, text = np.repeat(np.arange(4, 12, 4), 20).astype(np.uint64), np.tile(np.arange(20), 2)
    links = substring.link([group, text, *(np.full(40, k, np.int32) for k in (0, 9, 50))])
    assert Counter(zip(links[0].tolist(), links[1].tolist(), strict=True)) == Counter({p: 2 for p in itertools.combinations(range(20), 2)})


def test_substring_comparisons(monkeypatch):
    """Windows of frequent values: links connect what brute force over all pairs does, and few pairs need be verified for it."""
    rng = np.random.default_rng(5)
    fresh = lambda n: rng.integers(0, 1 << 32, n, np.uint32)
    rows, groups = [], [120, 70, *[5] * 20, 1]
    for g, members in enumerate(groups):
        passage, line = fresh(70), fresh(42)
        for t in range(members):
            own = np.concatenate((fresh(rng.integers(30)), passage if t % 3 else np.concatenate((fresh(30), line)), fresh(rng.integers(30))))
            own[rng.integers(0, len(own), t % 9)] = fresh(t % 9)
            rows.append((4 * g + 4, 1000 * g + t, 0, own))
    rows.append((4 * len(groups), rows[-1][1], 9, rows[-1][3]))  # a second window of the same text
    group, text, l, stretches = zip(*rows, strict=True)
    l, widths = np.array(l), np.array([len(s) for s in stretches])
    columns = [np.array(group, np.uint64), np.array(text), l, l, l + widths - 1]
    asked, verify = [], substring.verify
    monkeypatch.setattr(substring, "verify", lambda pairs, *a, **k: asked.extend(pairs) or verify(pairs, *a, **k))
    links = substring._similar([len(rows).to_bytes(4, "little") + substring._pack(columns, substring._WINDOW) + b"".join(s.tobytes() for s in stretches)])

    def components(pairs):
        label = {t: t for t in text}
        for i, j in pairs:
            a, b = label[i], label[j]
            label = {t: min(a, b) if x in (a, b) else x for t, x in label.items()}
        return label

    pairs = [(a, b) if len(a[3]) <= len(b[3]) else (b, a) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[1] != b[1]]
    true = [(pairs[r[0]][0][1], pairs[r[0]][1][1]) for r in verify([(a[3], b[3]) for a, b in pairs])]
    found = list(zip(links[0].tolist(), links[1].tolist(), strict=True))
    assert len(true) > 1000 and components(found) == components(true)
    assert len(found) == len(text) - 1 - len(set(components(true).values())) and len(asked) < 1.5 * len(found)


def test_substring_copies(spark):
    text, short = " ".join(f"u{k}" for k in range(60)), "too short to share"
    df = spark.createDataFrame([(5, text), (2, text), (9, text), (9, text), (None, text), (7, short), (8, short)], "doc_id long, text string")
    got = substring.passages(df).collect()
    assert Counter((r.doc_id, r.other_id) for r in got) == Counter({(5, 2): 1, (2, 9): 1, (9, 2): 2, (None, 2): 1})
    assert {(r.first_word, r.end_word, r.similarity) for r in got} == {(0, 60, 1.0)}


def test_noisy_or_by_hand(spark):
    rng = np.random.default_rng(3)
    weights = np.append(rng.random(toxicity.HASHED) * 0.3, -3.0)
    texts = ["Bad words here. And more of them!\nlast line", "one", "", None, "x " * 100]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights).collect()
    for r in got:
        clean = 1.0
        for line in (texts[r.doc_id] or "").lower().replace("!", "!\n").replace(".", ".\n").split("\n"):
            words = line.split()
            for k in range(0, len(words), toxicity.LONGEST):
                z = weights[-1]
                for w in words[k : k + toxicity.LONGEST]:
                    form = w.strip(".!").encode()
                    z += weights[zlib.crc32(form) % toxicity.HASHED] + sum(weights[zlib.crc32(form[:n], n) % toxicity.HASHED] for n in toxicity.FIRST)
                clean *= 1 - 1 / (1 + math.exp(-z))
        if not (texts[r.doc_id] or "").split():
            clean = 1 - 1 / (1 + math.exp(-weights[-1]))
        assert r.score == pytest.approx(1 - clean)


def test_decontaminate_by_brute_force(spark, monkeypatch):
    """Against the edit distance of every stretch; in one block and in several."""
    rng = random.Random(11)
    words = [f"v{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([3, 10, 16])))) for k in range(12)]
    texts = [(k, " ".join(rng.choices(words, k=rng.randrange(40)))) for k in range(25)]
    for k in range(25, 45):
        t = items[k % 12][1].split()
        t[rng.randrange(len(t))] = rng.choice(words)
        texts.append((k, " ".join([*rng.choices(words, k=5), *t, *rng.choices(words, k=5)])))

    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    exp = {(d, i, e) for d, t in texts for i, p in items if (e := least(p.split(), t.split())) <= len(p.split()) // 5}
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(docs, bench).collect()} == exp
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 6)
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(docs, bench).collect()} == exp
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {d for d, _ in texts} - {e[0] for e in exp}


def test_other_branches_give_the_same_rows(spark, docs, monkeypatch):
    """Joins instead of broadcasts, and every group frequent."""
    from speechlytics.llm import common

    key = lambda df: sorted(map(repr, df.collect()))
    runs = {"dedup": lambda: exact_dedup.exact_dedup(docs), "mix": lambda: mixing.mix(docs), "take": lambda: mixing.take(docs), "near": lambda: simhash.near_duplicates(docs)}
    before = {n: key(f()) for n, f in runs.items()}
    for module, name, value in ((exact_dedup, "BROADCAST_SUSPECTS", 0), (exact_dedup, "FREQUENT", 1), (mixing, "BROADCAST_RULES", 0), (common, "FREQUENT", 1)):
        monkeypatch.setattr(module, name, value)
    assert {n: key(f()) for n, f in runs.items()} == before


def test_mix_sizes_by_sql(spark, docs):
    import duckdb

    got = mixing.mix(docs).toPandas()
    rows = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841
    exp = duckdb.sql(r"WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM rows) SELECT doc_id, size, sum(size) OVER (PARTITION BY source) AS source_size FROM s").fetchall()
    show = lambda rows: sorted((-1 if d is None or d != d else int(d), int(a), int(b)) for d, a, b in rows)
    assert show(exp) == show(got[["doc_id", "size", "source_size"]].itertuples(index=False))


def test_sample_ends_at_its_bytes(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('x', 100) AS text", "1 AS _label")
    labels = docs.selectExpr("doc_id", "1 AS toxic")
    got = toxicity.sample(docs, labels, "toxic", 100, 5, 0, most_bytes=1000)
    assert got.count() == 10


def test_shared_folder_is_named_on_a_cluster():
    from speechlytics.llm import common

    class Fake:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError):
        common.shared_dir(Fake)
