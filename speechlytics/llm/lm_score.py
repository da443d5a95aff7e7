"""LM scoring by subword lattice likelihood.

A word's probability sums over all its segmentations into pieces of an existing vocabulary, by a forward recursion in
log space; a text's is the product over its words and one end. Pieces are weighted by the vocabulary's own scores, as a
prior of PRIOR uses, and by their expected uses in the training rows, by expectation maximisation.

    P(word) = (1 - c_end / N) * P_lattice(word)        P(end) = c_end / N

P_lattice is a proper distribution: a piece that starts a word, then inner pieces until a stop. Beside it stands a second
score in which a word of the training rows is an arc of its own, with its discounted frequency; the discounted mass goes
to the lattice:

    P(word) = max(c - d, 0) / N + d * T / N * P_lattice(word)

Counts cover all rows. Words over N / 2**19 (so at most 2**19 of them) are scored where the text is; the rest are
joined by word, none of them frequent enough to skew.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches, utf8
from .labelled import fold

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT = 5, 1
ROUNDS = 2
#: Uses of start pieces, and of inner ones, that the vocabulary's scores stand for when weights are fitted.
PRIOR = 10_000.0
#: Words counted in memory before they are handed on.
HELD_TYPES = 400_000
#: A word is scored in place if it makes up more than one in so many tokens.
HEAD = 1 << 19
_LN10 = math.log(10)
_UPPER = re.compile("[A-Z]")
#: Characters of the words whose lattices are summed together.
BLOCK = 1 << 17
#: The tries' roots; the bits of a character's code in a key, and a code beyond all characters.
_START, _INNER, _CODE_BITS, _END = 0, 1, 21, 0x110000


def read_pieces(path: str = VOCABULARY) -> tuple[list[str], list[bool], np.ndarray]:
    """Pieces, whether each starts a word, and log weights by the vocabulary's scores. Start pieces lack their mark; bytes are one character at 0xDC00 + byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, starts, scores = [""], [True], [0.0]
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_control(k) or model.is_unknown(k):
            continue
        if model.is_byte(k):
            pieces.append(chr(0xDC00 + int(piece[3:5], 16)))
            starts.append(False)
            scores.append(-float(model.get_piece_size()))
        elif piece.strip("▁") or piece == "▁":
            start = piece.startswith("▁")
            body = piece[1:] if start else piece
            # Texts are lower-cased in A-Z alone.
            if _UPPER.search(body) or "▁" in body or not body:
                continue
            pieces.append(body)
            starts.append(start)
            scores.append(model.get_score(k))
    # The scores are ranks, best near 0: Zipf's law turns them into weights.
    return pieces, starts, -np.log(100.0 - np.array(scores))


def blocks(words: list[str]) -> Iterator[list[str]]:
    """The words in blocks of about BLOCK characters."""
    start, held = 0, 0
    for k, word in enumerate(words):
        held += len(word) + 1
        if held > BLOCK:
            yield words[start : k + 1]
            start, held = k + 1, 0
    if start < len(words):
        yield words[start:]


class Arcs:
    """The arcs of a block of words laid end to end, a word of n characters having n + 1 slots.

    ``first``: (end, piece) of the start arcs; ``begin``, ``end``, ``piece``: the inner ones. A character that no piece
    covers is an arc by its bytes: its piece is ``size`` plus its place in ``spelled``, which holds the byte pieces.
    """

    def __init__(self, lattice: Lattice, words: list[str]):
        sizes = np.array([len(w) for w in words], np.int64)
        self.last = np.cumsum(sizes + 1) - 1
        chars = np.frombuffer(" ".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        chars[self.last] = _END
        starts = self.last - sizes
        self.word = np.repeat(np.arange(len(words)), sizes + 1)
        self.at = np.arange(len(chars)) - starts[self.word]

        begin, end, piece = lattice.walk(_START, starts, chars)
        self.first = np.concatenate((starts, end)), np.concatenate((np.full(len(starts), lattice.start[""]), piece))
        inside = np.flatnonzero(chars != _END)
        begin, end, piece = lattice.walk(_INNER, inside, chars)
        covered = np.zeros(len(chars), bool)
        covered[begin[end == begin + 1]] = True
        bare = inside[~covered[inside]]
        codes, which = np.unique(chars[bare], return_inverse=True)
        self.spelled = [[lattice.inner[chr(0xDC00 + x)] for x in chr(c).encode("utf-8", "surrogatepass")] for c in codes.tolist()]
        self.begin, self.end = np.concatenate((begin, bare)), np.concatenate((end, bare + 1))
        self.piece = np.concatenate((piece, lattice.size + which))

    def steps(self, slots: np.ndarray) -> list[np.ndarray]:
        """The arcs by the place of their ``slots`` in the word. Those of one step begin, or end, in different slots."""
        at = self.at[slots]
        most = int(at.max(initial=-1))
        order = np.argsort(at.astype(np.uint16) if most < 1 << 16 else at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(most + 2))
        return [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def weigh(self, weights: np.ndarray) -> np.ndarray:
        return np.concatenate((weights, [weights[ks].sum() for ks in self.spelled]))

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """Of each slot, the log of the sum over the ways from the word's start. ``weights``: of ``weigh``."""
        alpha = np.full(len(self.at), -np.inf)
        alpha[self.first[0]] = weights[self.first[1]]
        for arcs in self.steps(self.begin):
            ends = self.end[arcs]
            alpha[ends] = np.logaddexp(alpha[ends], alpha[self.begin[arcs]] + weights[self.piece[arcs]])
        return alpha

    def backward(self, weights: np.ndarray) -> np.ndarray:
        """Of each slot, the log of the sum over the ways to the word's end."""
        beta = np.full(len(self.at), -np.inf)
        beta[self.last] = 0
        for arcs in reversed(self.steps(self.end)):
            begins = self.begin[arcs]
            beta[begins] = np.logaddexp(beta[begins], beta[self.end[arcs]] + weights[self.piece[arcs]])
        return beta


class Lattice:
    """Pieces with log weights; ``stop`` is the last of the inner ones. Two tries, of start and inner pieces, find arcs."""

    def __init__(self, pieces: list[str], starts: list[bool], weights: np.ndarray):
        self.start = {p: k for k, (p, s) in enumerate(zip(pieces, starts, strict=True)) if s}
        self.inner = {p: k for k, (p, s) in enumerate(zip(pieces, starts, strict=True)) if not s}
        self.stop, self.size = len(pieces), len(pieces) + 1
        self.is_start = np.append(np.array(starts), False)
        self.prior = np.zeros(self.size)
        self.weights = self.normalised(np.append(np.exp(weights), np.exp(weights[~np.array(starts)]).sum() / 3))
        # What the vocabulary's own scores count for beside the corpus, in expected uses.
        self.prior = PRIOR * np.exp(self.weights)
        children, held = {}, {}
        for root, own in ((_START, self.start), (_INNER, self.inner)):
            for piece, k in own.items():
                node = root
                for c in piece:
                    node = children.setdefault(node << _CODE_BITS | ord(c), len(children) + 2)
                if piece:
                    held[node] = k
        self.keys = np.array(sorted(children), np.int64)
        self.child = np.array([children[k] for k in self.keys.tolist()], np.int64)
        self.held = np.full(len(children) + 2, -1, np.int64)
        self.held[list(held)] = list(held.values())

    @classmethod
    def of(cls, state: dict) -> Lattice:
        """From a broadcast ``vars(lattice)``, which needs no class to be read."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def normalised(self, counts: np.ndarray) -> np.ndarray:
        """Log weights, of expected uses and the vocabulary's own scores: start pieces sum to one, inner ones and the stop too."""
        counts = counts + self.prior + 1e-9
        total = np.where(self.is_start, counts[self.is_start].sum(), counts[~self.is_start].sum())
        return np.log(counts / total)

    def walk(self, root: int, begin: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, piece) of every piece that lies in ``chars`` from one of ``begin`` on: all go down the trie together."""
        node, at, found = np.full(len(begin), root), begin, ([], [], [])
        while len(at):
            key = node << _CODE_BITS | chars[at]
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            go = self.keys[where] == key
            node, begin, at = self.child[where[go]], begin[go], at[go] + 1
            piece = self.held[node]
            for out, x in zip(found, (begin, at, piece), strict=True):
                out.append(x[piece >= 0])
        return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in found)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Of each word, the natural log of the sum over all segmentations."""
        out = [np.empty(0)]
        for block in blocks(words):
            arcs = Arcs(self, block)
            out.append(arcs.forward(arcs.weigh(self.weights))[arcs.last] + self.weights[self.stop])
        return np.concatenate(out)

    def log_probability(self, word: str) -> float:
        return float(self.log_probabilities([word])[0])

    def expect(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """The expected uses of each piece in so many occurrences of each word."""
        counts, at = np.zeros(self.size), 0
        for block in blocks(words):
            arcs, n = Arcs(self, block), times[at : at + len(block)].astype(np.float64)
            at += len(block)
            weights = arcs.weigh(self.weights)
            alpha, beta = arcs.forward(weights), arcs.backward(weights)
            total = alpha[arcs.last]
            inner = np.exp(alpha[arcs.begin] + weights[arcs.piece] + beta[arcs.end] - total[arcs.word[arcs.begin]])
            uses = np.bincount(arcs.piece, inner * n[arcs.word[arcs.begin]], minlength=len(weights))
            ends, pieces = arcs.first
            uses += np.bincount(pieces, np.exp(weights[pieces] + beta[ends] - total[arcs.word[ends]]) * n[arcs.word[ends]], minlength=len(weights))
            for ks, used in zip(arcs.spelled, uses[self.size :].tolist(), strict=True):
                np.add.at(counts, ks, used)
            counts += uses[: self.size]
            counts[self.stop] += n.sum()
        return counts


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, whether it trains) -> word, its tokens in training texts, its tokens in all."""

    def flush(train: Counter, other: Counter) -> pa.RecordBatch:
        words = [*train, *(w for w in other if w not in train)]
        n = np.array([train[w] for w in words], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n), pa.array(n + np.array([other[w] for w in words], np.int64))], ["word", "c", "n"])

    train, other = Counter(), Counter()
    for batch in small_batches(batches, "_text"):
        for text, trains in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (train if trains else other).update(text.lower().split())
        if len(train) + len(other) > HELD_TYPES:
            yield flush(train, other)
            train, other = Counter(), Counter()
    yield flush(train, other)


def fit(types: DataFrame, lattice: Lattice, rounds: int = ROUNDS) -> Lattice:
    """Expectation maximisation over the words of the training rows, by their counts, with the vocabulary's scores as prior."""
    spark = types.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(vars(lattice))

        def expectations(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Lattice.of(sent.value)
            counts = np.zeros(own.size)
            for batch in batches:
                counts += own.expect([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()], batch.column(1).to_numpy(zero_copy_only=False))
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["piece", "v"])

        got = types.where("c > 0").select("word", "c").mapInArrow(expectations, "piece int, v double").groupBy("piece").agg(F.sum("v").alias("v")).collect()
        counts = np.zeros(lattice.size)
        counts[[r["piece"] for r in got]] = [r["v"] for r in got]
        lattice.weights = lattice.normalised(counts)
    return lattice


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, word_arcs: bool = False) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score, score_with_words for every row of ``docs``; logs to base 10.

    score is lattice_score, or with ``word_arcs`` score_with_words. Other columns of ``docs`` are ignored. Long texts are
    scored whole; ties can't occur. Null and empty texts are one end token. Rows with a null id train. Repeated rows count and are scored each. Without
    training rows the base is uniform over its one unseen token, and the model is the lattice with half of the mass for ends.
    """
    spark: SparkSession = docs.sparkSession
    named = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_text"))
    held = fold(FOLDS, "_id") == HELD_OUT
    ends = named.agg(F.count_if(~held).alias("c"), F.count("*").alias("n")).first()
    # As many parts as asked for: the lattice costs far more than a part's bytes tell.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    types = named.select("_text", (~held).alias("_trains")).mapInArrow(_counts, "word binary, c long, n long").repartition(parts, "word").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    types = materialize(types, "types")
    of = types.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("c"), F.sum("n"), *(F.count_if(F.expr(e)) for e in ("c > 0", "c = 1", "c = 2"))))).first()
    tokens, all_tokens, known_types = of[0] + ends["c"], of[1] + ends["n"], of[2]
    distinct = known_types + (ends["c"] > 0)
    discount = of[3] / (of[3] + 2 * of[4]) if of[3] else 0.5
    rest = math.log(discount * known_types / tokens) if known_types else math.log(0.5)
    inside = math.log1p(-ends["c"] / tokens) if known_types else math.log(0.5)
    unseen = -math.log10((tokens + 0.5 * (distinct + 1)) / 0.5)

    lattice = spark.sparkContext.broadcast(vars(fit(types, Lattice(*read_pieces(vocabulary)))))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice.of(lattice.value)
        for batch in batches:
            sums = own.log_probabilities([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()])
            low = rest + sums
            c = batch.column(1).to_numpy(zero_copy_only=False)
            high = np.log(np.maximum(np.maximum(c - discount, 0) / max(1, tokens), 1e-300))
            wp = np.where(c > 0, np.logaddexp(high, low), low) / _LN10
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))), pa.array((inside + sums) / _LN10), pa.array(wp)], [*batch.schema.names, "base", "lp", "wp"])

    scored = materialize(types.mapInArrow(weigh, "word binary, c long, n long, base double, lp double, wp double"), "scored")
    # Fewer than HEAD words can each be over one in HEAD of all tokens.
    head = spark.sparkContext.broadcast(scored.where(F.col("n") * HEAD > all_tokens).select("word", "c", "base", "lp", "wp").toPandas())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with the sums over its frequent words, and one for each other word in it."""
        at = {bytes(w): k for k, w in enumerate(head.value["word"])}
        known, values = (head.value["c"] > 0).to_numpy(), head.value[["base", "lp", "wp"]].to_numpy()
        names = ["row", "_id", "held_out", "n_tokens", "word", "many", "n_known", "base", "lp", "wp"]
        for batch in small_batches(batches, "_text"):
            rows, out = batch.column(0).to_pylist(), [[], [], []]
            sums = np.zeros((batch.num_rows, 5))
            for k, text in enumerate(batch.column(3).to_pylist()):
                words = text.lower().split()
                where = [at.get(w, -1) for w in words]
                places = np.array(where, np.int64)
                places = places[places >= 0]
                sums[k] = len(words) + 1, known[places].sum(), *values[places].sum(axis=0)
                if len(places) < len(words):
                    for w, n in Counter(w for w, p in zip(words, where, strict=True) if p < 0).items():
                        out[0].append(rows[k])
                        out[1].append(w)
                        out[2].append(n)
            nothing = lambda n, kind: pa.nulls(n, kind)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums[:, 0].astype(np.int64)), nothing(n, pa.binary()), nothing(n, pa.int64()), pa.array(sums[:, 1].astype(np.int64)), *(pa.array(sums[:, k]) for k in (2, 3, 4))], names)
            m = len(out[0])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), nothing(m, batch.schema.field(1).type), nothing(m, pa.bool_()), nothing(m, pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), nothing(m, pa.int64()), *(nothing(m, pa.float64()) for _ in range(3))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    placed = named.select(F.monotonically_increasing_id().alias("row"), "_id", held.alias("held_out"), "_text")
    placed = materialize(placed.mapInArrow(place, f"row long, _id {kind}, held_out boolean, n_tokens long, word binary, many long, n_known long, base double, lp double, wp double"), "placed")
    tail = placed.where("word is not null").select("row", "word", "many").join(scored.select("word", "c", F.col("base").alias("b"), F.col("lp").alias("l"), F.col("wp").alias("w")), "word")
    tail = tail.select("row", F.when(F.col("c") > 0, F.col("many")).otherwise(0).alias("n_known"), (F.col("b") * F.col("many")).alias("base"), (F.col("l") * F.col("many")).alias("lp"), (F.col("w") * F.col("many")).alias("wp"))
    summed = placed.where("word is null").select("row", "_id", "held_out", "n_tokens", "n_known", "base", "lp", "wp")
    none = {c: F.lit(None).cast(summed.schema[c].dataType) for c in ("_id", "held_out", "n_tokens")}
    both = summed.unionByName(tail.withColumns(none).select(*summed.columns))
    end_base = math.log10((ends["c"] + 0.5) / (tokens + 0.5 * (distinct + 1))) if ends["c"] else unseen
    end = math.log10(ends["c"] / tokens) if ends["c"] else math.log10(0.5)
    result = both.groupBy("row").agg(F.max("_id").alias(id_col), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), (F.sum("n_known") + int(ends["c"] > 0)).alias("n_known"), F.sum("base").alias("base"), F.sum("lp").alias("lp"), F.sum("wp").alias("wp"))
    return result.select(id_col, "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("base") + end_base).alias("base_score"), (F.col("wp" if word_arcs else "lp") + end).alias("score"), (F.col("lp") + end).alias("lattice_score"), (F.col("wp") + end).alias("score_with_words"))
