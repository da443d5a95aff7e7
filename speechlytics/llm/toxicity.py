"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its hashed words and their first bytes (which
carry over to inflected and compound forms); the document's is their
noisy-or, 1 - prod(1 - p). Only document labels train it, by gradient through the noisy-or, so the sentences that
carry a label are found on the way and can be located afterwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, small_batches, utf8
from .labelled import fitted, fold, sample

FOLDS, HELD_OUT = 5, 0
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 12_000
THRESHOLD = 0.5
HASHED = 1 << 17
#: Features of a word: itself, and its first so many bytes.
FIRST = (4, 5, 6)
PER_WORD = 1 + len(FIRST)
#: A sentence ends at . ! ? or a line's end, and after so many words at the latest.
LONGEST = 40
#: Bytes of text that are scored at a time while rows are dropped: a worker holds many times as much, and keeps it.
PART = 1 << 20
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LINE = b"\x01"
_SCHEMA = "_id {}, score double, offending array<struct<first_word:int,words:int,score:double>>"


def sentences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each word, its sentence) of all texts' words in a row, and each sentence's text. Every text has a sentence at least."""
    hashed, sentence, owner, at, known = [], [], [], 0, {}
    for k, text in enumerate(texts):
        words = text.lower().replace(b"\n", b" \x01 ").split()
        n = len(words)
        ends = np.isin(np.fromiter((w[-1] for w in words), np.uint8, n), np.frombuffer(b".!?\x01", np.uint8))
        own = np.concatenate(([0], np.cumsum(ends)[:-1])) if n else np.zeros(0, np.int64)
        real = np.fromiter((w != _LINE for w in words), bool, n)
        own = own[real]
        # Empty sentences go, long ones are cut.
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        inside = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
        own = np.cumsum((inside % LONGEST) == 0) - 1
        hashed.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)[real])
        sentence.append(own + at)
        many = int(own[-1]) + 1 if len(own) else 1
        owner.append(np.full(many, k))
        at += many
    forms = [w.strip(_EDGES) for w in known]
    table = np.array([[zlib.crc32(w)] + [zlib.crc32(w[:k], k) for k in FIRST] for w in forms], np.uint32).reshape(-1, PER_WORD) % HASHED
    return table[np.concatenate(hashed)], np.concatenate(sentence).astype(np.int64), np.concatenate(owner)


def _logits(weights: np.ndarray, words: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(sentence, weights[words].sum(axis=1), minlength=n) + weights[-1]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 1500, batch: int = 64, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights of the hashed words, then the bias. ``bags``: ``sentences([text])`` of each document."""
    weights, squares = np.zeros(HASHED + 1), np.full(HASHED + 1, 1e-3)
    weights[-1], rng = -6.0, np.random.default_rng(seed)
    for _ in range(-(-steps * batch // max(1, len(bags))) if len(bags) else 0):
        for some in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // batch)):
            words = np.concatenate([bags[i][0] for i in some])
            counts = [len(bags[i][2]) for i in some]
            starts = np.cumsum([0, *counts[:-1]])
            sentence = np.concatenate([bags[i][1] + s for i, s in zip(some, starts, strict=True)])
            z = _logits(weights, words, sentence, sum(counts))
            total = np.add.reduceat(_softplus(z), starts)
            # d loss / d total: 1 for a clean document, -1 / (e^total - 1) for a toxic one.
            slope = np.where(labels[some] > 0, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0)
            dz = np.repeat(np.clip(slope, -50, 1), counts) / (1 + np.exp(-z))
            grad = np.append(np.bincount(words.ravel(), np.repeat(dz[sentence], PER_WORD), minlength=HASHED), dz.sum()) / len(some)
            grad[:-1] += decay * (weights[:-1] > 0)
            squares += grad * grad
            weights -= rate * grad / np.sqrt(squares)
            # Words only speak for toxicity: harmless ones mustn't outweigh an insult in the same sentence.
            np.maximum(weights[:-1], 0, out=weights[:-1])
    return weights.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> np.ndarray:
    """Weights from a bounded sample of labelled documents; without any, weights that score all texts alike (low)."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            found = [sentences([x]) for x in batch.column(0).to_pylist()]
            packed = [pa.array([f[0].astype("<u4").tobytes() for f in found], pa.binary()), pa.array([f[1].astype("<u4").tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*packed, pa.array([len(f[2]) for f in found], pa.int32()), batch.column(1)], ["words", "sentence", "n", "_label"])

    rows = sample(docs, labels, label, most, FOLDS, HELD_OUT, id_col, text_col, _text=utf8(text_col))

    def learn(rows: list[dict]) -> np.ndarray:
        rows.sort(key=lambda r: (r["n"], r["words"], r["_label"]))  # the order of the rows mustn't matter
        # Views of what came, about 20 bytes a word.
        found = [(np.frombuffer(r["words"], "<u4").reshape(-1, PER_WORD), np.frombuffer(r["sentence"], "<u4"), range(r["n"])) for r in rows]
        return fit(found, np.array([r["_label"] for r in rows]))

    return fitted(rows.select("_text", "_label").mapInArrow(bags, "words binary, sentence binary, n int, _label int"), learn)


def _score(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("score", pa.float64())]))
        for batch in small_batches(batches, "_text"):
            words, sentence, owner = sentences(batch.column(1).to_pylist())
            z = _logits(weights, words, sentence, len(owner))
            score = -np.expm1(-np.bincount(owner, _softplus(z), minlength=batch.num_rows))
            bad = np.flatnonzero(z >= 0)
            length, spans = np.bincount(sentence, minlength=len(owner)), [[] for _ in range(batch.num_rows)]
            first = np.cumsum(length) - length
            of = np.concatenate(([0], np.cumsum(np.bincount(owner, length, minlength=batch.num_rows)))).astype(np.int64)
            for k in bad:
                spans[owner[k]].append({"first_word": int(first[k] - of[owner[k]]), "words": int(length[k]), "score": float(1 / (1 + np.exp(-z[k])))})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(spans, kind)], ["_id", "score", "offending"])

    return run


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted, offending for every row of ``docs``.

    offending: the sentences that are toxic by themselves (score 0.5 or more), by first word and number of words. Null
    and empty texts are one empty sentence and get the bias. Repeated rows are scored alike; a null id isn't held out.
    Texts of any length count whole; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_text")).mapInArrow(_score(weights), _SCHEMA.format(kind))
    return scored.select(F.col("_id").alias(id_col), (fold(FOLDS, "_id") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")


def drop_toxic(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, in one pass and with their columns as they are, whatever their names.

    Null and empty texts stay, unless the bias alone is toxic. Repeated rows go or stay together.
    """

    def run(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, PART):
            words, sentence, owner = sentences([(x or "").encode() for x in batch.column(text).to_pylist()])
            z = _logits(weights, words, sentence, len(owner))
            keep = -np.expm1(-np.bincount(owner, _softplus(z), minlength=batch.num_rows)) < THRESHOLD
            yield batch.filter(pa.array(keep))

    return filtered(docs, text_col, run)
