"""Quality classifier: a factorisation machine (Rendle, 2010).

Features are hashed words, structure statistics of the text and the row's length as metadata. The pairwise part is
0.5 * sum_f((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2): linear in the number of features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8
from .labelled import fitted, fold, sample

FOLDS, HELD_OUT = 4, 2
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 12_000
THRESHOLD = 0.7
HASHED = 1 << 15
FACTORS = 8
#: The statistics of ``statistics``, standardised, follow the hashed words.
STATS = 14


def statistics(text: bytes, words: list[bytes], distinct: int, n_chars: int) -> list[float]:
    n, size = max(1, len(words)), max(1, len(text))
    without = lambda gone: 1 - len(text.translate(None, gone)) / size
    lines = text.split(b"\n")
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(max(0, n_chars)), size / n, distinct / n,
        without(b"#$%&*@^~|<>{}[]\\=+_"), without(b".,;:!?\"'()-"), without(b"0123456789"), without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        np.log1p(len(lines)), np.log1p(n / len(lines)), len(set(lines)) / len(lines),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, without(b"|"),
    ]


def features(texts: list[bytes], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed word) of every distinct pair, in order of the texts, and the statistics by text."""
    rows, stats = [], np.zeros((len(texts), STATS))
    for k, (text, n) in enumerate(zip(texts, n_chars, strict=True)):
        words = text.lower().split()
        hashed = np.unique(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % HASHED)
        stats[k] = statistics(text, words, len(set(words)), n or 0)
        rows.append(hashed)
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows).astype(np.int64), stats


class Machine:
    """Bias, linear weights and factors over hashed words and standardised statistics."""

    def __init__(self, seed: int = 7):
        n = HASHED + STATS
        self.bias, self.linear = 0.0, np.zeros(n)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (FACTORS, n))
        self.mean, self.scale = np.zeros(STATS), np.ones(STATS)

    def inputs(self, doc: np.ndarray, word: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (document, feature, value): words share a length of one, statistics are standardised and clipped."""
        n = len(stats)
        share = 1 / np.sqrt(np.maximum(1, np.bincount(doc, minlength=n)))
        standard = np.clip((stats - self.mean) / self.scale, -4, 4) / 2
        return (
            np.concatenate((doc, np.repeat(np.arange(n), STATS))),
            np.concatenate((word, np.tile(HASHED + np.arange(STATS), n))),
            np.concatenate((share[doc], standard.ravel())),
        )

    def logits(self, doc, feature, value, n):
        """The logits, and each factor's sums by document."""
        z = self.bias + np.bincount(doc, self.linear[feature] * value, minlength=n)
        sums = []
        for v in self.factors:
            vx = v[feature] * value
            s = np.bincount(doc, vx, minlength=n)
            z += 0.5 * (s * s - np.bincount(doc, vx * vx, minlength=n))
            sums.append(s)
        return z, sums

    def predict(self, texts: list[bytes], n_chars: list[int | None]) -> np.ndarray:
        z, _ = self.logits(*self.inputs(*features(texts, n_chars)), len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, words: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Machine:
        if not len(labels):
            return self
        self.mean, self.scale = stats.mean(0), stats.std(0) + 1e-6
        share = (labels.sum() + 1) / (len(labels) + 2)
        self.bias, rng = float(np.log(share / (1 - share))), np.random.default_rng(seed)
        past = [1e-4, np.full_like(self.linear, 1e-4), np.full_like(self.factors, 1e-4)]
        for _ in range(epochs):
            for some in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
                doc = np.repeat(np.arange(len(some)), [len(words[i]) for i in some])
                doc, feature, value = self.inputs(doc, np.concatenate([words[i] for i in some]), stats[some])
                z, sums = self.logits(doc, feature, value, len(some))
                error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[some]) / len(some)
                pull, n = error[doc] * value, len(self.linear)
                linear = np.bincount(feature, pull, minlength=n) + decay * self.linear
                factors = np.stack([np.bincount(feature, pull * (s[doc] - v[feature] * value), minlength=n) for v, s in zip(self.factors, sums, strict=True)])
                for k, grad in enumerate((error.sum(), linear, factors)):
                    past[k] = past[k] + grad * grad
                    step = rate * grad / np.sqrt(past[k])
                    if k == 0:
                        self.bias -= float(step)
                    elif k == 1:
                        self.linear -= step
                    else:
                        self.factors -= step
        self.linear, self.factors = self.linear.astype(np.float32), self.factors.astype(np.float32)
        return self


def _columns(text_col: str, chars_col: str | None) -> dict[str, Column]:
    return {"_text": utf8(text_col), "_n": F.col(chars_col).cast("long") if chars_col else F.length(text_col).cast("long")}


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", label: str = "quality") -> Machine:
    """Fitted on a bounded sample of labelled documents; without any, every text scores one half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            texts = batch.column(1).to_pylist()
            doc, word, stats = features(texts, batch.column(2).to_pylist())
            packed = [x.astype("<u2").tobytes() for x in np.split(word, np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array(list(stats)), batch.column(3)], ["words", "stats", "_label"])

    rows = sample(docs, labels, label, most, FOLDS, HELD_OUT, id_col, text_col, **_columns(text_col, chars_col)).select("_id", "_text", "_n", "_label")

    def learn(rows: list[dict]) -> dict:
        rows.sort(key=lambda r: (r["words"], r["_label"], r["stats"]))  # the order of the rows mustn't matter
        words = [np.frombuffer(r["words"], "<u2").astype(np.int64) for r in rows]
        return vars(Machine().fit(words, np.array([r["stats"] for r in rows]).reshape(-1, STATS), np.array([r["_label"] for r in rows], np.float64)))

    machine = Machine()
    vars(machine).update(fitted(rows.mapInArrow(run, "words binary, stats array<double>, _label int"), learn))
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """id, held_out, score, predicted for every row of ``docs``.

    Null texts count as empty and are scored by their statistics alone; a null length counts as 0. Repeated rows are
    scored alike; a null id isn't held out. Texts of any length count whole; other columns are ignored; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.predict(batch.column(1).to_pylist(), batch.column(2).to_pylist()))], ["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("_id"), *(c.alias(k) for k, c in _columns(text_col, chars_col).items())).mapInArrow(run, f"_id {kind}, score double")
    return scored.select(F.col("_id").alias(id_col), (fold(FOLDS, "_id") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
