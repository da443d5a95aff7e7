"""Alignment of a hypothesis to the positions of its reference.

An Arrow function: all pairs of a batch run through the dynamic programme together, one anti-diagonal at a time, on
integer codes of the words. Ties go back from the end, diagonal before deletion before insertion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells (a byte each) that are held at once; a pair with more is held alone.
CELLS = 1 << 25
_DIAGONAL, _DELETION, _INSERTION = 0, 1, 2


def _group(ref: np.ndarray, hyp: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Codes of pairs, padded to the longest, and their lengths -> by reference position the place of its hypothesis word, or -1."""
    pairs, wide = ref.shape
    high = hyp.shape[1]
    moves = np.full((wide + high + 1, pairs, wide + 1), _DIAGONAL, np.int8)
    rows = np.zeros((pairs, wide + 1), np.int32)
    before = rows.copy()
    for d in range(1, wide + high + 1):
        # Cells (i, d - i); of the last two diagonals, column i holds (i, d - 1 - i) and (i, d - 2 - i).
        now = np.zeros_like(rows)
        low, top = max(1, d - high), min(wide, d - 1)
        if low <= top:
            same = before[:, low - 1 : top] + (ref[:, low - 1 : top] != hyp[:, d - top - 1 : d - low][:, ::-1])
            deleted, inserted = rows[:, low - 1 : top] + 1, rows[:, low : top + 1] + 1
            best = np.minimum(same, np.minimum(deleted, inserted))
            now[:, low : top + 1] = best
            moves[d, :, low : top + 1] = np.where(best == same, _DIAGONAL, np.where(best == deleted, _DELETION, _INSERTION))
        if d <= high:
            now[:, 0] = d
        if d <= wide:
            now[:, d] = d
            moves[d, :, d] = _DELETION
        before, rows = rows, now
    out = np.full((pairs, wide), -1, np.int64)
    i, j, left = n.copy(), m.copy(), np.flatnonzero(n)
    while len(left):
        move = moves[i[left] + j[left], left, i[left]]
        kept = left[move == _DIAGONAL]
        out[kept, i[kept] - 1] = j[kept] - 1
        i[left[move != _INSERTION]] -= 1
        j[left[move != _DELETION]] -= 1
        left = left[i[left] > 0]
    return out


def _places(codes: np.ndarray, ref_at: np.ndarray, n: np.ndarray, hyp_at: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Pairs by where their words start in ``codes`` and how many there are -> for all their reference positions the hypothesis word's place in ``codes``, or -1."""
    out = np.full(int(n.sum()), -1, np.int64)
    to = np.cumsum(n) - n
    order, start = np.lexsort((m, n)), int((n == 0).sum())
    while start < len(order):
        # As many pairs, by length, as fit.
        wide, high = np.maximum.accumulate(n[order[start:]]), np.maximum.accumulate(m[order[start:]])
        fit = (wide + high + 1) * (wide + 1) * np.arange(1, len(wide) + 1) <= CELLS
        many = max(1, len(fit) if fit.all() else int(np.argmin(fit)))
        own = order[start : start + many]
        start += many
        ref, hyp = (np.full((many, int(size[own].max())), pad, np.int64) for size, pad in ((n, -2), (m, -3)))
        for held, at, size in ((ref, ref_at, n), (hyp, hyp_at, m)):
            place = np.arange(held.shape[1])
            inside = place < size[own][:, None]
            held[inside] = codes[(at[own][:, None] + place)[inside]]
        found = _group(ref, hyp, n[own], m[own])
        place = np.arange(ref.shape[1])
        inside = place < n[own][:, None]
        out[(to[own][:, None] + place)[inside]] = np.where(found >= 0, found + hyp_at[own][:, None], -1)[inside]
    return out


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def align_batch(ref: pa.Array, models: pa.Array) -> pa.Array:
    """Lists of words and lists of models' words -> for each row and model the hypothesis words by reference position, "" where deleted; null for null.

    A model that is null has no words.
    """
    missing = pc.or_(pc.is_null(ref), pc.is_null(models))
    kept = pc.invert(missing)
    ref, models = ref.filter(kept), models.filter(kept)
    each = models.flatten()
    words = pa.concat_arrays([ref.flatten(), each.flatten()])
    codes = pc.fill_null(words.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(ref)), _lengths(models))
    sizes, m = _lengths(ref), _lengths(each)
    n = sizes[of]
    places = _places(codes, (np.cumsum(sizes) - sizes)[of], n, sizes.sum() + np.cumsum(m) - m, m)
    aligned = pc.fill_null(words.take(pa.array(places, mask=places < 0)), "")
    inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), aligned)
    whole = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(_lengths(models))), pa.int32()), inner)
    back = np.cumsum(kept.to_numpy(zero_copy_only=False)) - 1
    return whole.take(pa.array(back, mask=missing.to_numpy(zero_copy_only=False)))


def align_words(ref: list[str], hyp: list[str]) -> list[str]:
    """For each reference position the hypothesis word there, or "" where it was deleted; insertions aren't kept."""
    kind = pa.list_(pa.string())
    return align_batch(pa.array([ref], kind), pa.array([[hyp]], pa.list_(kind))).to_pylist()[0][0]


align_models = F.arrow_udf(align_batch, T.ArrayType(T.ArrayType(T.StringType())))
