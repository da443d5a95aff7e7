"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-cased words without edge punctuation; of scripts that are written without spaces,
every character is a word. An item of m words may differ by e = m // 5
word edits (a similarity of 0.8). Split into e + 1 pieces, any passage within the budget holds one piece unchanged: an
Aho-Corasick automaton finds every exact piece hit, and Myers' bit-parallel distance (words as symbols, start and end
free) verifies the words around it. Nothing within the budget can be missed. Items of under five words have no edits and are looked for as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, filtered, materialize, small_batches

#: Word edits allowed: one in so many words of the item.
WORDS_PER_EDIT = 5
#: Benchmark items that are searched for in one pass over the documents, and their text in UTF-8 at most.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Thai, Lao, Tibetan, Myanmar, Khmer, Tai, Chinese and Japanese: no spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u2e80-\u2fdf\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
#: Their punctuation, which parts words of any script in such a text.
_SIGNS = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\u303d\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\u2018-\u201f\u2026\u0f0b-\u0f14\u104a-\u104f\u17d4-\u17da]")


def words(text: str | None) -> list[str]:
    text = (text or "").lower()
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", _SIGNS.sub(" ", text))
    return [s for w in text.split() if (s := w.strip(_EDGES))]


def pieces(item: list[str]) -> list[tuple[int, list[str]]]:
    """(offset, words) of budget + 1 even pieces."""
    n = len(item) // WORDS_PER_EDIT + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """(least word edits between the pattern and any stretch of ``text``, where the first best stretch ends)."""
    m, symbols = len(pattern), {}
    for i, w in enumerate(pattern):
        symbols[w] = symbols.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (m, 0)
    for end, w in enumerate(text, 1):
        eq = symbols.get(w, 0)
        across = eq | minus
        down = (((eq & plus) + plus) ^ plus) | eq
        up, low = minus | (full & ~(down | plus)), plus & down
        score += bool(up & high) - bool(low & high)
        up, low = up << 1 & full, low << 1 & full
        plus, minus = low | (full & ~(across | up)), up & across
        if score < best[0]:
            best = (score, end)
    return best


def finder(items: list[tuple[int, str | None]]) -> Callable[[str | None], list[tuple[int, int, int, int]]]:
    """A function text -> (item, edits, first word, end word) of each item's best passage within its budget."""
    import ahocorasick

    split = [(k, w) for k, t in items if (w := words(t))]
    found: dict[str, list[tuple[int, int]]] = {}
    for at, (_, item) in enumerate(split):
        for offset, piece in pieces(item):
            found.setdefault(f" {' '.join(piece)} ", []).append((at, offset))
    automaton = ahocorasick.Automaton()
    for piece, where in found.items():
        automaton.add_word(piece, (len(piece), where))
    if found:
        automaton.make_automaton()

    def find(text: str | None) -> list[tuple[int, int, int, int]]:
        own = words(text) if found else []
        if not own:
            return []
        joined, starts, at = f" {' '.join(own)} ", {}, 0
        hits = list(automaton.iter(joined))
        if not hits:
            return []
        for i, w in enumerate(own):
            starts[at] = i
            at += len(w) + 1
        ranges: dict[int, set[int]] = {}
        for end, (size, where) in hits:
            begin = starts[end - size + 1]
            for item, offset in where:
                ranges.setdefault(item, set()).add(begin - offset)
        out = []
        for item, begins in ranges.items():
            key, pattern = split[item]
            budget = len(pattern) // WORDS_PER_EDIT
            best, upto, merged = None, None, []
            for begin in sorted(begins):
                if upto is not None and begin - budget <= upto:
                    merged[-1][1] = upto = begin + len(pattern) + budget
                else:
                    upto = begin + len(pattern) + budget
                    merged.append([max(0, begin - budget), upto])
            for a, b in merged:
                if best and not best[0]:
                    break
                window = own[a:b]
                edits, end = myers(pattern, window)
                if edits <= budget and (best is None or edits < best[0]):
                    _, back = myers(pattern[::-1], window[:end][::-1])
                    best = (edits, a + end - back, a + end)
            if best:
                out.append((key, *best))
        return sorted(out)

    return find


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[bool, Iterator[list[tuple[int, str | None]]]]:
    """Whether there are several blocks, and the items in blocks of a bounded size: by a hash of the item, so that repeated items share a block."""
    rows = benchmark.select(F.col(item_col).alias("k"), F.col(text_col).alias("t"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(1, -(-n // (BLOCK_ITEMS // 2)), -(-size // (BLOCK_BYTES // 2)))
    own = lambda block: rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == block).distinct().collect()
    return blocks > 1, (sorted(((r.k, r.t) for r in own(block)), key=repr) for block in range(blocks))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item_id, edits, first_word, end_word: each document's best passage for each item within the budget, of equally good ones the first.

    Places count words after pure punctuation is dropped. Other columns are ignored; texts of any length count whole;
    an empty table gives no rows.
    Null texts, and texts and items without words, match nothing; items of under five words match where they occur as
    they are. Repeated rows each give their rows; null ids
    stay null. A benchmark beyond a block's bound takes a pass over the documents for each block.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"_id {kind}, {item_col} {item_kind}, edits int, first_word int, end_word int"
    rows, spark, out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), docs.sparkSession, None

    def search(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find, names = finder(block.value), ["_id", item_col, "edits", "first_word", "end_word"]
            for batch in small_batches(batches, "_text"):
                got = [(k, *hit) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in find(text)]
                columns = list(zip(*got, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1]) if got else pa.array([], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:])], names)

        return run

    several, blocks = _blocks(benchmark, item_col, item_text)
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)
        part = rows.mapInArrow(search(sent), schema)
        if several:  # one block is held at a time
            part = materialize(part, "matches")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("_id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any match, in one pass for each block of the benchmark and with their columns as they are, whatever their names.

    Null texts and texts without words stay; repeated rows go or stay together.
    """
    def clean(block):
        def run(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
            find = finder(block.value)
            for batch in small_batches(batches, text):
                yield batch.filter(pa.array([not find(x) for x in batch.column(text).to_pylist()], pa.bool_()))

        return run

    out, last = docs, None
    several, blocks = _blocks(benchmark, item_col, item_text)
    for block in blocks:
        sent = docs.sparkSession.sparkContext.broadcast(block)
        out = filtered(out, text_col, clean(sent))
        if several:
            out = materialize(out, "clean")
            sent.destroy()
            if last is not None:
                discard(last)
            last = out
    return out
