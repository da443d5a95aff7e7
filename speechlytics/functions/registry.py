"""The text functions in SQL: temporary functions whose bodies are SQL themselves, so that they stay in the optimizer's sight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lexicon
from .numbers import _IDIOM
from .wer import MOST_WORDS

_TOKENS = r"filter(split(t, '(?U)[\\s\\x1c-\\x1f]+'), w -> w <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _table(values: dict[str, int]) -> str:
    return "map(" + ", ".join(f"{_quoted(k)}, {v}L" for k, v in values.items()) + ")"


_CLOSED = "concat(s.out, CASE WHEN s.total + s.cur = 0 THEN s.run ELSE array(CAST(s.total + s.cur AS STRING)) END)"
_STATE = lambda out, run, total, cur: f"named_struct('out', {out}, 'run', {run}, 'total', {total}, 'cur', {cur}, 'pos', s.pos + length(x.w) + CASE WHEN s.pos = 0 THEN 0 ELSE 1 END)"
_NONE = "CAST(array() AS ARRAY<STRING>)"
_NEAR = f"substring(t, greatest(0, s.pos - 10) + 1, s.pos + length(x.w) + 30 - greatest(0, s.pos - 10)) RLIKE {_quoted(_IDIOM)}"
_TOTAL = "CASE WHEN x.m IS NULL THEN s.total WHEN x.m > s.total THEN (s.total + CASE WHEN s.cur = 0 THEN 1L ELSE s.cur END) * x.m ELSE s.total + CASE WHEN s.cur = 0 THEN 1L ELSE s.cur END * x.m END"
_KNOWN = sorted(set(lexicon.LOANWORDS.split()) - set(lexicon.ABSORBED.split()))

FUNCTIONS = {
    "tokenize(t STRING) RETURNS ARRAY<STRING>": _TOKENS,
    "normalize_numbers(t STRING) RETURNS STRING": f"""
        aggregate(transform({_TOKENS}, w -> named_struct('w', w, 'v', {_table(lexicon.number_words())}[w], 'm', {_table(lexicon.MULTIPLIERS)}[w])),
            named_struct('out', {_NONE}, 'run', {_NONE}, 'total', 0L, 'cur', 0L, 'pos', 0),
            (s, x) -> CASE
                WHEN (x.v IS NOT NULL OR x.m IS NOT NULL) AND (size(s.run) > 0 OR NOT {_NEAR}) THEN {_STATE("s.out", "concat(s.run, array(x.w))", _TOTAL, "coalesce(x.v, 0L)")}
                WHEN size(s.run) > 0 THEN {_STATE(f"concat({_CLOSED}, array(x.w))", _NONE, "0L", "0L")}
                ELSE {_STATE("concat(s.out, array(x.w))", _NONE, "0L", "0L")} END,
            s -> array_join(CASE WHEN size(s.run) > 0 THEN {_CLOSED} ELSE s.out END, ' '))""",
    "tag_loanwords(t STRING) RETURNS STRING": f"""
        array_join(transform(transform({_TOKENS}, w -> named_struct('w', w, 'c', regexp_replace(w, {_quoted(r"""[।,!?.\-:;"'()]""")}, ''))),
            x -> CASE WHEN x.c RLIKE '^[a-zA-Z]{{2,}}$' OR x.c IN ({", ".join(map(_quoted, _KNOWN))}) THEN replace(x.w, x.c, concat('[EN]', x.c, '[/EN]')) ELSE x.w END), ' ')""",
    "post_process(t STRING) RETURNS STRING": "tag_loanwords(normalize_numbers(t))",
    "word_errors(ref STRING, hyp STRING) RETURNS INT": f"""
        get(transform(array(named_struct('r', tokenize(ref), 'h', tokenize(hyp))), p -> get(transform(array(array_distinct(concat(p.r, p.h))), seen -> levenshtein(
            decode(unhex(array_join(transform(p.r, w -> lpad(hex(array_position(seen, w) + CASE WHEN array_position(seen, w) <= {MOST_WORDS} THEN 19967 ELSE {65535 - MOST_WORDS} END), 8, '0')), '')), 'UTF-32'),
            decode(unhex(array_join(transform(p.h, w -> lpad(hex(array_position(seen, w) + CASE WHEN array_position(seen, w) <= {MOST_WORDS} THEN 19967 ELSE {65535 - MOST_WORDS} END), 8, '0')), '')), 'UTF-32'))), 0)), 0)""",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql``; their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]


def call(spark: SparkSession, name: str, *values: str) -> DataFrame:
    """One row with a function's result for texts given by hand."""
    if name not in register(spark):
        raise ValueError(f"no function {name}")
    return spark.sql(f"SELECT {name}({', '.join(f':v{k}' for k in range(len(values)))}) AS result", args={f"v{k}": v for k, v in enumerate(values)})
