"""The functions under SQL names, for ``spark.sql`` users.

They are SQL functions, which the planner inlines as native expressions. Two need Python behind a native gate: only pairs that can reach the
ratio, and lines that are long enough, travel to it, in batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.functions import text
from voxframe.functions.signal import SPEECH_THRESHOLD, TARGET_RATE, WINDOW_AT_TARGET, WINDOW_ELSEWHERE


def _escaped(chars: str) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in chars)


_WS = f"'{_escaped(text.WHITESPACE_CHARS)}'"
_WS_CLASS = f"'[{_escaped(text.WHITESPACE_CHARS)}]+'"
_IDEOGRAPH = "'[\\u4e00-\\u9fff\\u3400-\\u4dbf]'"


def _few(items: str) -> str:
    return (f"coalesce(size({items}) >= {text.REPETITION_MIN_ITEMS} AND "
            f"size(array_distinct({items})) / size({items}) < {text.REPETITION_RATIO}, false)")


_MS = "cast(rint(seconds * 1000) AS bigint)"
_WORDS = f"filter(split(lower(line), {_WS_CLASS}), w -> w <> '')"
_CHARS = f"regexp_extract_all(line, {_IDEOGRAPH}, 0)"

FUNCTIONS = {
    "vf_strip(line STRING) RETURNS STRING": f"btrim(line, {_WS})",
    "vf_is_repetitive_words(line STRING) RETURNS BOOLEAN": _few(_WORDS),
    "vf_is_repetitive_cjk(line STRING) RETURNS BOOLEAN": _few(_CHARS),
    "vf_is_repetitive(line STRING) RETURNS BOOLEAN": f"{_few(_WORDS)} OR {_few(_CHARS)}",
    "vf_same_text(a STRING, b STRING) RETURNS BOOLEAN":
        f"coalesce(btrim(a, {_WS}) <> '' AND lower(btrim(a, {_WS})) = lower(btrim(b, {_WS})), false)",
    "vf_to_ms(seconds DOUBLE) RETURNS BIGINT": _MS,
    "vf_fmt_ts(seconds DOUBLE) RETURNS STRING":
        f"format_string('%02d:%02d:%02d.%03d', {_MS} div 3600000, {_MS} % 3600000 div 60000, "
        f"{_MS} % 60000 div 1000, {_MS} % 1000)",
    "vf_fmt_ts_seconds(seconds DOUBLE) RETURNS STRING":
        "format_string('%02d:%02d:%02d', cast(rint(seconds) AS bigint) div 3600, "
        "cast(rint(seconds) AS bigint) % 3600 div 60, cast(rint(seconds) AS bigint) % 60)",
    "vf_fmt_ts_trunc(seconds DOUBLE) RETURNS STRING":
        "CASE WHEN seconds < 0 THEN raise_error('vf_fmt_ts_trunc needs non-negative seconds') "
        "ELSE format_string('%02d:%02d:%02d.%03d', floor(seconds / 3600), floor(seconds % 3600 / 60), "
        "floor(seconds % 60), cast(seconds % 1 * 1000 AS bigint)) END",
    "vf_window_size(rate INT) RETURNS INT":
        f"CASE WHEN rate = {TARGET_RATE} THEN {WINDOW_AT_TARGET} ELSE {WINDOW_ELSEWHERE} END",
    "vf_flag_speech(prob DOUBLE) RETURNS BOOLEAN": f"prob > {SPEECH_THRESHOLD}D",
    "vf_rms(samples ARRAY<FLOAT>) RETURNS DOUBLE":
        "sqrt(aggregate(samples, 0D, (a, x) -> a + cast(x AS double) * cast(x AS double)) / size(samples))",
    "vf_quantize_pcm16(samples ARRAY<FLOAT>) RETURNS ARRAY<SMALLINT>":
        "transform(samples, x -> cast(greatest(-1F, least(1F, x)) * 32767F AS smallint))",
}

_A, _B = f"lower(btrim(a, {_WS}))", f"lower(btrim(b, {_WS}))"
_SHARED = (f"aggregate(array_distinct(filter(split({_A}, ''), c -> c <> '')), 0, (n, c) -> n + least(length({_A}) - length(replace({_A}, c, '')), "
           f"length({_B}) - length(replace({_B}, c, ''))))")
# Equal texts need no ratio, and others only where lengths and shared characters allow it.
_POSSIBLE = (f"CASE WHEN length({_A}) > 0 AND length({_B}) > 0 AND {_A} <> {_B} "
             f"AND 2.0D * least(length({_A}), length({_B})) / (length({_A}) + length({_B})) >= {text.NEAR_DUPLICATE_RATIO}D "
             f"THEN 2.0D * {_SHARED} / (length({_A}) + length({_B})) >= {text.NEAR_DUPLICATE_RATIO}D ELSE false END")
GATED = {
    "vf_is_near_duplicate(a STRING, b STRING) RETURNS BOOLEAN":
        f"coalesce({_A} <> '' AND {_A} = {_B}, false) OR vf_reaches_ratio(IF({_POSSIBLE}, {_A}, NULL), IF({_POSSIBLE}, {_B}, NULL))",
    "vf_clip_repetitions(line STRING) RETURNS STRUCT<text: STRING, patterns: ARRAY<STRING>>":
        f"IF(length(line) >= {text.CLIP_MIN_TEXT_LEN}, vf_clip_long(IF(length(line) >= {text.CLIP_MIN_TEXT_LEN}, line, NULL)), "
        "named_struct('text', line, 'patterns', cast(array() AS array<string>)))",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the session's temporary functions and return their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf(T.BooleanType())
    def reaches(a: pd.Series, b: pd.Series) -> pd.Series:
        ratio = text.NEAR_DUPLICATE_RATIO
        return pd.Series([x is not None and y is not None and text.reaches_ratio(x, y, ratio) for x, y in zip(a, b)], dtype="bool")

    @F.pandas_udf("text string, patterns array<string>")
    def clip(lines: pd.Series) -> pd.DataFrame:
        out = [(t, []) for t in lines]
        for i, (cut, pattern) in text.clip_texts(lines).items():
            out[i] = cut, [pattern]
        return pd.DataFrame(out, columns=["text", "patterns"])

    spark.udf.register("vf_reaches_ratio", reaches)
    spark.udf.register("vf_clip_long", clip)
    for head, body in GATED.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in (*FUNCTIONS, *GATED)]
