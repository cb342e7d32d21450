"""Media-time formatting and event identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ms(seconds: Column) -> Column:
    """Milliseconds, rounded half to even."""
    return F.rint(seconds * 1000).cast("long")


def to_ms_trunc(seconds: Column) -> Column:
    return (seconds * 1000).cast("long")


def fmt_ts(seconds: Column, decimals: bool = True) -> Column:
    """``HH:MM:SS.mmm`` (or ``HH:MM:SS``), rounded half to even; hours widen past 99."""
    if decimals:
        ms = to_ms(seconds)
        return F.format_string(
            "%02d:%02d:%02d.%03d",
            F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000),
            F.floor(ms % 60000 / 1000), ms % 1000,
        )
    s = F.rint(seconds).cast("long")
    return F.format_string(
        "%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    )


def fmt_ts_trunc(seconds: Column) -> Column:
    """``HH:MM:SS.mmm`` with every part truncated; negative input raises."""
    text = F.format_string(
        "%02d:%02d:%02d.%03d",
        F.floor(seconds / 3600), F.floor(seconds % 3600 / 60),
        F.floor(seconds % 60), (seconds % 1 * 1000).cast("long"),
    )
    bad = F.raise_error(
        F.concat(F.lit("fmt_ts_trunc needs non-negative seconds, got "), seconds.cast("string"))
    )
    return F.when(seconds < 0, bad.cast("string")).otherwise(text)


def event_id(epoch_ms: Column, *keys: Column) -> Column:
    """Time-ordered 128-bit identifier in the version 7 layout.

    48 bits of epoch milliseconds, then hash bits of the row's keys: the same row gets the
    same id when a task is run again.
    """
    time = F.lpad(F.lower(F.hex(epoch_ms)), 12, "0")
    low = F.lpad(F.lower(F.hex(F.xxhash64(F.lit(0), *keys))), 16, "0")
    high = F.lpad(F.lower(F.hex(F.xxhash64(F.lit(1), *keys))), 16, "0")
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(low, 1, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(time, 1, 8),
        F.substring(time, 9, 4),
        F.concat(F.lit("7"), F.substring(high, 1, 3)),
        F.concat(variant, F.substring(high, 4, 3)),
        F.substring(low, 5, 12),
    )
