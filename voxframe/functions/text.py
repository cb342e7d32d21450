"""Text quality functions (Column in, Column out)."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Thresholds, guard lengths and the placeholder of the text rules.
REPETITION_RATIO = 0.3
REPETITION_MIN_ITEMS = 4
NEAR_DUPLICATE_RATIO = 0.9
CLIP_MIN_TEXT_LEN = 100
CLIP_MIN_PERIOD = 2
CLIP_MIN_REPEATS = 10
CLIP_MAX_PERIOD = 30
CLIP_PLACEHOLDER = "(indistinguishable speech)"
# Characters searched together in one array.
CLIP_GROUP_CHARS = 4_000_000

# Every character Unicode counts as white space (Spark's trim and Java's \s know fewer).
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = "[" + WHITESPACE_CHARS + "]"

# Ideograph ranges counted for repetition, and the wider set that loses inner spaces.
IDEOGRAPH_CLASS = "[\u4e00-\u9fff\u3400-\u4dbf]"
CJK_WIDE_CLASS = "[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff\u3000-\u303f\uff00-\uffef]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def _few_distinct(items: Column) -> Column:
    return bind(
        items,
        lambda a: (F.size(a) >= REPETITION_MIN_ITEMS)
        & (F.size(F.array_distinct(a)) / F.size(a) < REPETITION_RATIO),
    )


def is_repetitive_words(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), WHITESPACE_CLASS + "+"), lambda w: w != "")
    return F.coalesce(_few_distinct(words), F.lit(False))


def is_repetitive_cjk(text: Column) -> Column:
    chars = F.regexp_extract_all(text, F.lit(f"({IDEOGRAPH_CLASS})"), 1)
    return F.coalesce(
        F.when(text.rlike(IDEOGRAPH_CLASS), _few_distinct(chars)), F.lit(False)
    )


def is_repetitive(text: Column) -> Column:
    return is_repetitive_words(text) | is_repetitive_cjk(text)


def shares_trigrams(a: str, b: str, threshold: float) -> bool:
    """Whether two texts share as many runs of three characters as the ratio takes.

    With m characters in matching blocks, len(a) + len(b) - 2m are in none, and each border between blocks has one of those. So there are at
    most that many blocks and one more, and each has two runs less than characters.
    """
    both = len(a) + len(b)
    least = 5 * threshold * both / 2 - 2 * both - 2
    if least <= 0:
        return True
    ours = Counter(map("".join, zip(a, a[1:], a[2:], strict=False)))
    theirs = Counter(map("".join, zip(b, b[1:], b[2:], strict=False)))
    return sum(min(n, theirs[t]) for t, n in ours.items() if t in theirs) >= least - 1e-6


def reaches_ratio(a: str, b: str, threshold: float) -> bool:
    return shares_trigrams(a, b, threshold) and SequenceMatcher(None, a, b).ratio() >= threshold


def similar_texts(threshold: float) -> Callable[[str | None, str | None], bool]:
    """The whole near-duplicate test on two Python strings."""

    def test(current, prior):
        a, b = (current or "").strip().lower(), (prior or "").strip().lower()
        if not (a and b):
            return False
        # quick_ratio is an upper bound of ratio, so it never loses a match.
        return a == b or (SequenceMatcher(None, a, b).quick_ratio() >= threshold and reaches_ratio(a, b, threshold))

    return test


def _similar(threshold: float):
    @F.pandas_udf(T.BooleanType())
    def similar(current: pd.Series, prior: pd.Series) -> pd.Series:
        return pd.Series([
            a is not None and b is not None and reaches_ratio(a, b, threshold) for a, b in zip(current, prior)
        ], dtype="bool")

    return similar


def folded(text: Column) -> Column:
    """The form in which two texts are compared."""
    return F.lower(strip(text))


def shared_characters(a: Column, b: Column) -> Column:
    """Size of the multiset of characters that two texts share: no common blocks can have more."""

    def count(text: Column, c: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, c, F.lit("")))

    letters = F.array_distinct(F.filter(F.split(a, ""), lambda c: c != ""))
    return F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)))


def _tests(a: Column, b: Column, threshold: float) -> tuple[Column, Column]:
    """For folded texts: whether they are equal, and whether their lengths, then their characters, allow the ratio."""
    la, lb = F.length(a), F.length(b)
    filled = (la > 0) & (lb > 0)
    equal = F.coalesce(filled & (a == b), F.lit(False))
    near = filled & (2.0 * F.least(la, lb) / (la + lb) >= threshold) & (a != b)
    possible = F.when(near, 2.0 * shared_characters(a, b) / (la + lb) >= threshold)
    return equal, F.coalesce(possible, F.lit(False))


def may_be_near_duplicate(a: Column, b: Column, threshold: float = NEAR_DUPLICATE_RATIO) -> Column:
    """Cheap necessary test on folded texts: a filter on it keeps most rows from Python altogether."""
    equal, possible = _tests(a, b, threshold)
    return equal if threshold >= 1.0 else equal | possible


def is_near_duplicate_folded(a: Column, b: Column, threshold: float = NEAR_DUPLICATE_RATIO) -> Column:
    equal, possible = _tests(a, b, threshold)
    if threshold >= 1.0:
        return equal
    return equal | _similar(threshold)(F.when(possible, a), F.when(possible, b))


def with_near_duplicate(df: DataFrame, a: str, b: str, threshold: float, name: str) -> DataFrame:
    """Add ``name``: whether two columns of folded texts are near duplicates. The bounds are tested once for both arguments."""
    equal, possible = _tests(F.col(a), F.col(b), threshold)
    if threshold >= 1.0:
        return df.withColumn(name, equal)
    tested = df.withColumns({"_equal": equal, "_possible": possible})
    similar = _similar(threshold)(F.when(F.col("_possible"), F.col(a)), F.when(F.col("_possible"), F.col(b)))
    return tested.withColumn(name, F.col("_equal") | similar).drop("_equal", "_possible")


def is_near_duplicate(
    current: Column, prior: Column, threshold: float = NEAR_DUPLICATE_RATIO
) -> Column:
    """Same text after strip and lower-casing, or a matching-block ratio of at least ``threshold``.

    Equality and the bounds by length and by shared characters run in the JVM; only pairs that can still reach the
    threshold travel to Python (the others go as nulls). With ``threshold=1.0`` the
    ratio equals plain equality and no Python stage is planned.
    """
    return is_near_duplicate_folded(folded(current), folded(prior), threshold)


def conditioning_context(
    current: Column, prior_line: Column, threshold: float = NEAR_DUPLICATE_RATIO
) -> Column:
    """Stripped text, or "" where feeding it back as a prompt would be unsafe."""
    text = strip(F.coalesce(current, F.lit("")))
    unsafe = (
        (text == "") | is_repetitive(text) | is_near_duplicate(text, prior_line, threshold)
    )
    return F.when(unsafe, F.lit("")).otherwise(text)


def periodic_runs(
    texts: list[str], min_repeats: int, max_period: int
) -> dict[int, tuple[int, int, int]]:
    """Per text number: (period, start, end) of its first run of ``min_repeats`` adjacent copies.

    All texts lie in one array, parted by codes no character has. A run of period p means
    p * (min_repeats - 1) adjacent positions that equal the one p before. Any such stretch
    holds exactly one position of a grid of that width, so only grid positions are tested,
    then their neighbours; a text is searched for breaks only where both match.
    """
    if not texts:
        return {}
    data = b"".join(t.encode("utf-32-le") + struct.pack("<I", 0x110000 + i) for i, t in enumerate(texts))
    chars = np.frombuffer(data, dtype="<u4")
    ends = np.flatnonzero(chars >= 0x110000)
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(chars)
    found: dict[int, tuple[int, int, int]] = {}
    for p in range(CLIP_MIN_PERIOD, max_period + 1):
        width = p * (min_repeats - 1)
        grid = np.arange(p + width - 1, n, width)
        grid = grid[chars[grid] == chars[grid - p]]
        # A stretch of this width reaches at least half of it to one side of its grid position.
        sides = []
        for step in (-1, 1):
            side = np.ones(len(grid), dtype=bool)
            for k in range(1, min(4, (width - 1) // 2) + 1):
                at = np.clip(grid + step * k, p, n - 1)
                side &= chars[at] == chars[at - p]
            sides.append(side)
        for i in np.unique(np.searchsorted(ends, grid[sides[0] | sides[1]])).tolist():
            if i in found:
                continue
            own = chars[starts[i]:ends[i]]
            if len(own) <= p:
                continue
            breaks = np.concatenate(([p - 1], np.flatnonzero(own[p:] != own[:-p]) + p, [len(own)]))
            long_runs = np.flatnonzero(np.diff(breaks) > width)
            if len(long_runs):
                first = long_runs[0]
                found[i] = (p, int(breaks[first]) + 1 - p, int(breaks[first + 1]))
    return found


def _groups(texts, limit: int = CLIP_GROUP_CHARS):
    """Texts with their row numbers, a bounded number of characters at a time."""
    rows, chosen, size = [], [], 0
    for row, t in enumerate(texts):
        if t is not None:
            rows.append(row)
            chosen.append(t)
            size += len(t)
            if size >= limit:
                yield rows, chosen
                rows, chosen, size = [], [], 0
    yield rows, chosen


def clip_texts(texts) -> dict[int, tuple[str, str]]:
    """Row -> (clipped text, pattern) of the texts of a batch that have a run to cut, by the default clipping."""
    out = {}
    for rows, chosen in _groups([t if t is not None and len(t) >= CLIP_MIN_TEXT_LEN else None for t in texts]):
        for i, (period, start, end) in periodic_runs(chosen, CLIP_MIN_REPEATS, CLIP_MAX_PERIOD).items():
            t = chosen[i]
            out[rows[i]] = t[: start + period] + CLIP_PLACEHOLDER + t[end:], t[start : start + period]
    return out


def clip_text(text: str | None) -> tuple[str | None, list[str]]:
    """The default clipping of one Python string."""
    long_enough = [text] if text is not None and len(text) >= CLIP_MIN_TEXT_LEN else []
    run = periodic_runs(long_enough, CLIP_MIN_REPEATS, CLIP_MAX_PERIOD).get(0)
    if run is None:
        return text, []
    period, start, end = run
    return text[:start + period] + CLIP_PLACEHOLDER + text[end:], [text[start:start + period]]


def clip_repetitions(
    text: Column,
    min_repeats: int = CLIP_MIN_REPEATS,
    max_pattern_len: int = CLIP_MAX_PERIOD,
) -> Column:
    """Struct ``(text, patterns)``: the first periodic run cut down to one copy.

    The smallest period with a run wins, then the leftmost run, taken to its true end.
    Only texts of at least ``CLIP_MIN_TEXT_LEN`` characters travel to Python, and only three
    numbers come back. A back-reference expression could find the same runs in the JVM; its gate
    alone took 11 times as long in one task and 4 times as long spread over eight.
    """
    if min_repeats < 2:
        raise ValueError(f"min_repeats must be at least 2, got {min_repeats}")

    @F.pandas_udf("period int, start int, end int")
    def find(texts: pd.Series) -> pd.DataFrame:
        out = np.full((len(texts), 3), -1, dtype=np.int32)
        for rows, chosen in _groups(texts):
            for i, run in periodic_runs(chosen, min_repeats, max_pattern_len).items():
                out[rows[i]] = run
        return pd.DataFrame(out, columns=["period", "start", "end"])

    def build(run: Column) -> Column:
        period, start, end = run["period"], run["start"], run["end"]
        return F.when(period < 0, F.struct(
            text.alias("text"), F.array().cast("array<string>").alias("patterns")
        )).otherwise(F.struct(
            F.concat(
                F.substring(text, F.lit(1), start + period), F.lit(CLIP_PLACEHOLDER),
                F.substring(text, end + 1, F.length(text)),
            ).alias("text"),
            F.array(F.substring(text, start + 1, period)).alias("patterns"),
        ))

    return bind(find(F.when(F.length(text) >= CLIP_MIN_TEXT_LEN, text)), build)


def clip_patterns(text: Column, **options) -> Column:
    return clip_repetitions(text, **options)["patterns"]


def convert_script(text: Column, source: str, target: str, mode: str = "none") -> Column:
    """Character conversion by a caller-supplied mapping; ``mode='none'`` passes text through."""
    if mode not in ("none", "simplified", "traditional"):
        raise ValueError(f"unknown script mode: {mode}")
    if mode == "none":
        return text
    if len(source) != len(target):
        raise ValueError("the two sides of a script mapping must have the same length")
    return F.translate(text, source, target)


def wants_cjk_strip(language: Column) -> Column:
    # The languages whose spaces between ideographs are removed.
    return F.coalesce(language.isin("zh", "ja", "ko"), F.lit(False))


def strip_cjk_spaces(text: Column, language: Column | None = None) -> Column:
    """Without white space between wide characters; with ``language``, in the languages that want it only."""
    stripped = F.regexp_replace(
        text, f"(?<={CJK_WIDE_CLASS}){WHITESPACE_CLASS}+(?={CJK_WIDE_CLASS})", ""
    )
    return stripped if language is None else F.when(wants_cjk_strip(language), stripped).otherwise(text)
