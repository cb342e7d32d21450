"""Periodic runs of words, found in tiles per octave of the period.

Periods are taken by octaves: the first holds 1 to D - 1, each next one D to 2 D - 1. For an octave that ends below D
a document has anchors every D words, and the tile of an anchor m is the words m - D to m + 2 D. A run that is long
enough repeats for at least D words at its distance p, so one of these words is an anchor: both sides of the anchor
are measured by Z-functions of the words after it and of the reversed words before it. What a tile finds is a piece
of a run; pieces of neighbouring tiles overlap by p words or more, so (document, period) groups of them are stitched
by their ends alone.

Tiles of which no anchor repeats are left out before they travel. Octaves cost one comparison per two words each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.common import written

#: Words that are compared in one go, and comparisons held at a time.
WORDS, PAIRS = 1 << 20, 1 << 20
#: A parcel holds the tiles of neighbouring anchors, about so many words or four octave ends.
PARCEL = 4096

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def first_octave(min_length: int) -> int:
    """The end of the first octave: any run of ``min_length`` words that holds its period three times, p < D, repeats over
    max(min_length - p, 2 p) words, and that is 2/3 of ``min_length`` at least."""
    d = 1
    while 2 * d <= 2 * min_length // 3:
        d *= 2
    return d


def octaves(n: int, first: int) -> Iterator[tuple[int, int]]:
    """(smallest period, end) of the octaves that a text of n words can hold three times."""
    low, end = 1, first
    while 3 * low <= n:
        yield low, end
        low, end = end, 2 * end


def repeating(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, position) of the anchors at which some period of the octave repeats for ``end`` words, or 16 if that is less."""
    counts = np.maximum((ends - starts - low + end - 1) // end, 0)
    text = np.repeat(np.arange(len(starts)), counts)
    at = starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * end
    periods, need, hits = np.arange(low, end), min(end, 16), []
    step = max(1, PAIRS // len(periods))
    for i in range(0, len(at), step):
        # Words behind a text's end are another text's; the rows of ``last`` below leave them out.
        far = at[i : i + step, None] + periods
        same = codes[np.minimum(far, len(codes) - 1)] == codes[at[i : i + step], None]
        a, b = np.nonzero(same & (far < ends[text[i : i + step], None]))
        m, p = at[i + a], periods[b]
        first, last = starts[text[i + a]], ends[text[i + a]]
        run = np.ones(len(m), np.int64)
        for side, limit in ((1, need), (-1, need)):
            live = np.flatnonzero(run < need)
            for j in range(1, limit):
                q = m[live] + side * j
                live = live[(q >= first[live]) & (q + p[live] < last[live])] if len(live) else live
                q = m[live] + side * j
                live = live[codes[q] == codes[q + p[live]]]
                if not len(live):
                    break
                run[live] += 1
        hits.append(np.unique(i + a[run >= need]))
    found = np.concatenate(hits) if hits else np.empty(0, np.int64)
    return text[found], at[found]


def z_function(x: list) -> list:
    """For each position the number of elements that agree with the beginning."""
    n = len(x)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


@lru_cache(maxsize=1 << 16)
def shorter(p: int) -> tuple[int, ...]:
    """p divided by each of its prime factors."""
    out, rest, r = [], p, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            out.append(p // r)
            while rest % r == 0:
                rest //= r
        r += 1
    return tuple(out)


def solve_tile(words: list, anchor: int, low: int, end: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the pieces around an anchor, positions within ``words``, which are the parcel's.

    A period that the anchor's own block divides is left out: then the whole run has the shorter one.
    """
    ahead = z_function(words[anchor : anchor + 2 * end])
    before = words[max(anchor - end, 0) : anchor][::-1]
    back = z_function([*before, -1, *words[max(anchor - end, 0) : anchor + end][::-1]])
    # In the reversed words, the one before anchor + p stands at (words from the anchor on) - p.
    reach = min(end, len(words) - anchor)
    out = []
    for p in range(low, min(end, len(ahead))):
        forward, backward = ahead[p], back[len(before) + 1 + reach - p]
        if forward + backward >= end and all(ahead[d] < p - d for d in shorter(p)):
            out.append((p, anchor - backward, anchor + p + forward))
    return out


def join_pieces(pieces: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Pieces of one period that overlap by the period or more become one."""
    open_: dict[int, tuple[int, int]] = {}
    for p, s, e in pieces:
        if p in open_ and s <= open_[p][1] - p:
            open_[p] = (open_[p][0], max(e, open_[p][1]))
            continue
        if p in open_:
            yield p, *open_[p]
        open_[p] = (s, e)
    for p, (s, e) in open_.items():
        yield p, s, e


SCREENED = ("key bigint, n_words bigint, collapsed string, open boolean, low int, end int, at bigint, anchors binary, codes binary")


def _screen(min_length: int, row_type: pa.DataType | None = None):
    first = first_octave(min_length)

    def parcels(key, codes, hits, low, end):
        """Rows of the tiles around the anchors ``hits`` of one text."""
        size = max(PARCEL, 4 * end)
        cut = np.flatnonzero(np.diff(hits) > 4 * end) + 1
        for group in np.split(hits, cut):
            for i in range(0, len(group), size // end):
                some = group[i : i + size // end]
                at = max(int(some[0]) - end, 0)
                yield (key, len(codes), low, end, at, (some - at).astype("<i4").tobytes(),
                       codes[at : int(some[-1]) + 2 * end].astype("<i4").tobytes())

    def batch_of(schema, columns, n):
        return pa.RecordBatch.from_arrays([
            columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            schema = pa.schema([
                batch.schema.field("row"), ("key", pa.int64()), ("n_words", pa.int64()), ("collapsed", pa.string()),
                ("open", pa.bool_()), ("low", pa.int32()), ("end", pa.int32()), ("at", pa.int64()),
                ("anchors", pa.binary()), ("codes", pa.binary())])
            texts, i = batch.column("text"), 0
            while i < len(texts):
                # Texts of about WORDS words, one text at least.
                ids: dict[bytes, int] = {}
                joined, codes, sizes, total, j = [], [], [], 0, i
                while j < len(texts) and total < WORDS:
                    words = (texts[j].as_py() or "").encode().split()
                    joined.append(b" ".join(words))
                    codes += [ids.setdefault(w, len(ids)) for w in words]
                    sizes.append(len(words))
                    total += len(words)
                    j += 1
                codes = np.array(codes, np.int32)
                ends = np.cumsum(np.array(sizes, np.int64))
                starts = ends - sizes
                tiles, is_open = [], np.zeros(j - i, bool)
                for low, end in octaves(max(sizes), first):
                    large = np.flatnonzero((ends - starts >= 3 * low) & (ends - starts >= min_length))
                    if not len(large):
                        continue
                    text, at = repeating(codes, starts[large], ends[large], low, end)
                    text = large[text]
                    for t in np.unique(text):
                        is_open[t] = True
                        tiles += parcels(number + int(t), codes[starts[t] : ends[t]], at[text == t] - starts[t], low, end)
                keys = number + np.arange(j - i)
                yield batch_of(schema, {
                    "row": batch.column("row").slice(i, j - i), "key": pa.array(keys), "n_words": pa.array(sizes, pa.int64()),
                    "collapsed": pa.array(joined, pa.binary()).cast(pa.string()), "open": pa.array(is_open)}, j - i)
                for k in range(0, len(tiles), 256):
                    some = tiles[k : k + 256]
                    yield batch_of(schema, {
                        name: pa.array([x[c] for x in some], schema.field(name).type)
                        for c, name in enumerate(("key", "n_words", "low", "end", "at", "anchors", "codes"))}, len(some))
                number += j - i
                i = j
    return run


def _solve(min_length: int, min_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for x in batch.to_pylist():
                words, at, n = np.frombuffer(x["codes"], "<i4").tolist(), x["at"], x["n_words"]
                pieces: list[tuple[int, int, int]] = []
                for m in np.frombuffer(x["anchors"], "<i4").tolist():
                    # Positions of the tile alone, so that each anchor costs the same.
                    lo = max(m - x["end"], 0)
                    pieces += [(p, s + lo, e + lo) for p, s, e in solve_tile(words[lo : m + 2 * x["end"]], m - lo, x["low"], x["end"])]
                for p, s, e in join_pieces(pieces):
                    # A piece that ends inside the parcel is a whole run; too short ones need not travel.
                    whole = (s > 0 or at == 0) and (e < len(words) or at + e == n)
                    if not whole or e - s >= max(min_length, min_exponent * p):
                        for column, value in zip(out, (x["key"], p, at + s, at + e), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["key", "period", "s", "e"])
    return run


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that a run covers after its first period go."""
    for batch in batches:
        texts = []
        for text, runs in zip(batch.column("collapsed"), batch.column("runs"), strict=True):
            runs = runs.as_py()
            if not runs:
                texts.append(text.as_py())
                continue
            words = text.as_py().encode().split()
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, [r["start"] + r["period"] for r in runs], 1)
            np.add.at(change, [r["start"] + r["length"] for r in runs], -1)
            keep = np.cumsum(change)[:-1] == 0
            texts.append(b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode())
        yield batch.set_column(batch.schema.get_field_index("collapsed"), "collapsed", pa.array(texts, pa.string()))


def find_runs(docs: DataFrame, text: str = "text", min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """``docs`` without ``text``, with n_words, runs (array of start, length, period by start, then period) and collapsed.

    A run is a stretch of words with smallest period q and length >= max(min_length, min_exponent * q) that no
    neighbouring word extends; ``collapsed`` has the words, joined by one space, that no run contains after its first q.
    Every row is returned, repeated rows and null or repeated ids as often as they come. A null, empty or blank text has
    no words, no runs and an empty ``collapsed``; an empty table gives an empty one. A text may be of any length: its
    tiles are rows of their own. Columns of ``docs`` named like a result are replaced, all others are kept as they are.
    """
    if min_exponent < 3 or min_length < 3:
        raise ValueError("runs hold their period three times and three words at least")
    kept = [c for c in docs.columns if c not in (text, "n_words", "runs", "collapsed")]
    packed = docs.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).cast("string").alias("text"))
    row = packed.schema["row"]
    schema = T.StructType([T.StructField("row", row.dataType, True), *T._parse_datatype_string(SCREENED).fields])
    # Written once: both the texts and the tiles hang on the row numbers that the screening gives.
    screened = written(packed.mapInArrow(_screen(min_length), schema), "periodic-screened")
    pieces = (
        screened.filter("codes is not null").select("key", "n_words", "low", "end", "at", "anchors", "codes")
        .repartition("key", "end", "at")
        .mapInArrow(_solve(min_length, min_exponent), "key bigint, period bigint, s bigint, e bigint")
    )
    group = Window.partitionBy("key", "period").orderBy("s")
    before = F.max("e").over(group.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        pieces.withColumn("new", F.when(F.col("s") <= before - F.col("period"), 0).otherwise(1))
        .withColumn("stretch", F.sum("new").over(group.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "period", "stretch").agg(F.min("s").alias("start"), (F.max("e") - F.min("s")).alias("length"))
        .filter(F.col("length") >= F.greatest(F.lit(min_length), min_exponent * F.col("period")))
        .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    )
    texts = screened.filter("open is not null").select("row", "key", "n_words", "collapsed", "open")
    none = F.lit(None).cast(RUNS)
    with_runs = texts.filter("open").join(runs, "key", "left").select("row", "n_words", "runs", "collapsed")
    changed = with_runs.mapInArrow(_collapse, with_runs.schema)
    final = texts.filter("not open").select("row", "n_words", none.alias("runs"), "collapsed").unionByName(changed)
    return final.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept], "n_words",
        F.coalesce("runs", F.array().cast(RUNS)).alias("runs"), "collapsed")
