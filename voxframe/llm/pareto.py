"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document of a source whose target is r times its size is
wanted r times: floor(r) whole copies are certain. The words that are still missing then are drawn with unequal
probabilities, in proportion to size: a document of s words is included with min(1, c s), where c is the number at which
the words so included are the missing ones; large documents, for which that is 1, are certain. Pareto order sampling (Rosen 1997) draws a sample
of that size: with u uniform per document and p its inclusion probability, documents are
ranked by (u / (1 - u)) / (p / (1 - p)) and taken in that order until the words still missing are
reached. u comes from a digest of the row, so a rerun draws the same sample; equal rows are numbered and drawn one by one.

No source is sorted as a whole. Ranks lie in [0, 1); word sums per bin of 1/4096, then of the
one bin in which a source reaches its words, say where to cut, and only the rows of one bin of
1/16,777,216 are put in order. All rows below the cut are taken by a comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import WORD, written

BINS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of seed and parts: 52 bits, the same in every run."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, source_size, target) from one row per source with its ``source_size``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times
    all sizes. A target stops at ``most`` times its source's size; what is over is shared again by
    weight among the others until none is above. That end is reached directly: with sources in
    order of cap / weight, the first k are at their caps and the others get one rate per weight.
    """
    w = Window.orderBy(F.col("source").isNull(), "source")
    full = sizes.withColumn("_w", F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int")
    )).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rate = full.withColumn("_rate", (
        F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ) / F.sum("_w").over(onward)).withColumn("_at", F.row_number().over(order))
    free = rate.withColumn("_free", F.min(
        F.when(F.col("_cap") > F.col("_rate") * F.col("_w"), F.struct("_at", "_rate"))).over(every))
    return free.select(
        "source", "source_size",
        F.when(F.col("_free").isNull() | (F.col("_at") < F.col("_free._at")), F.col("_cap"))
        .otherwise(F.col("_free._rate") * F.col("_w")).alias("target"),
    )


def _cut(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source the last (rank, key) that is taken, or null; ``wanted`` has the words missing."""
    fine = F.floor(F.col("_rank") * BINS)
    finer = F.floor((F.col("_rank") * BINS - fine) * BINS)
    same = lambda a, b: a["_s"] == b["_s"]

    def crossing(sums: DataFrame, limit: DataFrame) -> DataFrame:
        """The bin in which the running sum of a source passes its limit, and the limit left at its start."""
        run = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        return (
            sums.join(limit, "_s").withColumn("_cum", F.sum("_words").over(run))
            .filter((F.col("_cum") > F.col("_left")) & (F.col("_cum") - F.col("_words") <= F.col("_left")))
            .select("_s", "_bin", (F.col("_left") - (F.col("_cum") - F.col("_words"))).alias("_left"))
        )

    rows = sized.filter("_p > 0").select("_s", "_rank", "_key", "size", fine.alias("_b1"), finer.alias("_b2"))
    first = crossing(rows.groupBy("_s", F.col("_b1").alias("_bin")).agg(F.sum("size").alias("_words")), wanted)
    first = written(first.withColumnRenamed("_bin", "_f1"), "pareto-bins")
    inside = rows.join(first, (rows["_s"] == first["_s"]) & (rows["_b1"] == first["_f1"])).select(
        rows["_s"], "_rank", "_key", "size", "_b2", "_left")
    second = crossing(
        inside.groupBy("_s", F.col("_b2").alias("_bin")).agg(F.sum("size").alias("_words")),
        first.select("_s", "_left"),
    )
    second = written(second.withColumnRenamed("_bin", "_f2"), "pareto-finer")
    last = inside.drop("_left").join(second.withColumnRenamed("_s", "_t"), (F.col("_s") == F.col("_t")) & (F.col("_b2") == F.col("_f2")))
    run = Window.partitionBy("_s").orderBy("_rank", "_key").rangeBetween(Window.unboundedPreceding, 0)
    ordered = last.groupBy("_s", "_rank", "_key").agg(F.sum("size").alias("_words"), F.first("_left").alias("_left"))
    nearest = (
        ordered.withColumn("_cum", F.sum("_words").over(run))
        # The row that crosses is taken if that comes nearer than leaving it out.
        .filter(F.col("_cum") - F.col("_left") < F.col("_left") - (F.col("_cum") - F.col("_words")))
        .groupBy("_s").agg(F.max(F.struct("_rank", "_key")).alias("_in"))
    )
    whole = second.select("_s").join(nearest, "_s", "left")
    edge = first.select("_s", "_f1").join(second.select("_s", "_f2"), "_s").join(whole, "_s")
    return edge.select("_s", "_f1", "_f2", "_in")


def inclusion(sizes: DataFrame) -> DataFrame:
    """(_s, _certain, _c) from (_s, size, _n, _left): documents of ``size`` words, ``_n`` of them, and the words missing in their source.

    Documents of ``_certain`` words or more are included, one of s fewer words with probability _c * s. From the largest size down, a size
    is certain as long as its share of what is left would be 1 or more. Sums are exact.
    """
    down = Window.partitionBy("_s").orderBy(F.desc("size"))
    larger = down.rowsBetween(Window.unboundedPreceding, -1)
    exact = "decimal(38,0)"
    words, squares = F.col("size").cast(exact) * F.col("_n"), F.col("size").cast(exact) * F.col("size") * F.col("_n")
    sums = (
        sizes.filter((F.col("size") > 0) & (F.col("_left") > 0))
        .withColumns({"_words": words.cast(exact), "_squares": squares.cast(exact)})
        .withColumns({
            "_before": (F.col("_left") - F.coalesce(F.sum("_words").over(larger).cast("double"), F.lit(0.0))),
            "_rest": (F.sum("_squares").over(Window.partitionBy("_s")).cast(exact)
                      - F.coalesce(F.sum("_squares").over(larger), F.lit(0)).cast(exact)).cast("double"),
        })
        .withColumn("_full", F.min(F.col("_before") * F.col("size") >= F.col("_rest")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return sums.groupBy("_s").agg(
        F.min(F.when(F.col("_full"), F.col("size"))).alias("_certain"),
        F.max_by(F.col("_before") / F.col("_rest"), F.when(~F.col("_full"), F.col("size"))).alias("_c"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: str = "mix"
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (copies * size).

    ``size`` is the number of words (null text: 0). Null is a source of its own. A document gets at most
    ceil(``most``) copies. Documents without words are never drawn beyond their certain copies' zero words. Rows equal in
    source, doc_id and text are drawn one by one; an empty table gives an empty one.
    Columns named like a result are replaced, all others are kept, whatever their names.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    sized = docs.select(
        # The caller's columns travel in one struct, so none of them can clash with the names used here.
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in own]).alias("row"), n_words(F.col("text")).alias("size"),
        # Null and each name as keys that plain joins can compare.
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("_s"),
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))).alias("_key"),
    )
    # Equal rows are one row with a count.
    narrow = written(sized.groupBy("_s", "_key").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("_n")), "mix-sizes")
    by_size = written(narrow.groupBy("_s", "size").agg(F.sum("_n").alias("_n")), "mix-by-size")
    totals = by_size.groupBy("_s").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")).select(
        F.when(F.col("_s") != "n", F.substring("_s", 2, 1 << 30)).alias("source"), "source_size")
    per = source_targets(totals, weights, share, most).withColumns({
        "_s": F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))),
        "_ratio": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0),
    }).withColumns({
        "_sure": F.floor("_ratio"), "_left": F.col("target") - F.floor("_ratio") * F.col("source_size"),
    }).drop("source", "_ratio")
    per = written(per, "mix-wanted")
    # One row per source from here on.
    per = written(per.join(inclusion(by_size.join(per.select("_s", "_left"), "_s")), "_s", "left"), "mix-targets")
    numbered = narrow.select("_s", "_key", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_copy"))
    cut = written(_cut(_ranked(numbered.join(per, "_s"), seed), per.select("_s", "_left")), "mix-cuts")
    taken = _ranked(_numbered(sized, narrow).join(per, "_s"), seed).join(cut.withColumnRenamed("_s", "_t"), F.col("_s") == F.col("_t"), "left")
    b1 = F.floor(F.col("_rank") * BINS)
    b2 = F.floor((F.col("_rank") * BINS - b1) * BINS)
    drawn = F.when(F.col("_p") <= 0, False).when(F.col("_t").isNull(), F.col("_left") > 0).otherwise(
        (b1 < F.col("_f1")) | ((b1 == F.col("_f1")) & ((b2 < F.col("_f2")) | (
            (b2 == F.col("_f2")) & F.coalesce(F.struct("_rank", "_key") <= F.col("_in"), F.lit(False)))))
    )
    copies = (F.col("_sure") + drawn.cast("long")).cast("long")
    return taken.select(
        *[F.col(f"row.`{c}`").alias(c) for c in own], "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"))


def _numbered(sized: DataFrame, narrow: DataFrame) -> DataFrame:
    """Rows with _copy: 0, 1, ... within those of one source and key.

    Only rows that have an equal one are written, and numbered by the partition they lie in: no group of equal rows is put together.
    """
    repeats = narrow.filter("_n > 1").select("_s", "_key")
    if repeats.isEmpty():
        return sized.withColumn("_copy", F.lit(0).cast("long"))
    key = ["_s", "_key"]
    alike = written(sized.join(repeats, key, "left_semi").withColumns(
        {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "mix-repeats")
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = alike.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_m")).select(
        *key, "_part", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*key, "_part").orderBy("_at")
    counted = alike.withColumn("_own", F.row_number().over(within) - 1).join(offsets, [*key, "_part"]).select(
        *sized.columns, (F.col("_offset") + F.col("_own")).alias("_copy"))
    return sized.join(repeats, key, "left_anti").withColumn("_copy", F.lit(0).cast("long")).select(*sized.columns, "_copy").unionByName(counted)


def _ranked(df: DataFrame, seed: str) -> DataFrame:
    """The inclusion probability, and the Pareto rank as a number in [0, 1): q / (1 + q) of the odds ratio q, which keeps the order."""
    size, u, p = F.col("size"), F.col("_u"), F.col("_p")
    wanted = F.when((size <= 0) | (F.col("_left") <= 0), 0.0).when(size >= F.col("_certain"), 1.0).otherwise(F.col("_c") * size)
    return (
        df.withColumns({"_u": uniform(seed, F.col("_key"), F.col("_copy")), "_p": F.coalesce(wanted, F.lit(0.0))})
        .withColumn("_rank", F.when(p > 0, u * (1 - p) / (u * (1 - p) + (1 - u) * p)).otherwise(0.0))
        .withColumn("_key", F.concat("_key", F.lpad(F.col("_copy").cast("string"), 12, "0"))))
