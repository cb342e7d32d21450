"""URL rules as a sort-merge range join.

A rule names a host (with all its subdomains) and the beginning of a path. Reversing the
labels of a host ("news.example.org" -> "org.example.news.") turns "host and subdomains" into "all keys that
begin with the rule's key": an interval in sorted order. Paths are compared at the lengths
that rule paths have: a URL becomes one key per such length, (path prefix, reversed host), and a
rule becomes one key of the same form. Rule and URL keys are sorted together, range-partitioned over
the cluster, and swept in order. Intervals of prefixes nest or are disjoint, so what is active
at a key is a stack; each rule row carries the stack as it stands when the rule opens, and the
sweep hands the last one on. Rules that have closed since are the ones the key does not begin with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import ascii_lower, written

RULE_SCHEMA = "verdict string, host string, path string"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; '' for none."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; '' for none."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """One row per (path, host) of a rule: its key and the rules open there, outermost first.

    The rules that enclose a rule have the same path and a host that is a tail of its labels, so
    a join of each rule's label prefixes with the rules finds them; ``explode`` makes as many rows
    as a host has labels.
    """
    keyed = (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .withColumn("host", ascii_lower(F.col("host")))
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block wins over allow
        .withColumn("rev", reversed_host(F.col("host")))
    )
    outer = keyed.select(
        F.col("path").alias("pfx"), F.col("rev").alias("_outer"),
        F.struct(F.length("rev").alias("n"), "rev", "host", "path", "verdict").alias("rule"),
    )
    labels = F.split(F.col("rev"), r"\.")
    return (
        keyed.select(F.col("path").alias("pfx"), "rev", F.explode(
            F.transform(F.sequence(F.lit(1), F.size(labels) - 1),
                        lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
        ).alias("_outer"))
        .join(outer, ["pfx", "_outer"])
        .groupBy("pfx", "rev").agg(F.array_sort(F.collect_list("rule")).alias("stack"))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), default: str = "allow"
) -> DataFrame:
    """``keep`` columns with host, path, rule and verdict of every row.

    ``rules`` has (verdict, host, path). The fitting rule with the most characters in host and path
    wins, then the one with the longer host; of equal rules with two verdicts, block. Without a fitting
    rule, ``rule`` is null and the verdict is ``default``. Null URLs and those without ``://`` have an empty
    host and path and fit no rule. Rules with a null part are ignored. Each row is judged on its own: repeated
    rows and null ids stay as they are.
    """
    stacks = _rule_stacks(rules)
    lengths = stacks.select(F.length("pfx").alias("n")).distinct().agg(F.collect_set("n").alias("_lengths"))
    urls = pages.select(
        F.monotonically_increasing_id().alias("_row"),
        F.struct(*[F.col(c) for c in keep]).alias("_keep"),
        url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"),
    )
    # A scalar: as many numbers as rule paths have different lengths (at most the longest path).
    keys = (
        urls.withColumn("_lengths", lengths.scalar())
        .select("*", F.explode_outer(F.filter("_lengths", lambda n: n <= F.length("path"))).alias("_n"))
        .select("_row", "_keep", "host", "path", F.expr("substring(path, 1, coalesce(_n, 0))").alias("pfx"),
                reversed_host(F.col("host")).alias("rev"))
    )
    none = F.lit(None)
    events = keys.select("*", none.cast(stacks.schema["stack"].dataType).alias("stack"), F.lit(1).alias("kind")).unionByName(
        stacks.select(
            none.cast("long").alias("_row"), none.cast(keys.schema["_keep"].dataType).alias("_keep"),
            none.cast("string").alias("host"), none.cast("string").alias("path"), "pfx", "rev", "stack",
            F.lit(0).alias("kind"),
        )
    )
    order = ["pfx", "rev", "kind"]
    # The row number in the sort key spreads a host with many pages over many partitions.
    placed = written(
        events.repartitionByRange(*order, "_row").withColumn("part", F.spark_partition_id()), "url-events"
    )
    # What is open at the end of each range, handed on from range to range: one row per range.
    ends = placed.filter("kind = 0").groupBy("part").agg(
        F.max_by("stack", F.struct("pfx", "rev")).alias("_end")
    )
    entering = (
        placed.select("part").distinct().join(ends, "part", "left")
        .select("part", F.last("_end", ignorenulls=True).over(
            Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("_in"))
    )
    sweep = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        placed.withColumn("_own", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
        .join(entering, "part", "left")
        .withColumn("_open", F.filter(
            F.coalesce("_own", "_in"), lambda r: (r["path"] == F.col("pfx")) & F.startswith(F.col("rev"), r["rev"])))
        .withColumn("_top", F.try_element_at("_open", F.lit(-1)))
    )
    top = F.col("_top")
    best = F.max(F.when(top.isNotNull(), F.struct(
        (F.length(top["host"]) + F.length(top["path"])).alias("n"), F.length(top["host"]).alias("h"),
        F.concat(top["host"], top["path"]).alias("rule"), top["verdict"].alias("verdict"),
    )))
    return (
        swept.groupBy("_row").agg(
            F.first("_keep").alias("_keep"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("_best"))
        .select(*[F.col("_keep")[c].alias(c) for c in keep], "host", "path", F.col("_best.rule").alias("rule"),
                F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
    )
