"""Counts that runs report: funnels, integrity, coverage, period totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranks import numbered


def at_least(df: DataFrame, by: list, n: int) -> DataFrame:
    """Groups of n or more rows."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n)


def funnel(df: DataFrame, by: list, status: str, states: list[str]) -> DataFrame:
    """One column of counts per state."""
    return df.groupBy(*by).pivot(status, states).agg(F.count(F.lit(1))).na.fill(0, states)


def rank_integrity(df: DataFrame, by: list[str], rank: str, most: int) -> DataFrame:
    """Which ranks of 1..most each group lacks and which it has twice, as texts."""
    counts = df.groupBy(*by, rank).agg(F.count(F.lit(1)).alias("n"))
    g = counts.groupBy(*by).agg(F.collect_set(rank).alias("have"), F.array_sort(F.collect_set(F.when(F.col("n") > 1, F.col(rank)))).alias("twice"))
    missing = F.array_sort(F.array_except(F.sequence(F.lit(1), F.lit(most)), F.col("have")))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return g.select(*by, text(missing).alias("missing"), text(F.col("twice")).alias("twice"))


def expected_but_missing(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Expected work that isn't done."""
    return expected.join(done.select(*keys).distinct(), keys, "left_anti")


def two_periods(df: DataFrame, by: list, day: str, value: Column, end, days: int) -> DataFrame:
    """Totals of the last ``days`` up to ``end`` and of as many before."""
    at, first = F.col(day), F.date_sub(end, days - 1)
    now = F.sum(F.when(at.between(first, end), value))
    before = F.sum(F.when(at.between(F.date_sub(first, days), F.date_sub(first, 1)), value))
    return df.groupBy(*by).agg(F.coalesce(now, F.lit(0)).alias("now"), F.coalesce(before, F.lit(0)).alias("before"))


def due(df: DataFrame, checked: str, today, days: int) -> DataFrame:
    """Rows last checked ``days`` or more ago."""
    return df.filter(F.datediff(today, F.col(checked)) >= days)


def chunked(df: DataFrame, by: list[str], order: list, size: int = 100) -> DataFrame:
    """``chunk``: the number (from 0) of each row's batch of ``size`` (K14); a group may be of any size."""
    return numbered(df, order, by, "chunk").withColumn("chunk", F.floor(F.col("chunk") / size).cast("long"))


def shortest(df: DataFrame, by: list, value: str) -> DataFrame:
    """The shortest value of each group, ties by value."""
    return df.groupBy(*by).agg(F.min_by(value, F.struct(F.length(value), value)).alias(value))


def longest(df: DataFrame, by: list, value: str) -> DataFrame:
    """The longest value of each group, ties by value."""
    return df.groupBy(*by).agg(F.max(F.struct(F.length(value), F.col(value).alias("v"))).alias("m")).select(*by, F.col("m.v").alias(value))


def occurrences(df: DataFrame, by: list, instant: str) -> DataFrame:
    """One row per group and day: first time, and times in order as text."""
    day, time = F.to_date(instant).alias("day"), F.date_format(instant, "HH:mm")
    return df.groupBy(*by, day).agg(F.min(instant).alias("first"), F.array_join(F.array_sort(F.collect_list(time)), ",").alias("times"), F.count(F.lit(1)).alias("n"))


def decision(counts: DataFrame, tests: list[tuple[Column, str]], yes: str) -> DataFrame:
    """One row's totals with ``go`` and the ``reason`` of the first test that holds it back."""
    why = F
    for test, text in tests:
        why = why.when(test, text)
    return counts.withColumn("reason", why.otherwise(yes)).withColumn("go", F.col("reason") == yes)
