"""Closed day intervals: windows, splits and overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import overlaps
from ..functions.text import col

#: Runs of more days than this stand apart from single events.
LONG_RUN_DAYS = 7


def in_window(start, end, first, last) -> Column:
    """Whether [start, end] meets [first, last]."""
    return (col(start) <= col(last)) & (F.coalesce(col(end), col(start)) >= col(first))


def upcoming(df: DataFrame, start: str, end: str, today) -> DataFrame:
    """Rows that end on or after today."""
    return df.filter(F.coalesce(F.col(end), F.col(start)) >= col(today))


def short_and_long(df: DataFrame, start: str, end: str, days: int = LONG_RUN_DAYS) -> DataFrame:
    """``part``: main for runs of at most ``days``, else long; ``sort_day``: start of main, end of long ones."""
    last = F.coalesce(F.col(end), F.col(start))
    long = F.datediff(last, F.col(start)) > days
    return df.withColumns({"part": F.when(long, "long").otherwise("main"), "sort_day": F.when(long, last).otherwise(F.col(start))})


def starting_and_ongoing(df: DataFrame, start: str, end: str, first, last) -> DataFrame:
    """Rows that meet a period, ``part``: starting in it or ongoing."""
    met = df.filter(in_window(start, end, first, last))
    return met.withColumn("part", F.when(F.col(start) >= col(first), "starting").otherwise("ongoing"))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str, slack: int = 0, bucket_days: int = 31) -> DataFrame:
    """Pairs of rows with equal keys whose intervals meet within ``slack`` days: columns a_* and b_* (J02's plan).

    Intervals are dealt to buckets of ``bucket_days``; each pair is kept in the
    first bucket they share, so no distinct is needed.
    """

    def bucketed(df: DataFrame, p: str, widen: int) -> DataFrame:
        named = df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
        day = lambda c, d: F.floor(F.unix_date(F.date_add(F.col(f"{p}_{c}"), d)) / bucket_days).cast("int")
        return named.withColumns({f"{p}_first": day(start, -widen), "bucket": F.explode(F.sequence(day(start, -widen), F.greatest(day(start, -widen), day(end, widen))))})

    left, right = bucketed(a, "a", slack), bucketed(b, "b", 0)
    on = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys] + [left["bucket"] == right["bucket"], left["bucket"] == F.greatest("a_first", "b_first")]
    met = left.join(right, on, "inner").filter(overlaps(f"a_{start}", f"a_{end}", f"b_{start}", f"b_{end}", slack))
    return met.drop("bucket", "a_first", "b_first")
