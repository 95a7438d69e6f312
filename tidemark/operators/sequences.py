"""Sequences: streaks, deltas, quotas, fills and rotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def streaks(days: DataFrame, by: list[str], day: str) -> DataFrame:
    """Islands of consecutive days: by, first_day, last_day, days (N01). Days must be distinct per group."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(day))
    islands = days.withColumn("_island", F.date_sub(F.col(day), n))
    return islands.groupBy(*by, "_island").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("days")).drop("_island")


def streak_stats(days: DataFrame, by: list[str], day: str, today) -> DataFrame:
    """The longest streak, and the one that ends today or yesterday."""
    s = streaks(days, by, day)
    return s.groupBy(*by).agg(F.max("days").alias("longest"), F.coalesce(F.max(F.when(F.col("last_day") >= F.date_sub(today, 1), F.col("days"))), F.lit(0)).alias("current"))


def delta(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """``delta`` to the row before, 0 for the first."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.col(value)))


def neighbours(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """``previous`` and ``next`` value of the order column."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({"previous": F.lag(order).over(w), "next": F.lead(order).over(w)})


def quota(df: DataFrame, by: list, order: list, most: int) -> DataFrame:
    """At most so many rows of a class, the first in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def ranked_then_fill(df: DataFrame, by: list[str], chosen: Column, rank: list, fill: list, n: int) -> DataFrame:
    """Chosen rows by rank, then others by ``fill``, n in all per group; ``place`` from 1."""
    w = Window.partitionBy(*by).orderBy(F.when(chosen, 0).otherwise(1), *(F.when(chosen, c) for c in rank), *fill)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def accept_in_order(picks: DataFrame, by: list[str], order: list, special: Column, most: int, n: int) -> DataFrame:
    """Rows accepted in order with at most ``most`` special ones, n in all; ``place`` from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    running = F.sum(F.when(special, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = picks.withColumn("_special", running).filter(~special | (F.col("_special") <= most)).drop("_special")
    return kept.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def rotation(number: Column, count: int | Column, step: int = 1) -> Column:
    """Place (from 0) of a number in a list of ``count`` that is walked in steps."""
    return F.pmod((number - 1) * step, F.lit(count) if isinstance(count, int) else count)


def empty_runs(df: DataFrame, by: list[str], order: str, value: str, alert: int = 2) -> DataFrame:
    """``empty``: how many rows in a row, up to this one, have value 0; ``alert`` at so many."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    block = df.withColumn("_block", F.sum(F.when(F.col(value) != 0, 1).otherwise(0)).over(w))
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = block.withColumn("empty", F.sum(F.when(F.col(value) == 0, 1).otherwise(0)).over(inside))
    return out.withColumn("alert", F.col("empty") == alert).drop("_block")


def game_state(guesses: Column, answer: Column, most: int = 5) -> Column:
    """struct(status, misses, solved_at) after the guesses."""
    counted = F.slice(guesses, 1, most)
    at = F.coalesce(F.array_position(counted, answer), F.lit(0)).cast("int")
    misses = F.when(at > 0, at - 1).otherwise(F.size(counted))
    status = F.when(at > 0, "won").when(misses >= most, "lost").otherwise("playing")
    return F.struct(status.alias("status"), misses.alias("misses"), F.when(at > 0, at).alias("solved_at"))


def distinct_before(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """Distinct values of the last n groups."""
    last = df.select(group).distinct().orderBy(F.desc(group)).limit(n)
    return df.join(last, group, "left_semi").select(value).distinct()
