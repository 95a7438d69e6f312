"""Clusters of listings: first fit in rounds, sessions to runs, festivals to one row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranks import numbered
from ..plans.shipping import by_value
from ..plans.storage import materialize
from .graph import connected_components

by_value(__name__)

#: Rounds of settling heads before what is left, chains of rows that wait for each other, is settled component by component.
ROUNDS = 24


def first_fit(rows: DataFrame, edges: DataFrame, key: str, order: list[str], members: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """(key, cluster): each row, in order, joins the first cluster that holds a neighbour, or starts one.

    Without ``members`` only a cluster's first row draws others. The result is
    that of the pass in order, found in rounds of joins over all links at once;
    no task holds a component. Ties in order go by key; links to keys that are no
    rows, and of a row to itself, count for nothing.

    With ``members`` a row belongs to the least head that it reaches by going to
    earlier neighbours. Each round, a row's least known goal is replaced by the
    least of its neighbours' and by its goal's own, so that paths double. Without
    them, each round makes heads of the rows none of whose earlier neighbours is
    open, and settles those next to them. Chains of rows that wait for each
    other take a round a row, so after ``rounds`` rounds what is still open is
    settled in order, a component of open rows in a task.
    """
    ranked = numbered(rows.select(key, *(c for c in dict.fromkeys(order) if c != key)), [*order, key]).select(key, F.col("n").alias("_n"))
    ranked = materialize(ranked, "fit-ranks")
    near = edges.filter("a <> b").select("a", "b").join(ranked.select(F.col(key).alias("a"), F.col("_n").alias("x")), "a").join(ranked.select(F.col(key).alias("b"), F.col("_n").alias("y")), "b")
    down = materialize(near.select(F.greatest("x", "y").alias("v"), F.least("x", "y").alias("u")).distinct(), "fit-links")  # v has the earlier neighbour u
    found = _least_reached(down) if members else _first_heads(down, rounds)
    placed = ranked.join(found, ranked["_n"] == found["v"], "left").select(key, F.coalesce("head", "_n").alias("_h"))
    return placed.join(ranked.select(F.col(key).alias("cluster"), F.col("_n").alias("_h")), "_h").select(key, "cluster")


def _least_reached(down: DataFrame) -> DataFrame:
    """(v, head) of every row with an earlier neighbour."""
    state = materialize(down.groupBy("v").agg(F.min("u").alias("head")), "fit-goals")
    while True:
        goal = state.select(F.col("v").alias("u"), F.col("head").alias("_h"))
        by_links = down.join(goal, "u").groupBy("v").agg(F.min("_h").alias("_near"))  # an earlier neighbour that isn't here is a head, and known since the start
        jumped = state.join(goal, state["head"] == goal["u"], "left").select("v", "head", F.coalesce("_h", "head").alias("_far"))
        now = jumped.join(by_links, "v", "left").select("v", F.least("_far", F.coalesce("_near", "_far")).alias("head"), (F.least("_far", F.coalesce("_near", "_far")) < F.col("head")).alias("moved"))
        now = materialize(now, "fit-goals")
        state = now.select("v", "head")
        if now.filter("moved").isEmpty():
            return state


def _first_heads(down: DataFrame, rounds: int) -> DataFrame:
    """(v, head) of every row that isn't a head itself: the first head among its earlier neighbours."""
    open_, covered = down, []  # links between rows that aren't settled
    for _ in range(rounds):
        heads = open_.select(F.col("u").alias("h")).distinct().join(open_.select(F.col("v").alias("h")).distinct(), "h", "left_anti")
        gone = materialize(open_.join(heads, open_["u"] == heads["h"], "left_semi").select(F.col("v").alias("c")).distinct(), "fit-covered")
        if gone.isEmpty():
            break
        covered.append(gone)
        # A covered row is no head and waits for nothing; its links to later rows say nothing more.
        open_ = materialize(open_.join(gone, open_["v"] == gone["c"], "left_anti").join(gone, F.col("u") == F.col("c"), "left_anti"), "fit-open")
    else:
        if not open_.isEmpty():
            covered.append(materialize(_covered_in_order(open_), "fit-covered"))
    if not covered:
        return down.select("v", F.col("u").alias("head")).limit(0)
    everyone = covered[0]
    for more in covered[1:]:
        everyone = everyone.unionByName(more)
    first = down.join(everyone, down["v"] == everyone["c"], "left_semi")
    first = first.join(everyone, first["u"] == everyone["c"], "left_anti")
    return first.groupBy("v").agg(F.min("u").alias("head"))


def _covered_in_order(open_: DataFrame) -> DataFrame:
    """(c) of the rows next to a head, by a pass in order over each component of open rows."""
    roots = connected_components(open_.select(F.col("v").alias("a"), F.col("u").alias("b")))
    inside = open_.join(roots, open_["v"] == roots["node"]).select("root", "v", "u")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        covered: set[int] = set()
        for v, us in pdf.sort_values("v").groupby("v")["u"]:
            if any(u not in covered for u in us):
                covered.add(v)
        return pd.DataFrame({"c": sorted(covered)}, dtype="int64")

    return inside.groupBy("root").applyInPandas(settle, "c long")


def merge_by_priority(df: DataFrame, by: list[str], priority: list, values: list[str]) -> DataFrame:
    """One row per group: each value from the first row, by priority, that has one."""
    rank = F.struct(*priority)
    filled = [F.min_by(F.col(v), F.when(F.col(v).isNotNull(), rank)).alias(v) for v in values]
    return df.groupBy(*by).agg(*filled, F.count(F.lit(1)).alias("members"))


def collapse_sessions(df: DataFrame, by: list[str], start: str, end: str | None = None, most_days: int = 45) -> DataFrame:
    """One run per key: first day, last day, sessions in order, and whether it is a series rather than a run."""
    last = F.coalesce(F.col(end), F.col(start)) if end else F.col(start)
    runs = df.groupBy(*by).agg(F.min(start).alias("first_day"), F.max(last).alias("last_day"), F.array_sort(F.collect_set(start)).alias("sessions"), F.count(F.lit(1)).alias("rows"))
    return runs.withColumn("recurring", F.datediff("last_day", "first_day") > most_days)


def fold_prefixed(df: DataFrame, prefix, by: list[str], key: str, start: str, end: str, venue: str, least: int = 3) -> DataFrame:
    """Groups of ``least`` or more rows with one prefix become one row; the rest stay.

    (source key, name, first_day, last_day, venue, sessions).
    """
    rows = df.withColumn("_prefix", prefix)
    size = F.count(F.lit(1)).over(Window.partitionBy(*by, "_prefix"))
    rows = rows.withColumn("_fold", F.col("_prefix").isNotNull() & (size >= least))
    group = F.when(F.col("_fold"), F.col("_prefix")).otherwise(F.concat(F.lit("row:"), F.col(key).cast("string")))
    out = rows.withColumn("_group", group).groupBy(*by, "_group").agg(
        F.min(key).alias(key),
        F.max("_fold").alias("folded"),
        F.min("_prefix").alias("prefix"),
        F.min(start).alias("first_day"),
        F.max(F.coalesce(F.col(end), F.col(start))).alias("last_day"),
        F.when(F.count_distinct(venue) == 1, F.min(venue)).otherwise(F.lit("Various venues")).alias("venue"),
        F.count(F.lit(1)).alias("sessions"),
    )
    return out.drop("_group")
