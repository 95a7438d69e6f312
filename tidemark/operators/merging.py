"""Keyed tables: inserts, upserts, outcomes, bounded logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per(df: DataFrame, by: list, order: list) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def keep_last(df: DataFrame, by: list, order: list, n: int) -> DataFrame:
    """The first n rows of each group by ``order``: bounded logs and histories."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def overwrite(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old ones whose key isn't among them."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with which."""
    return a.exceptAll(b).withColumn("only", F.lit("before")).unionByName(b.exceptAll(a).withColumn("only", F.lit("after")))


def apply_outcomes(leads: DataFrame, outcomes: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Leads after a run's outcomes (key, kind, reason): dropped ones go, failures count, the third rejects.

    leads: key, status, attempts, ...; a key without an outcome stays as it is.
    """
    o = outcomes.select(F.col(key).alias("_k"), F.col("kind").alias("_kind"), F.col("reason").alias("_reason"))
    j = leads.join(o, F.col(key) == F.col("_k"), "left").filter(F.col("_kind").isNull() | (F.col("_kind") != "dropped"))
    tried = F.coalesce("attempts", F.lit(0)) + 1
    status = F.when(F.col("_kind").isNull(), F.col("status")).when(F.col("_kind") == "done", "done").when((F.col("_kind") == "rejected") | (tried >= most), "rejected").otherwise("pending")
    attempts = F.when(F.col("_kind").isNull() | (F.col("_kind") == "done"), F.col("attempts")).otherwise(tried)
    return j.withColumns({"status": status, "attempts": attempts, "reason": F.col("_reason")}).drop("_k", "_kind", "_reason")


def fill_gaps(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], never: list[str] = ()) -> DataFrame:
    """Old rows with their null values taken from new rows of the key."""
    n = new.select(*keys, *(F.col(v).alias(f"_{v}") for v in values))
    out = old.join(n, keys, "left")
    return out.withColumns({v: F.coalesce(v, f"_{v}") for v in values if v not in never}).drop(*(f"_{v}" for v in values))


def renew(old: DataFrame, new: DataFrame, keys: list[str], fresh: list[str]) -> DataFrame:
    """Old rows with some values taken from new rows of the key, identity kept."""
    n = new.select(*keys, F.lit(True).alias("_new"), *(F.col(v).alias(f"_{v}") for v in fresh))
    out = old.join(n, keys, "left")
    return out.withColumns({v: F.when(F.col("_new"), F.col(f"_{v}")).otherwise(F.col(v)) for v in fresh}).drop("_new", *(f"_{v}" for v in fresh))


def subscribe(members: DataFrame, joining: DataFrame, address: Column) -> DataFrame:
    """Members with those who join: new ones are added, known ones' opt-out is lifted."""
    m = members.withColumn("_a", address)
    j = joining.withColumn("_a", address).dropDuplicates(["_a"])
    back = m.join(j.select("_a", F.lit(True).alias("_joins")), "_a", "left").withColumn("unsubscribed", F.col("unsubscribed") & F.col("_joins").isNull()).drop("_joins")
    return back.unionByName(j.join(m.select("_a"), "_a", "left_anti").withColumn("unsubscribed", F.lit(False))).drop("_a")


def unsubscribe(members: DataFrame, leaving: DataFrame, address: Column) -> DataFrame:
    """Members with the opt-out set for those who leave."""
    gone = leaving.select(address.alias("_a"), F.lit(True).alias("_leaves")).distinct()
    return members.withColumn("_a", address).join(gone, "_a", "left").withColumn("unsubscribed", F.col("unsubscribed") | F.col("_leaves").isNotNull()).drop("_a", "_leaves")


def claim(ledger: DataFrame, wanted: DataFrame) -> DataFrame:
    """(week, step) pairs not done yet: what a run may claim."""
    return wanted.select("week", "step").distinct().join(ledger.select("week", "step"), ["week", "step"], "left_anti")


def due_leads(leads: DataFrame, first, last, today, n: int = 8) -> DataFrame:
    """Pending leads in the window, earliest first, at most n; and expired ones (part due or expired)."""
    end = F.coalesce("end", "start")
    expired = leads.filter(end < today).withColumn("part", F.lit("expired"))
    open_ = leads.filter((F.coalesce("status", F.lit("pending")) == "pending") & (end >= today) & (F.col("start") <= last) & (end >= first))
    return open_.orderBy("start", "name").limit(n).withColumn("part", F.lit("due")).unionByName(expired)
