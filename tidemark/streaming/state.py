"""Stateful runs: show-once streams, retry counters with expiry, idempotent upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.shipping import by_value

by_value(__name__)


def first_seen(stream: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """Each key once within the watermark's reach."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def earliest(stream: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Each key with its earliest time, in whatever order rows come; for the complete or update mode."""
    return stream.groupBy(*keys).agg(F.min(at).alias(at))


def windowed_counts(stream: DataFrame, at: str, late: str, size: str, by: list[str]) -> DataFrame:
    """Counts per tumbling window, late rows up to the watermark (R10's time-based kin)."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, at: str, late: str, gap: str, by: list[str]) -> DataFrame:
    """Sessions of rows no further apart than the gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count(F.lit(1)).alias("n"))


def retries(stream: DataFrame, key: str, ok: str, at: str, late: str = "1 day", most: int = 3, ttl_ms: int = 7 * 86_400_000) -> DataFrame:
    """(key, attempts, status) after each batch: done, pending, or rejected at ``most`` failures.

    State is dropped on success, on rejection and ``ttl_ms`` after the last news
    by the time ``at`` that the rows carry, so a run over all that is there ends
    and reruns agree.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        status, news = "pending", 0
        for pdf in batches:
            news = max(news, int(pdf[at].max().timestamp() * 1000))
            for good in pdf[ok]:
                if status != "pending":
                    break
                if good:
                    status = "done"
                else:
                    n += 1
                    status = "rejected" if n >= most else "pending"
        if status == "pending":
            state.update((n,))
            state.setTimeoutTimestamp(max(news, state.getCurrentWatermarkMs()) + ttl_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [k[0]], "attempts": [n], "status": [status]})

    kind = stream.schema[key].dataType.simpleString()
    timed = stream.withWatermark(at, late).groupBy(key)
    return timed.applyInPandasWithState(step, f"{key} {kind}, attempts int, status string", "attempts int", "update", GroupStateTimeout.EventTimeTimeout)


def upsert_each_batch(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """Keep the latest row of each key in a table of numbered versions; a batch that runs again writes its own version again."""

    def write(batch: DataFrame, number: int) -> None:
        from ..operators.merging import one_per

        spark = batch.sparkSession
        if number > 0:
            batch = spark.read.parquet(f"{path}/version={number - 1}").unionByName(batch)
        one_per(batch, keys, [F.desc(order)]).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def moved_and_lost(listed: DataFrame, seen: DataFrame, key: str, day: str, at: str, within: str = "7 days", late: str = "1 day") -> DataFrame:
    """(key, day, now, at, status): what became of each listed row, and what was seen that isn't listed.

    ``listed`` and ``seen`` are streams of key, day and the time ``at`` of the row.
    A listed row that is seen within the time after it is the same, or moved
    where its day is another one then; each different day counts once. One that
    isn't is lost, told once the watermark is past its time. Rows seen that no
    listed row waits for are new. Rows later than ``late`` behind the newest of
    their stream are left out; null keys meet nothing.
    """
    a = listed.select(F.col(key).alias("_a"), F.col(day).alias("day"), F.col(at).alias("_at")).withWatermark("_at", late)
    once = seen.select(F.col(key).alias("_b"), F.col(day).alias("now"), F.col(at).alias("_seen")).withWatermark("_seen", late).dropDuplicatesWithinWatermark(["_b", "now"])
    met = (F.col("_a") == F.col("_b")) & (F.col("_seen") >= F.col("_at")) & (F.col("_seen") <= F.col("_at") + F.expr(f"INTERVAL {within}"))
    status = F.when(F.col("_seen").isNull(), "lost").when(F.col("_at").isNull(), "new").when(F.col("day").eqNullSafe(F.col("now")), "same").otherwise("moved")
    return a.join(once, met, "full_outer").select(F.coalesce("_a", "_b").alias(key), "day", "now", F.coalesce("_seen", "_at").alias(at), status.alias("status"))
