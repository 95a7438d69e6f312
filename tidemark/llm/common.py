"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shipping import by_value
from ..plans.storage import drop_tables, materialize, noted, released, shared_dir, table

__all__ = ["by_value", "drop_tables", "fresh", "let", "materialize", "noted", "released", "running", "shared_dir", "small_batches", "table", "utf8"]

#: Bytes of a batch that Spark hands to Python, where the session doesn't say.
BATCH = "4m"


def utf8(col: str | Column) -> Column:
    """A text's UTF-8 bytes; null counts as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand texts to Python in batches of at most ``BATCH``, unless the session sets a size itself.

    Rows of texts fill Spark's own 64 MB, and a batch is held several times at
    once: by Spark before and after, and by the Python worker as Arrow, as
    strings and as results. The setting is read when a query is planned, so it
    stays in the session.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front of each that a column has already (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], tag: str) -> DataFrame:
    """``df`` with running sums (this row included) over all rows in ``order``, without one task for all.

    Rows are dealt by ranges of the order; each range is summed for itself and
    starts at the total of the ranges before it. ``order`` must tell rows apart
    for a definite result. The result is a table in the shared folder's columns.
    """
    part, *own = fresh([*df.columns, *sums], "_part", *(f"_before_{k}" for k in range(len(sums))))
    dealt = materialize(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn(part, F.spark_partition_id()), tag)
    totals = dealt.groupBy(part).agg(*(F.sum(c).alias(b) for b, c in zip(own, sums.values(), strict=True)))  # one row a range
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(part, *(F.coalesce(F.sum(b).over(earlier), F.lit(0)).alias(b) for b in own))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = dealt.withColumns({n: F.sum(c).over(within) for n, c in sums.items()})
    return inner.join(F.broadcast(totals), part).withColumns({n: F.col(n) + F.col(b) for n, b in zip(sums, own, strict=True)}).drop(part, *own)
