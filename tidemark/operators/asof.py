"""As-of joins by one sort: both sides in one table, the last value carried on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], strict: bool = False, tie: str | None = None) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row at or before ``on`` (before, if ``strict``).

    Of right rows at one time the last by ``tie`` counts. Left rows without an
    earlier right row get nulls.
    """
    side = 0 if strict else 1  # at one time: left rows stand before or after right ones
    held = F.struct(*values)
    l = left.withColumns({"_side": F.lit(side), "_v": F.lit(None).cast(right.select(held).schema[0].dataType), "_tie": F.lit(None).cast("string")})  # noqa: E741
    r = right.select(*by, on, F.lit(1 - side).alias("_side"), held.alias("_v"), (F.col(tie).cast("string") if tie else F.lit(None).cast("string")).alias("_tie"))
    both = l.withColumn("_left", F.lit(True)).unionByName(r.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(on, "_side", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(order)).filter("_left")
    return out.select(*left.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def value_on_or_before(df: DataFrame, day: str, value: str, at, by: list[str] = (), tie: str | None = None) -> DataFrame:
    """The latest value on or before a day, per group; of one day's values the one of the largest ``tie``."""
    order = F.struct(day, tie) if tie else F.col(day)
    return df.filter(F.col(day) <= at).groupBy(*by).agg(F.max_by(value, order).alias(value), F.max(day).alias(day))
