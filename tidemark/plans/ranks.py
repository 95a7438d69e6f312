"""Numbers across a whole table, or across groups of any size, without one task for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize


def numbered(df: DataFrame, order: list[Column | str], by: list[str] | None = None, name: str = "n") -> DataFrame:
    """``df`` with ``name``: each row's number (long, from 0) in ``order`` within its group of ``by``.

    Rows are dealt by ranges of group and order, so a large group lies in many
    tasks; each range is numbered by itself and begins where the ranges before
    it end. Rows equal in group and order stand in one task and in any order.
    The rows are written to the shared folder once, as ranges are not dealt the
    same way twice. Null group values are a group.
    """
    by = by or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_size"))  # a row for each range, and one more where a range holds several groups
    earlier = F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_g_{k}") for k, c in enumerate(by)), earlier.alias("_before"))
    met = F.col("_part") == F.col("_p")
    for k, c in enumerate(by):
        met &= F.col(c).eqNullSafe(F.col(f"_g_{k}"))
    inner = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    out = dealt.withColumn("_inner", inner).join(starts if by else F.broadcast(starts), met)  # without groups, a row a range
    return out.withColumn(name, (F.col("_before") + F.col("_inner") - 1).cast("long")).select(*df.columns, name)
