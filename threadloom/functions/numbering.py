"""Global sequence numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable


def number_rows(df: DataFrame, *order: Column | str, name: str = "n", start: int = 1) -> DataFrame:
    """Add consecutive numbers in ``order``, which must be unique over the rows.

    Rows are range-sorted once and written durably, so the offset counts and
    the rows come from the same partitions even when an executor is lost.
    """
    placed = durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("__part").count()
        .select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__off"))
    )
    return (
        placed.join(offsets, "__part")
        .withColumn(name, F.col("__seq") + F.col("__off") + F.lit(start))
        .drop("__part", "__seq", "__off")
    )
