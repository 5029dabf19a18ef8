"""What depends on the order of all rows, without one task that sees them all.

Rows are dealt into ranges of the order, each a partition, and written once, so that every later step finds the same
ranges. A range then needs from the others only a number or a row: the sum of all before it, or the first row after it.
Those are as many as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut


def in_ranges(df: DataFrame, order: list[Column | str], parts: int | None = None) -> DataFrame:
    """``df`` with ``__part``, the number of the range that a row lies in; ranges follow each other in the order."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))


def running(df: DataFrame, order: list[Column | str], values: dict[str, Column], parts: int | None = None) -> DataFrame:
    """``df`` with columns for the sums of ``values`` over all rows before a row in the order."""
    dealt = in_ranges(df.withColumns(values), order, parts)
    sums = dealt.groupBy("__part").agg(*(F.sum(v).alias(v) for v in values))  # a row a range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = F.broadcast(sums.select("__part", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__base_{v}") for v in values)))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.join(bases, "__part").withColumns({v: F.col(f"__base_{v}") + F.coalesce(F.sum(v).over(own), F.lit(0)) for v in values})
    return summed.drop("__part", *(f"__base_{v}" for v in values))


def reached(df: DataFrame, order: list[Column | str], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with the largest ``value`` of all rows before a row in the order; null where none of them has one."""
    dealt = in_ranges(df.withColumn(name, value), order, parts)
    tops = dealt.groupBy("__part").agg(F.max(name).alias("__top"))  # a row a range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = F.broadcast(tops.select("__part", F.max("__top").over(before).alias("__base")))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(bases, "__part").withColumn(name, F.greatest("__base", F.max(name).over(own))).drop("__part", "__base")


def numbered(df: DataFrame, order: list[Column | str], name: str, parts: int | None = None) -> DataFrame:
    """``df`` with the place of each row in the order, from 1."""
    return running(df, order, {name: F.lit(1).cast("long")}, parts).withColumn(name, F.col(name) + 1)


def with_next(df: DataFrame, order: list[Column | str], columns: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``next``: those columns of the row that follows in the order, null behind the last one."""
    dealt = in_ranges(df, order, parts)
    row = F.struct(*columns)
    firsts = dealt.groupBy("__part").agg(F.min_by(row, F.struct(*order)).alias("__row"))  # a row a range
    ahead = F.broadcast(firsts.select("__part", F.lead("__row").over(Window.orderBy("__part")).alias("__ahead")))
    own = Window.partitionBy("__part").orderBy(*order)
    return dealt.join(ahead, "__part").withColumn("next", F.coalesce(F.lead(row).over(own), F.col("__ahead"))).drop("__part", "__ahead")
