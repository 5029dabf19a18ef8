"""Extensions over event streams: watermarked tumbling, sliding and session windows, and as-of and range joins.

The evidence operators are batch operators; these are here for event tables beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, ts: str, keys: list[str], length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of ``value`` by window and keys; rows later than ``late`` are left out of a stream."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = timed.groupBy(F.window("__ts", length, slide or length).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap without events."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = timed.groupBy(F.session_window("__ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each left row with the last ``value`` of the right at or before its time: one union, one window, no join."""
    both = left.select(key, ts, F.struct(*left.columns).alias("row"), F.lit(None).cast(right.schema[value].dataType).alias("seen"), F.lit(1).alias("side")).unionByName(
        right.select(key, ts, F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("row"), F.col(value).alias("seen"), F.lit(0).alias("side"))
    )
    w = Window.partitionBy(key).orderBy(ts, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last", F.last("seen", ignorenulls=True).over(w)).filter("side = 1").select("row.*", F.col("last").alias(value))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, bucket: int) -> DataFrame:
    """Points inside ranges [low, high): an equi-join on buckets of the line, then the exact test."""
    cut = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor((F.col(high) - 1) / bucket))))
    return points.withColumn("__b", F.floor(F.col(point) / bucket)).join(cut, "__b").filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__b")
