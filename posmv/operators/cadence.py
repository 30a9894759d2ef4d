"""Updates per key and interval: reduce the output, never the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posmv.operators.prices import newest

#: A rate may be over its limit by this factor, as an interval's edges are not the measurement's.
TOLERANCE = 1.15


def conflate(updates: DataFrame, by: tuple[str, ...], interval_ms: int, order: tuple[str, ...], carry: tuple[str, ...]) -> DataFrame:
    """The last update of each key and interval; all of them where the interval is 0."""
    if interval_ms <= 0:
        return updates
    slot = (F.floor(F.col("as_of") / interval_ms) * interval_ms).alias("emit_from")
    return newest(updates, *by, slot, order=order, carry=carry)


def rates(updates: DataFrame, by: tuple[str, ...], interval_ms: int, limit: float) -> DataFrame:
    """One row: keys, updates, the worst and the mean of the keys' largest number of updates in an interval, and
    whether the worst is within the limit."""
    slots = updates.groupBy(*by, F.floor(F.col("as_of") / interval_ms).alias("slot")).agg(F.count("*").alias("n"))
    keys = slots.groupBy(*by).agg(F.max("n").alias("worst"), F.sum("n").alias("n"))
    return keys.agg(
        F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("updates"), F.max("worst").alias("worst"), F.avg("worst").alias("mean"),
        (F.coalesce(F.max("worst"), F.lit(0)) <= F.lit(limit * TOLERANCE)).alias("within_limit"),
    )


def progress(updates: DataFrame, bucket_ms: int) -> DataFrame:
    """The newest as_of in each bucket of arrival and how far it went on since the bucket before."""
    from pyspark.sql import Window

    per = updates.groupBy((F.floor(F.col("arrived") / bucket_ms) * bucket_ms).alias("bucket")).agg(F.max("as_of").alias("newest"), F.count("*").alias("records"))
    # One row a bucket of time, not of data: the running maximum over them is small.
    running = F.max("newest").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    high = per.withColumn("high", running)
    return high.withColumn("advance", F.col("high") - F.lag("high").over(Window.orderBy("bucket")))


def per_bucket(df: DataFrame, time: str, bucket_ms: int, *sums: Column) -> DataFrame:
    """Records in each bucket of time."""
    return df.groupBy((F.floor(F.col(time) / bucket_ms) * bucket_ms).alias("bucket")).agg(F.count("*").alias("records"), *sums)
