"""Places of rows in an order, without bringing any group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import durable


def ranked(df: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, int]:
    """df with ``index`` (place from 0 in its group) and ``total`` (rows of its group), and the largest total.

    Rows are dealt by ranges of (group, order), so a group of any size spans as many tasks as it needs.  A small table of
    rows per range and group gives the number of rows before each range; it has at most one row per range and one per group.
    Nulls come first; rows equal in group and order are numbered in any way.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    placed = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    placed = durable(placed.withColumn("_pos", F.monotonically_increasing_id()), "ranked").withColumn("_range", F.shiftright("_pos", 33))
    mine = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # at most one row per range
    counts = placed.groupBy(*group, "_range").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(mine.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = durable(counts.select(*group, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(mine).alias("total")), "ranges")
    largest = starts.agg(F.max("total")).first()[0] or 0
    named = starts.toDF(*[f"_{c}" for c in group], "_at", "_shift", "total")
    on = F.col("_range") == F.col("_at")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    full = placed.join(named, on).withColumn("index", F.col("_pos") + F.col("_shift"))
    return full.select(*df.columns, "index", "total"), largest
