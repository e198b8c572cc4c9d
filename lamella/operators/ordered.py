"""Operators where the order of rows decides; the order is always given by columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUNNING = (Window.unboundedPreceding, Window.currentRow)
EARLIER = (Window.unboundedPreceding, -1)


def first_wins(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate, so a hot key is combined before the shuffle."""
    names = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_row"), F.count("*").alias("listings"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in names], "listings")


def cross_file_distinct(rows: DataFrame, keys: list, file: str) -> DataFrame:
    """Rows of the first file that has their key; repeats within that file stay."""
    return rows.withColumn("_f", F.min(file).over(Window.partitionBy(*keys))).filter(F.col(file) == F.col("_f")).drop("_f")


def islands(rows: DataFrame, partition: list, order: list, changed: Column, name: str = "island") -> DataFrame:
    """rows numbered by run: a new one starts where `changed` holds (an expression over lag()) and at the first row."""
    running = Window.partitionBy(*partition).orderBy(*order)
    start = rows.withColumn("_start", F.when(F.row_number().over(running) == 1, 1).when(changed, 1).otherwise(0))
    return start.withColumn(name, F.sum("_start").over(running.rowsBetween(*RUNNING))).drop("_start")


def before(column: str | Column, partition: list, order: list) -> Column:
    return F.lag(column).over(Window.partitionBy(*partition).orderBy(*order))


def gap_clusters(rows: DataFrame, partition: list, value: Column, order: list, tolerance, name: str = "cluster") -> DataFrame:
    """Sorted values in clusters: a gap above the tolerance starts a new one."""
    return islands(rows, partition, order, value - F.lag(value).over(Window.partitionBy(*partition).orderBy(*order)) > tolerance, name)


def interval_union(rows: DataFrame, partition: list, lo: str, hi: str) -> DataFrame:
    """Overlapping or touching intervals of each partition merged; with how many each has."""
    order = Window.partitionBy(*partition).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(*EARLIER))
    numbered = islands(rows.withColumn("_reach", reach), partition, [lo, hi], F.col(lo) > F.col("_reach"), "_i")
    return numbered.groupBy(*partition, "_i").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("intervals")).drop("_i")


def cumulative(rows: DataFrame, partition: list, order: list, length: Column) -> DataFrame:
    """rows with s0 and s1: where each begins and ends along its route."""
    end = F.sum(length).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(*RUNNING))
    return rows.withColumn("s1", end).withColumn("s0", F.col("s1") - length)


def until_first(rows: DataFrame, partition: list, order: Column | str, bad: Column) -> DataFrame:
    """The rows before the first bad one."""
    stop = F.min(F.when(bad, F.col(order) if isinstance(order, str) else order)).over(Window.partitionBy(*partition))
    place = F.col(order) if isinstance(order, str) else order
    return rows.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (place < F.col("_stop"))).drop("_stop")


def runner_up(rows: DataFrame, partition: list[str], distance: str, name: str) -> DataFrame:
    """For each partition the nearest row's name and distance, and the runner-up's distance (null without)."""
    order = Window.partitionBy(*partition).orderBy(distance, name)
    two = rows.withColumn("_n", F.row_number().over(order)).filter("_n <= 2")
    return two.groupBy(*partition).agg(
        F.max(F.when(F.col("_n") == 1, F.col(name))).alias("nearest"), F.max(F.when(F.col("_n") == 1, F.col(distance))).alias("best"), F.max(F.when(F.col("_n") == 2, F.col(distance))).alias("second")
    )


def variants(rows: DataFrame, name: str, signature: str, seq: str) -> DataFrame:
    """`variant`: the name for the first signature of a name, name#2, name#3... for later different ones."""
    first = rows.withColumn("_first", F.min(seq).over(Window.partitionBy(name, signature)))
    n = F.dense_rank().over(Window.partitionBy(name).orderBy("_first"))
    return first.withColumn("_n", n).withColumn("variant", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), F.col("_n").cast("string")))).drop("_first", "_n")


def budgeted(rows: DataFrame, partition: list[str], size: str, order: list, most: int) -> DataFrame:
    """The largest `most` rows of each partition in one row with a report of the rest: kept, left, left_total, left_largest."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy(F.col(size).desc(), *order)))
    rest = F.col("_n") > most
    return ranked.groupBy(*partition).agg(
        F.count(F.when(~rest, 1)).alias("kept"), F.count(F.when(rest, 1)).alias("left"), F.sum(F.when(rest, F.col(size))).alias("left_total"), F.max(F.when(rest, F.col(size))).alias("left_largest")
    )
