"""Ordered keys: floor, ceil, range slices, and as-of lookups of many probes at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


By = Callable[[Column], Column]


def plain(c: Column) -> Column:
    return c


def slice_(a: DataFrame, low: object, high: object, include_low: bool = True, include_high: bool = False, by: By = plain) -> DataFrame:
    """Entries with keys in the range, [low, high) unless told otherwise, in the order of ``by`` (the comparator, as a sort expression).

    In the natural order it is a filter that reaches the scan.
    """
    k, low, high = by(F.col("key")), by(F.lit(low)), by(F.lit(high))
    return a.where((k >= low if include_low else k > low) & (k <= high if include_high else k < high))


def first_last(a: DataFrame, by: By = plain) -> DataFrame:
    """(first_key, last_key) in the order of ``by``; an empty map raises."""
    k = by(F.col("key"))
    got = a.agg(F.min_by("key", k).alias("first_key"), F.max_by("key", k).alias("last_key"), F.count(F.lit(1)).alias("n"))
    return got.where(F.when(F.col("n") == 0, F.raise_error(F.lit("the map is empty"))).otherwise(True).cast("boolean")).drop("n")


def lookup(a: DataFrame, probes: DataFrame, floor: bool = True, inclusive: bool = True, by: By = plain) -> DataFrame:
    """``probes`` with ``key`` and ``value`` of the floor (or ceil) entry of ``probe``, null when there is none.

    ``by`` is the order (a comparator, as a sort expression) under which keys differ. Probes and entries are dealt
    by range together and sorted, equal probes by a salt, so a common probe or null is no hot key; each partition
    carries the last entry seen. Where a partition begins with probes, the last entry of the partitions before it
    answers: one entry a partition, found from the written rows. Nothing is sorted in a single task.
    """
    sign = 1 if floor else -1
    entry_first = (floor and inclusive) or (not floor and inclusive)
    entries = a.where("key is not null").select(by(F.col("key")).alias("_p"), F.lit(0 if entry_first else 1).alias("_side"), F.struct("key", "value").alias("_e"))
    rest = [c for c in probes.columns]
    asked = probes.select(by(F.col("probe")).alias("_p"), F.lit(1 if entry_first else 0).alias("_side"), F.lit(None).cast(entries.schema["_e"].dataType).alias("_e"), F.struct(*rest).alias("_q"))
    both = entries.withColumn("_q", F.lit(None).cast(asked.schema["_q"].dataType)).unionByName(asked)
    order = [F.asc("_p") if sign > 0 else F.desc("_p"), F.asc("_side")]
    dealt = cut(both.repartitionByRange(*order, F.xxhash64("_q")).withColumn("_part", F.spark_partition_id()))
    last = F.max_by("_e", "_p") if floor else F.min_by("_e", "_p")
    ends = dealt.where("_e is not null").groupBy("_part").agg(last.alias("_c"))
    parts = dealt.select("_part").distinct().join(ends, "_part", "left")  # a row a partition
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("_carry", F.last("_c", ignorenulls=True).over(over)).select("_part", "_carry")
    inside = F.last("_e", ignorenulls=True).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = dealt.withColumn("_l", inside).join(F.broadcast(carried), "_part").where("_q is not null")
    hit = F.when(F.col("_p").isNotNull(), F.coalesce("_l", "_carry"))
    return found.select("_q.*", hit["key"].alias("key"), hit["value"].alias("value"))


def floor_index(positioned: DataFrame, probes: DataFrame, inclusive: bool = True) -> DataFrame:
    """``probes`` with ``index``: the greatest position whose key is at most (below) ``probe``."""
    return lookup(positioned.select("key", F.col("idx").alias("value")), probes, True, inclusive).drop("key").withColumnRenamed("value", "index")


def ceil_index(positioned: DataFrame, probes: DataFrame, inclusive: bool = True) -> DataFrame:
    return lookup(positioned.select("key", F.col("idx").alias("value")), probes, False, inclusive).drop("key").withColumnRenamed("value", "index")
