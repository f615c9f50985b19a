"""Dense positions of ordered rows, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def positions(df: DataFrame, *order: Column | str, out: str = "idx") -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... in the given total order.

    Rows are dealt by range, numbered inside their partition, and shifted by the row counts of the
    partitions before; the driver only gets one count a partition. The dealt rows are written first, so
    both passes see the same partitions. An empty input gives an empty output.
    """
    order = order or tuple(df.columns)
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r[0], r[1]) for r in dealt.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _start long"))  # a row a partition
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_local", local).join(offsets, "_part").select(*df.columns, (F.col("_start") + F.col("_local") - 1).alias(out))


def nth(positioned: DataFrame, i: int) -> DataFrame:
    """The row at position i; none when out of range."""
    return positioned.where(F.col("idx") == i)


def index_of(positioned: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """Each probe's ``idx`` (null when absent). The inverse of ``nth``; null keys match null."""
    side = positioned.select(F.col(key).alias("_k"), "idx")
    return probes.join(side, probes[key].eqNullSafe(side["_k"]), "left").drop("_k")


def slice_indices(positioned: DataFrame, start: int, end: int) -> DataFrame:
    """Rows at positions [start, end), numbered from 0."""
    return positioned.where((F.col("idx") >= start) & (F.col("idx") < end)).withColumn("idx", F.col("idx") - start)
