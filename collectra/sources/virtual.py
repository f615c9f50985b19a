"""Collections that are functions of an index: nothing is stored until a write."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sequence(spark: SparkSession, size: int, nth: Callable[[Column], Column]) -> DataFrame:
    return spark.range(size).select(F.col("id").alias("idx"), nth(F.col("id")).alias("value"))


def set_(spark: SparkSession, size: int, nth: Callable[[Column], Column]) -> DataFrame:
    """``nth`` must be one to one."""
    return spark.range(size).select(nth(F.col("id")).alias("value"))


def contains(probes: DataFrame, size: int, index_of: Callable[[Column], Column]) -> DataFrame:
    """Membership by the inverse function (null: absent), without the set."""
    i = index_of(F.col("value"))
    return probes.select("value", F.coalesce((i >= 0) & (i < size), F.lit(False)).alias("found"))


def map_(keys: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """From a set (value) of keys."""
    return keys.select(F.col("value").alias("key"), f(F.col("value")).alias("value"))


@dataclass(frozen=True)
class VirtualSet:
    """A set that is a function of the index; ``nth`` must be one to one and ``index_of`` its inverse (null: no element)."""

    size: int
    nth: Callable[[Column], Column]
    index_of: Callable[[Column], Column]

    def rows(self, spark: SparkSession) -> DataFrame:
        """(value): from here on an ordinary set, so an edit or a write materialises it."""
        return set_(spark, self.size, self.nth)

    def positions(self, spark: SparkSession) -> DataFrame:
        """(value, idx), without a sort."""
        return spark.range(self.size).select(self.nth(F.col("id")).alias("value"), F.col("id").alias("idx"))

    def contains(self, probes: DataFrame) -> DataFrame:
        return contains(probes, self.size, self.index_of)

    def indices(self, probes: DataFrame) -> DataFrame:
        """``probes`` (value) with ``idx``, null where absent."""
        i = self.index_of(F.col("value"))
        return probes.select("value", F.when((i >= 0) & (i < self.size), i.cast("long")).alias("idx"))

    def map(self, spark: SparkSession, f: Callable[[Column], Column]) -> DataFrame:
        return map_(self.rows(spark), f)


@dataclass(frozen=True)
class VirtualSortedSet(VirtualSet):
    """As ``VirtualSet`` with ``nth`` ascending; ``floor_of`` gives the index of the greatest element up to a value (it may lie outside)."""

    floor_of: Callable[[Column], Column]

    def floors(self, probes: DataFrame) -> DataFrame:
        """``probes`` (value) with ``idx`` and ``floor``, null where all elements are greater; no join."""
        i = F.least(self.floor_of(F.col("value")).cast("long"), F.lit(self.size - 1))
        i = F.when(i >= 0, i)
        return probes.select("value", i.alias("idx"), F.when(i.isNotNull(), self.nth(i)).alias("floor"))

    def ceils(self, probes: DataFrame) -> DataFrame:
        """``probes`` (value) with ``idx`` and ``ceil``, null where all elements are less."""
        below = F.greatest(self.floor_of(F.col("value")).cast("long"), F.lit(-1))
        hit = (below >= 0) & (self.nth(below) == F.col("value"))
        i = F.when(hit, below).otherwise(below + 1)
        i = F.when(i < self.size, i)
        return probes.select("value", i.alias("idx"), F.when(i.isNotNull(), self.nth(i)).alias("ceil"))

    def slice(self, spark: SparkSession, low: object, high: object) -> DataFrame:
        """(value) in [low, high): a filter."""
        return self.rows(spark).where((F.col("value") >= low) & (F.col("value") < high))


def view(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, idx, value): the arrays of a column as sequences, nothing copied; an empty or null array has no rows."""
    return df.select(*keys, F.posexplode(column).alias("idx", "value"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Rows from parquet, orc, csv, json or text; give a schema where the format has none."""
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.format(format).mode(mode).save(path)
