"""Sets as tables (value). Null is a value; NaN equals NaN; -0.0 equals 0.0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .maps import printed
from .positions import positions


def of(df: DataFrame, value: Column | str, canon: Callable[[Column], Column] | None = None) -> DataFrame:
    """Distinct values; with ``canon``, one (the least) of those that are alike under it."""
    values = df.select((F.col(value) if isinstance(value, str) else value).alias("value"))
    if canon is None:
        return values.distinct()
    return values.groupBy(canon(F.col("value")).alias("_c")).agg(F.min("value").alias("value")).select("value")


def match(a: DataFrame, b: DataFrame, how: str, canon: Callable[[Column], Column]) -> DataFrame:
    right = b.select(canon(F.col("value")).alias("_c"))
    return a.join(right, canon(a["value"]).eqNullSafe(right["_c"]), how)


def same(c: Column) -> Column:
    return c


def union(a: DataFrame, b: DataFrame, canon: Callable[[Column], Column] = same) -> DataFrame:
    """The values of both; of alike ones the left's."""
    return a.unionByName(b).distinct() if canon is same else a.unionByName(difference(b, a, canon))


def difference(a: DataFrame, b: DataFrame, canon: Callable[[Column], Column] = same) -> DataFrame:
    return match(a, b, "left_anti", canon)


def intersection(a: DataFrame, b: DataFrame, canon: Callable[[Column], Column] = same) -> DataFrame:
    return match(a, b, "left_semi", canon)


def add(a: DataFrame, value: object) -> DataFrame:
    return union(a, a.sparkSession.range(1).select(F.lit(value).cast(a.schema["value"].dataType).alias("value")))


def remove(a: DataFrame, value: object) -> DataFrame:
    return a.where(~F.col("value").eqNullSafe(F.lit(value)))


def contains(a: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (value) with ``found``."""
    side = a.select(F.col("value").alias("_v"), F.lit(True).alias("_in"))
    return probes.join(side, probes["value"].eqNullSafe(side["_v"]), "left").select("value", F.coalesce("_in", F.lit(False)).alias("found"))


def contains_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return difference(b, a).agg((F.count(F.lit(1)) == 0).alias("result"))


def contains_any(a: DataFrame, b: DataFrame) -> DataFrame:
    return intersection(b, a).agg((F.count(F.lit(1)) > 0).alias("result"))


def equals(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (equal)."""
    return difference(a, b).unionByName(difference(b, a)).agg((F.count(F.lit(1)) == 0).alias("equal"))


def zip_(a: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """The map of each value to f(value)."""
    return a.select(F.col("value").alias("key"), f(F.col("value")).alias("value"))


def hash_(a: DataFrame, of: Callable[[Column], Column] = F.xxhash64, combine: Callable[[Column], Column] = F.bit_xor) -> DataFrame:
    return a.agg(F.coalesce(combine(of(F.col("value"))), F.lit(0)).alias("hash"))


def collected(parts: list[DataFrame], value: str) -> DataFrame:
    """A collector: pieces are reduced to sets apart and combined by union."""
    out = of(parts[0], value)
    for p in parts[1:]:
        out = union(out, of(p, value))
    return out


def split(a: DataFrame, parts: int) -> DataFrame:
    """Adds ``part``, by hash of the value."""
    return a.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int"))


def split_range(a: DataFrame, parts: int) -> DataFrame:
    """Adds ``part``: ranges of values in ascending order, nulls first, of sizes that differ by one at most."""
    ranked = positions(a, "value")
    n = F.lit(max(1, ranked.count()))
    return ranked.withColumn("part", F.floor(F.col("idx") * parts / n).cast("int")).drop("idx")


def to_text(a: DataFrame, value: Callable[[Column], Column] = printed) -> DataFrame:
    """One row (text): {a, b}, in ascending order; ``value`` prints them."""
    shown = F.transform(F.array_sort(F.collect_set("value")), value)
    return a.agg(F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}")).alias("text"))
