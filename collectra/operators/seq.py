"""Sequences as tables (idx: dense from 0, value). All lazy unless a size or new positions are needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .positions import positions


def idx() -> Column:
    return F.col("idx")


def from_order(df: DataFrame, value: Column | str, *order: Column | str) -> DataFrame:
    """The values of ``df`` in a total order."""
    return positions(df, *order).select("idx", F.col(value).alias("value") if isinstance(value, str) else value.alias("value"))


def size(seq: DataFrame) -> int:
    return seq.count()


def nth(seq: DataFrame, i: int, default: object = None, strict: bool = False) -> DataFrame:
    """One row (value). Out of range: ``default``, or an error if ``strict``."""
    found = seq.where(idx() == i).agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("n"))
    other = F.raise_error(F.lit(f"index {i} is out of range")).cast(seq.schema["value"].dataType) if strict else F.lit(default).cast(seq.schema["value"].dataType)
    return found.select(F.when(F.col("n") > 0, F.col("value")).otherwise(other).alias("value"))


def first_last(seq: DataFrame) -> DataFrame:
    """(first, last); an empty sequence raises."""
    got = seq.agg(F.min_by("value", "idx").alias("first"), F.max_by("value", "idx").alias("last"), F.count(F.lit(1)).alias("n"))
    check = F.when(F.col("n") == 0, F.raise_error(F.lit("the sequence is empty"))).otherwise(True)
    return got.where(check.cast("boolean")).drop("n")


def slice_(seq: DataFrame, start: int, end: int) -> DataFrame:
    """[start, end); empty when end <= start; a bound outside [0, size] raises."""
    if end <= start:
        return seq.limit(0)
    n = size(seq)
    if start < 0 or end > n:
        raise IndexError(f"[{start}, {end}) is outside [0, {n}]")
    return seq.where((idx() >= start) & (idx() < end)).withColumn("idx", idx() - start)


def iterate_from(seq: DataFrame, start: int) -> DataFrame:
    return seq.where(idx() >= start)


def reverse(seq: DataFrame) -> DataFrame:
    return seq.withColumn("idx", F.lit(size(seq) - 1) - idx())


def concat(*seqs: DataFrame) -> DataFrame:
    out, offset = None, 0
    for s in seqs:
        moved = s.withColumn("idx", idx() + offset)
        out = moved if out is None else out.unionByName(moved)
        offset += size(s)
    return out


def literal(seq: DataFrame, at: int, value: object) -> DataFrame:
    row = seq.sparkSession.range(1)
    return row.select(F.lit(at).cast("long").alias("idx"), F.lit(value).cast(seq.schema["value"].dataType).alias("value"))


def add_first(seq: DataFrame, value: object) -> DataFrame:
    return seq.withColumn("idx", idx() + 1).unionByName(literal(seq, 0, value))


def add_last(seq: DataFrame, value: object) -> DataFrame:
    return seq.unionByName(literal(seq, size(seq), value))


def remove_first(seq: DataFrame) -> DataFrame:
    """An empty sequence stays empty."""
    return seq.where(idx() > 0).withColumn("idx", idx() - 1)


def remove_last(seq: DataFrame) -> DataFrame:
    return seq.where(idx() < size(seq) - 1)


def pop_first(seq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first element (one row, value; an empty sequence raises) and the rest."""
    return nth(seq, 0, strict=True), remove_first(seq)


def pop_last(seq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last element (one row, value; an empty sequence raises) and the rest."""
    return nth(seq, size(seq) - 1, strict=True), remove_last(seq)


def drop(seq: DataFrame, n: int) -> DataFrame:
    """Without the first n elements."""
    return seq.where(idx() >= n).withColumn("idx", idx() - max(0, n))


def filter_(seq: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """The elements for which ``keep`` is true, in order."""
    return positions(seq.where(keep(F.col("value"))).withColumnRenamed("idx", "_was"), "_was").select("idx", "value")


def flat_map(seq: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """The elements of the arrays that ``f`` gives, one array after the other; null and empty ones give nothing."""
    parts = seq.select(F.col("idx").alias("_was"), F.posexplode(f(F.col("value"))).alias("_at", "value"))
    return positions(parts, "_was", "_at").select("idx", "value")


def set_(seq: DataFrame, i: int, value: object) -> DataFrame:
    """Replaces the element at i; i = size appends; beyond raises."""
    n = size(seq)
    if not 0 <= i <= n:
        raise IndexError(f"{i} is outside [0, {n}]")
    if i == n:
        return seq.unionByName(literal(seq, n, value))
    return seq.withColumn("value", F.when(idx() == i, F.lit(value).cast(seq.schema["value"].dataType)).otherwise(F.col("value")))


def update(seq: DataFrame, i: int, f: Callable[[Column], Column]) -> DataFrame:
    return seq.withColumn("value", F.when(idx() == i, f(F.col("value"))).otherwise(F.col("value")))


def lazy_map(seq: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return seq.withColumn("value", f(F.col("value")))


def sort(seq: DataFrame, *by: Column) -> DataFrame:
    """Stable: equal elements keep their order."""
    return positions(seq.withColumnRenamed("idx", "_was"), *(by or (F.col("value"),)), F.col("_was")).select("idx", "value")


def merge_sorted(*seqs: DataFrame) -> DataFrame:
    """All elements in ascending order, duplicates kept."""
    out = seqs[0]
    for s in seqs[1:]:
        out = out.unionByName(s)
    return positions(out.select("value"), "value").select("idx", "value")


def split(seq: DataFrame, parts: int) -> DataFrame:
    """Adds ``part``: equal chunks of size div parts, the remainder in the last."""
    n = size(seq)
    parts = max(1, min(parts, max(1, n)))
    return seq.withColumn("part", F.least(F.floor(idx() / max(1, n // parts)), F.lit(parts - 1)).cast("int"))


def indexed(seq: DataFrame, offset: int = 0) -> DataFrame:
    return seq.select((idx() + offset).alias("idx"), "value")


def position_of(seq: DataFrame, value: object) -> DataFrame:
    """(first, last): positions of a value, -1 when absent."""
    hit = seq.where(F.col("value").eqNullSafe(F.lit(value)))
    return hit.agg(F.coalesce(F.min("idx"), F.lit(-1)).alias("first"), F.coalesce(F.max("idx"), F.lit(-1)).alias("last"))


def equals(a: DataFrame, b: DataFrame, alike: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """One row (equal): elementwise, by ``alike`` or else equality with null equal to null."""
    x, y = a.select(F.col("idx").alias("_i"), F.col("value").alias("_v")), b
    both = x.join(y, x["_i"] == y["idx"], "full_outer")
    same = F.col("_i").isNotNull() & F.col("idx").isNotNull() & (alike(F.col("_v"), F.col("value")) if alike else F.col("_v").eqNullSafe(F.col("value")))
    return both.agg((F.coalesce(F.sum(F.when(same, 0).otherwise(1)), F.lit(0)) == 0).alias("equal"))


def hash_(seq: DataFrame, of: Callable[[Column, Column], Column] = F.xxhash64, combine: Callable[[Column], Column] = F.bit_xor) -> DataFrame:
    """One row (hash): depends on values and their order; ``of`` (idx, value) and the aggregate ``combine`` may be one's own."""
    return seq.agg(F.coalesce(combine(of(idx(), F.col("value"))), F.lit(0)).alias("hash"))


def to_text(seq: DataFrame) -> DataFrame:
    """One row (text): [a, b, c]. A text holds the whole sequence."""
    items = F.array_sort(F.collect_list(F.struct("idx", "value")))
    shown = F.transform(items, lambda x: F.coalesce(x["value"].cast("string"), F.lit("null")))
    return seq.agg(F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]")).alias("text"))


def of(spark: SparkSession, *values: object, kind: str) -> DataFrame:
    """The sequence of the given values (of SQL type ``kind``); none give an empty one."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"idx long, value {kind}")


def span(spark: SparkSession, low: int, high: int) -> DataFrame:
    """The numbers of [low, high)."""
    return spark.range(low, max(low, high)).select((F.col("id") - low).alias("idx"), F.col("id").alias("value"))


def collected(parts: list[DataFrame], *order: str, value: str) -> DataFrame:
    """A collector: pieces are accumulated apart (each in its ``order``) and combined in the order given."""
    return concat(*[from_order(p, value, *order) for p in parts])


def on_exhaustion(seq: DataFrame, then: Callable[[DataFrame], None]) -> DataFrame:
    """The sequence, written; ``then`` is called once after its last element was produced."""
    done = cut(seq)
    then(done)
    return done


def memoized(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``f`` computed once for the same arguments; what it gives is written and read from there."""
    known: dict = {}

    def run(*args):
        if args not in known:
            known[args] = cut(f(*args))
        return known[args]

    return run


def clear(seq: DataFrame) -> DataFrame:
    return seq.limit(0)
