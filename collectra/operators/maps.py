"""Maps as tables (key, value), one row a key. A null value is not an absent key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import positions

Merge = Callable[[Column, Column], Column]


def same(c: Column) -> Column:
    return c


def from_rows(df: DataFrame, key: Column, value: Column, order: Column, merge: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows in the order of ``order``; later ones win, or ``merge`` (an aggregate) makes one value a key."""
    rows = df.select(key.alias("key"), value.alias("value"), order.alias("_o"))
    return rows.groupBy("key").agg((merge(F.col("value")) if merge else F.max_by(F.struct("value"), "_o")["value"]).alias("value"))


def from_rows_alike(df: DataFrame, key: Column, value: Column, order: Column, canon: Callable[[Column], Column]) -> DataFrame:
    """As ``from_rows`` for keys that are alike under ``canon``: the first key stays, the last value wins."""
    rows = df.select(key.alias("key"), value.alias("value"), order.alias("_o"))
    return rows.groupBy(canon(F.col("key")).alias("_c")).agg(F.min_by("key", "_o").alias("key"), F.max_by(F.struct("value"), "_o")["value"].alias("value")).drop("_c")


def fold(df: DataFrame, key: Column, value: Column, order: Column, zero: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """An ordered fold, for merge functions that are not associative. It holds one key's values at a time."""
    rows = df.select(key.alias("key"), F.struct(order.alias("o"), value.alias("v")).alias("_e"))
    return rows.groupBy("key").agg(F.aggregate(F.array_sort(F.collect_list("_e")), zero, lambda acc, x: step(acc, x["v"])).alias("value"))


def merge(a: DataFrame, b: DataFrame, f: Merge, canon: Callable[[Column], Column] = same) -> DataFrame:
    """All keys of both; ``f(left value, right value)`` where both have the key; a left key survives."""
    x = a.select(F.col("key").alias("_a"), F.col("value").alias("_x"), F.lit(True).alias("_in_a"))
    y = b.select(F.col("key").alias("_b"), F.col("value").alias("_y"), F.lit(True).alias("_in_b"))
    on = canon(F.col("_a")).eqNullSafe(canon(F.col("_b")))
    value = F.when(F.col("_in_a").isNull(), F.col("_y")).when(F.col("_in_b").isNull(), F.col("_x")).otherwise(f(F.col("_x"), F.col("_y")))
    return x.join(y, on, "full_outer").select(F.when(F.col("_in_a"), F.col("_a")).otherwise(F.col("_b")).alias("key"), value.alias("value"))


def keyed(a: DataFrame, b: DataFrame, how: str, column: str, canon: Callable[[Column], Column]) -> DataFrame:
    right = b.select(canon(F.col(column)).alias("_k"))
    return a.join(right, canon(a["key"]).eqNullSafe(right["_k"]), how)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The right side wins, with null values too."""
    return b.unionByName(keyed(a, b, "left_anti", "key", same))


def difference(a: DataFrame, b: DataFrame, canon: Callable[[Column], Column] = same) -> DataFrame:
    """``b`` is a map (key, value) or a set (value)."""
    return keyed(a, b, "left_anti", "key" if "key" in b.columns else "value", canon)


def intersection(a: DataFrame, b: DataFrame, canon: Callable[[Column], Column] = same) -> DataFrame:
    """Keeps the left's values."""
    return keyed(a, b, "left_semi", "key" if "key" in b.columns else "value", canon)


def put(a: DataFrame, edits: DataFrame, f: Merge | None = None) -> DataFrame:
    """A batch of edits (key, value, seq): per key the last by seq; ``f(old, new)`` on collisions."""
    last = edits.groupBy("key").agg(F.max_by(F.struct("value"), "seq")["value"].alias("value"))
    return merge(a, last, f or (lambda old, new: new))


def update(a: DataFrame, keys: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """f(old value, or null) for the keys (key), which are put in where missing."""
    k = keys.select(F.col("key").alias("_k"), F.lit(True).alias("_hit")).distinct()
    both = a.withColumn("_in", F.lit(True)).join(k, a["key"].eqNullSafe(k["_k"]), "full_outer")
    value = F.when(F.col("_hit"), f(F.col("value"))).otherwise(F.col("value"))
    return both.select(F.when(F.col("_in"), F.col("key")).otherwise(F.col("_k")).alias("key"), value.alias("value"))


def remove(a: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (key) that are absent change nothing."""
    return keyed(a, keys, "left_anti", "key", same)


def get(a: DataFrame, probes: DataFrame, default: Column) -> DataFrame:
    """``probes`` (key) with ``value`` and ``found``; the default only where the key is absent."""
    side = a.select(F.col("key").alias("_k"), F.col("value").alias("_v"), F.lit(True).alias("_in"))
    got = probes.join(side, probes["key"].eqNullSafe(side["_k"]), "left")
    return got.select("key", F.when(F.col("_in"), F.col("_v")).otherwise(default).alias("value"), F.coalesce("_in", F.lit(False)).alias("found"))


def get_strict(a: DataFrame, probes: DataFrame) -> DataFrame:
    """As ``get``; a key that is absent raises when the row is read."""
    got = get(a, probes, F.lit(None))
    missing = F.raise_error(F.concat(F.lit("no such key: "), F.coalesce(F.col("key").cast("string"), F.lit("null"))))
    return got.select("key", F.when(~F.col("found"), missing).otherwise(F.col("value")).alias("value"))


def entry_equals(x: Column, y: Column) -> Column:
    """Entries (structs of key and value) are equal if both their parts are; nulls equal each other."""
    return x["key"].eqNullSafe(y["key"]) & x["value"].eqNullSafe(y["value"])


def get_or_create(a: DataFrame, probes: DataFrame, make: Callable[[Column], Column]) -> DataFrame:
    """As ``get``, but a null value counts as missing too."""
    return get(a, probes, F.lit(None)).select("key", F.coalesce("value", make(F.col("key"))).alias("value"))


def map_values(a: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    return a.select("key", f(F.col("key"), F.col("value")).alias("value"))


def keys(a: DataFrame) -> DataFrame:
    return a.select(F.col("key").alias("value"))


def values(a: DataFrame) -> DataFrame:
    return a.select("value")


def entries(a: DataFrame) -> DataFrame:
    return a.select(F.struct("key", "value").alias("entry"))


def contains_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return difference(b, a).agg((F.count(F.lit(1)) == 0).alias("result"))


def contains_any(a: DataFrame, b: DataFrame) -> DataFrame:
    return intersection(b, a).agg((F.count(F.lit(1)) > 0).alias("result"))


def equals(a: DataFrame, b: DataFrame, alike: Merge | None = None) -> DataFrame:
    """One row (equal): same keys, and values alike (by default null-safe equality)."""
    alike = alike or (lambda x, y: x.eqNullSafe(y))
    x = a.select(F.col("key").alias("_a"), F.col("value").alias("_x"), F.lit(True).alias("_in_a"))
    y = b.select(F.col("key").alias("_b"), F.col("value").alias("_y"), F.lit(True).alias("_in_b"))
    good = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & alike(F.col("_x"), F.col("_y"))
    both = x.join(y, F.col("_a").eqNullSafe(F.col("_b")), "full_outer")
    return both.agg((F.coalesce(F.sum(F.when(good, 0).otherwise(1)), F.lit(0)) == 0).alias("equal"))


def hash_(a: DataFrame, of: Callable[[Column, Column], Column] = F.xxhash64, combine: Callable[[Column], Column] = F.bit_xor) -> DataFrame:
    """One row (hash), whatever the order; ``of`` (key, value) and the aggregate ``combine`` may be one's own."""
    return a.agg(F.coalesce(combine(of(F.col("key"), F.col("value"))), F.lit(0)).alias("hash"))


def same_semantics(a: DataFrame, b: DataFrame, canon_a: Callable[[Column], Column] = same, canon_b: Callable[[Column], Column] = same) -> bool:
    """Whether keys of both maps can be matched as they are: one type, one equality."""
    return canon_a is canon_b and a.schema["key"].dataType == b.schema["key"].dataType


def merge_across(a: DataFrame, b: DataFrame, f: Merge, canon_a: Callable[[Column], Column], canon_b: Callable[[Column], Column]) -> DataFrame:
    """``merge`` of maps whose equalities may differ: where they do, the right one is first reduced to one entry for each
    key that the left's equality tells apart (the least key's), then merged under the left's."""
    if not same_semantics(a, b, canon_a, canon_b):
        b = b.groupBy(canon_a(F.col("key")).alias("_c")).agg(F.min_by(F.struct("key", "value"), "key").alias("_e")).select("_e.key", "_e.value")
    return merge(a, b, f, canon_a)


def int_keys(a: DataFrame) -> DataFrame:
    """Keys as 64-bit integers; a key that is none raises. Null keys stay."""
    key = F.col("key").cast("long")
    bad = F.col("key").isNotNull() & (key.isNull() | (key.cast("double") != F.col("key").cast("double")))
    return a.withColumn("key", F.when(bad, F.raise_error(F.lit("the key is no integer")).cast("long")).otherwise(key))


def float_keys(a: DataFrame) -> DataFrame:
    """Keys as doubles: -0.0 is 0.0, NaN raises."""
    key = F.col("key").cast("double")
    return a.withColumn("key", F.when(F.isnan(key), F.raise_error(F.lit("NaN is no key")).cast("double")).when(key == 0, F.lit(0.0)).otherwise(key))


def printed(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def to_text(a: DataFrame, key: Callable[[Column], Column] = printed, value: Callable[[Column], Column] = printed) -> DataFrame:
    """One row (text): {k v, k v}, by key; ``key`` and ``value`` print them."""
    items = F.array_sort(F.collect_list(F.struct("key", "value")))
    shown = F.transform(items, lambda x: F.concat_ws(" ", key(x["key"]), value(x["value"])))
    return a.agg(F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}")).alias("text"))


def split(a: DataFrame, parts: int) -> DataFrame:
    """Adds ``part``, by hash of the key."""
    return a.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))


def split_range(a: DataFrame, parts: int) -> DataFrame:
    """Adds ``part``: ranges of keys in ascending order, nulls first, of sizes that differ by one at most."""
    ranked = positions(a, "key")
    n = F.lit(max(1, ranked.count()))
    return ranked.withColumn("part", F.floor(F.col("idx") * parts / n).cast("int")).drop("idx")
