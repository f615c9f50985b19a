"""The same collections inside a row: ARRAY and MAP columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Map columns: ``f`` only where both have the key, whatever the values."""
    def pick(k: Column, x: Column, y: Column) -> Column:
        return F.when(~F.map_contains_key(a, k), y).when(~F.map_contains_key(b, k), x).otherwise(f(x, y))

    return F.map_zip_with(a, b, pick)


def union(a: Column, b: Column) -> Column:
    """Map columns: the right side wins, also with a null value."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def difference(a: Column, b: Column) -> Column:
    """Entries of ``a`` whose key is not in ``b``, whatever the values."""
    return F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))


def intersection(a: Column, b: Column) -> Column:
    """Entries of ``a`` whose key is in ``b``; left values stay."""
    return F.map_filter(a, lambda k, _: F.map_contains_key(b, k))


def contains_all(a: Column, b: Column) -> Column:
    return F.forall(F.map_keys(b), lambda k: F.map_contains_key(a, k))


def contains_any(a: Column, b: Column) -> Column:
    return F.exists(F.map_keys(b), lambda k: F.map_contains_key(a, k))


def put(m: Column, k: Column, v: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(k, v))


def remove(m: Column, k: Column) -> Column:
    return F.map_filter(m, lambda x, _: x != k)


def get(m: Column, k: Column, default: Column) -> Column:
    return F.when(F.map_contains_key(m, k), F.try_element_at(m, k)).otherwise(default)


def map_values(m: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.transform_values(m, f)


def map_text(m: Column) -> Column:
    """k=v pairs by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",")


def array_slice(a: Column, start: int, end: int) -> Column:
    return F.slice(a, start + 1, max(0, end - start))


def array_insert(a: Column, i: int, v: Column) -> Column:
    return F.array_insert(a, i + 1, v)


def array_remove_at(a: Column, i: int) -> Column:
    return F.filter(a, lambda _, k: k != i)


def array_set(a: Column, i: int, v: Column) -> Column:
    return F.transform(a, lambda x, k: F.when(k == i, v).otherwise(x))
