"""Bits of 64-bit numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lowest_bit(n: Column) -> Column:
    return n.bitwiseAND(-n)


def log2_floor(n: Column) -> Column:
    """For n > 0; exact. Other n raise."""
    n = F.when(n <= 0, F.raise_error(F.lit("no logarithm of a number below 1"))).otherwise(n)
    return F.length(F.bin(n)) - 1


def log2_ceil(n: Column) -> Column:
    return log2_floor(n) + F.when(is_power_of_two(n), 0).otherwise(1)


def highest_bit(n: Column) -> Column:
    """0 for 0."""
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), log2_floor(n)))


def is_power_of_two(n: Column) -> Column:
    return F.bit_count(n) == 1


def bit_offset(n: Column) -> Column:
    """The position of a single bit."""
    return log2_floor(n)


def test(n: Column, b: int) -> Column:
    return F.bit_get(n, F.lit(b)) == 1


def mask_below(b: int) -> int:
    return (1 << b) - 1


def mask_above(b: int) -> int:
    return ~((1 << b) - 1)


def slice_(n: Column, start: int, end: int) -> Column:
    """Bits [start, end) as a number."""
    if not 0 <= start < end <= 64:
        raise ValueError("0 <= start < end <= 64")
    shifted = F.shiftrightunsigned(n, start)
    return shifted if end - start == 64 else shifted.bitwiseAND(F.lit((1 << (end - start)) - 1).cast("long"))


def branching_bit(a: Column, b: Column) -> Column:
    """The highest differing bit; -1 if equal."""
    return F.when(a == b, -1).otherwise(F.length(F.bin(a.bitwiseXOR(b))) - 1)


def interleave(values: list[Column], bits: int) -> Column:
    """Morton key: bit b of value i at place b * len(values) + i. Keys of over 63 bits are refused."""
    if bits * len(values) > 63:
        raise ValueError("a key has at most 63 bits")
    out = F.lit(0).cast("long")
    for b in range(bits):
        for i, v in enumerate(values):
            out = out + F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1).cast("long")), b * len(values) + i)
    return out


def positions(n: Column) -> Column:
    """Ascending positions of the set bits."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.bit_get(n, i) == 1)


def rank(n: Column, mask: Column) -> Column:
    """How many bits of n lie below the (single) bit ``mask``."""
    return F.bit_count(n.bitwiseAND(mask - 1))


def insertion_point(sorted_: Column, v: Column) -> Column:
    """Position in a sorted array; -(place + 1) if absent."""
    at = F.array_position(sorted_, v)
    return F.when(at > 0, at - 1).otherwise(-(F.size(F.filter(sorted_, lambda x: x < v)) + 1)).cast("long")


def add_sorted(sorted_: Column, v: Column) -> Column:
    return F.array_sort(F.array_union(sorted_, F.array(v)))


def vector_insert(a: Column, i: int, v: Column) -> Column:
    return F.concat(F.slice(a, 1, i), F.array(v), F.slice(a, F.lit(i + 1), F.size(a))) if i else F.array_prepend(a, v)


def vector_remove(a: Column, i: int) -> Column:
    return F.concat(F.slice(a, 1, i), F.slice(a, F.lit(i + 2), F.size(a))) if i else F.slice(a, F.lit(2), F.size(a))


def vector_set(a: Column, i: int, v: Column) -> Column:
    return F.transform(a, lambda x, k: F.when(k == i, v).otherwise(x))


def remove_sorted(sorted_: Column, v: Column) -> Column:
    return F.array_remove(sorted_, v)


def get_sorted(sorted_: Column, i: int) -> Column:
    """The element at i; out of range: null."""
    return F.get(sorted_, F.lit(i))


def vector_create(n: int) -> Column:
    """n zeros."""
    return F.array_repeat(F.lit(0).cast("long"), n)


def vector_overwrite(a: Column, i: int, values: Column) -> Column:
    """The elements from i on replaced by ``values``; raises where they don't fit."""
    fits = F.size(values) + i <= F.size(a)
    new = F.transform(a, lambda x, k: F.when((k >= i) & (k < F.size(values) + i), F.get(values, k - i)).otherwise(x))
    return F.when(~fits, F.raise_error(F.lit("the values don't fit"))).otherwise(new)


def vector_copy(source: Column, start: int, target: Column, at: int, n: int) -> Column:
    """``target`` with n elements of ``source`` from ``start`` on written over those from ``at`` on."""
    return vector_overwrite(target, at, F.slice(source, start + 1, n))


def vector_interpose(a: Column, i: int, values: Column) -> Column:
    """``values`` put in before element i."""
    return F.concat(F.slice(a, 1, i), values, F.slice(a, F.lit(i + 1), F.size(a)))
