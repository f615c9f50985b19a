"""Text by Unicode code point, as column expressions; UTF-16 and UTF-8 views where they differ."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def size(s: Column) -> Column:
    return F.length(s)


Place = Column | int


def placed(i: Place) -> Column:
    return i if isinstance(i, Column) else F.lit(i)


def guarded(s: Column, bad: Column, value: Column) -> Column:
    """``value``, or an error where the place is bad; a null text stays null."""
    return F.when(s.isNotNull() & bad, F.raise_error(F.lit("the place is out of the text"))).otherwise(value)


def nth(s: Column, i: Place, strict: bool = False, default: int | None = None) -> Column:
    """The code point at i; out of range: ``default``, or an error if ``strict``. A null text stays null."""
    i = placed(i)
    found = F.when((i >= 0) & (i < F.length(s)), F.ascii(F.substring(s, i + 1, F.lit(1)))).when(s.isNotNull(), F.lit(default).cast("int"))
    return guarded(s, (i < 0) | (i >= F.length(s)), found) if strict else found


def insert(s: Column, i: Place, t: Column) -> Column:
    """``t`` before code point i; i = size appends; other places raise."""
    i = placed(i)
    return guarded(s, (i < 0) | (i > F.length(s)), F.overlay(s, t, i + 1, F.lit(0)))


def remove(s: Column, start: Place, end: Place) -> Column:
    """Without [start, end); a range that is turned or leaves the text raises."""
    start, end = placed(start), placed(end)
    return guarded(s, (start < 0) | (end < start) | (end > F.length(s)), F.overlay(s, F.lit(""), start + 1, end - start))


def slice_(s: Column, start: Place, end: Place) -> Column:
    """[start, end); a range that is turned or leaves the text raises."""
    start, end = placed(start), placed(end)
    return guarded(s, (start < 0) | (end < start) | (end > F.length(s)), F.substring(s, start + 1, end - start))


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def reverse(s: Column) -> Column:
    return F.reverse(s)


def code_points(s: Column) -> Column:
    """Array of code points; empty for an empty text."""
    return F.when(F.length(s) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(s, ""), F.ascii))


def utf16_units(s: Column) -> Column:
    """Array of UTF-16 units, as positive numbers."""
    pair = lambda c: F.array(F.shiftright(c - 65536, 10) + 55296, (c - 65536).bitwiseAND(F.lit(1023)) + 56320)
    return F.flatten(F.transform(code_points(s), lambda c: F.when(c < 65536, F.array(c)).otherwise(pair(c))))


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units: code points, and one more for each of four UTF-8 bytes."""
    return F.length(s) + F.regexp_count(s, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def from_utf16(units: Column) -> Column:
    """The text of an array of UTF-16 units."""
    return F.decode(F.unhex(F.array_join(F.transform(units, lambda u: F.lpad(F.hex(u), 4, "0")), "")), "UTF-16BE")


def from_code_points(points: Column) -> Column:
    """The text of an array of code points."""
    pair = lambda c: F.array(F.shiftright(c - 65536, 10) + 55296, (c - 65536).bitwiseAND(F.lit(1023)) + 56320)
    return from_utf16(F.flatten(F.transform(points, lambda c: F.when(c < 65536, F.array(c)).otherwise(pair(c)))))


def char_at(s: Column, i: int) -> Column:
    """The UTF-16 unit at i; out of range raises."""
    units = utf16_units(s)
    return guarded(s, F.lit(i < 0) | (F.lit(i) >= F.size(units)), F.get(units, F.lit(i)))


def sub_sequence(s: Column, start: int, end: int) -> Column:
    """UTF-16 units [start, end) as a text; a bad range raises."""
    units = utf16_units(s)
    bad = F.lit(start < 0 or end < start) | (F.lit(end) > F.size(units))
    return guarded(s, bad, from_utf16(F.slice(units, start + 1, end - start)))


def chunks(df: DataFrame, keys: list[str], column: str, size: int = 4096) -> DataFrame:
    """(keys, idx, text): the texts in pieces of ``size`` code points; an empty text is one empty piece, a null none."""
    s = F.col(column)
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(s) / size).cast("int") - 1))
    pieces = F.transform(at, lambda k: F.substring(s, k * size + 1, F.lit(size)))
    return df.where(s.isNotNull()).select(*keys, F.posexplode(pieces).alias("idx", "text"))


def joined(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): the inverse of ``chunks``; a row holds one text."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda p: p["text"])
    return pieces.groupBy(*keys).agg(F.array_join(parts, "").alias("text"))


def utf8(s: Column) -> Column:
    return F.encode(s, "utf-8")


def order(s: Column) -> list[Column]:
    """Sort keys: shorter first, then by UTF-8 bytes."""
    return [F.length(s), s]


@F.pandas_udf(LongType())
def one_at_a_time(s: pd.Series) -> pd.Series:
    """The 32-bit one-at-a-time hash of the UTF-8 bytes, unsigned; all texts of a batch advance together."""
    data = [x.encode() if x is not None else b"" for x in s]
    lengths = np.array([len(d) for d in data], np.int64)
    flat, starts = np.frombuffer(b"".join(data), np.uint8), np.cumsum(lengths) - lengths
    h = np.zeros(len(data), np.uint32)
    turn = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[turn], -np.arange(1, lengths.max(initial=0) + 1), "right")
    for k, n in enumerate(active.tolist()):
        rows = turn[:n]
        x = h[rows] + flat[starts[rows] + k].astype(np.uint32)
        x += x << np.uint32(10)
        h[rows] = x ^ (x >> np.uint32(6))
    h += h << np.uint32(3)
    h ^= h >> np.uint32(11)
    h += h << np.uint32(15)
    return pd.Series(h.astype(np.int64)).where(s.notna(), None).astype("Int64")
