"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, ranked, table, uniform, words_count

#: Times a document may be taken.
MOST = 3


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) -> with ``weight`` and ``target``; the table has a row a source.

    Weights are 1, 2, 3, 1, ... in code-point order, null last. Sorted by cap / weight, the capped
    sources are a prefix; what is left is shared by weight among the others. That is where resharing
    the excess again and again ends.
    """
    w = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    s = sources.withColumn("weight", ((w - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size").cast("double") * MOST)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(past), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    fits = F.max(F.when(F.col("level") <= F.col("ratio"), F.lit(1)).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("target", F.when(fits == 1, F.least(F.col("weight") * F.coalesce(first, level), F.col("cap"))).otherwise(F.col("cap")))
    return s.select("source", "source_size", "weight", "target")


def fill(sizes: list[int], counts: list[int], budget: int, reserve: int = 65536) -> list[int]:
    """How many of ``counts[i]`` items of ``sizes[i]`` to take so that the sizes sum to ``budget``, or just below.

    All but ``reserve`` of the budget is spent in proportion, from the longest length down; the rest
    goes by bounded-knapsack dynamic programming over the items left, shortest first: bit s of
    ``reach`` says that sum s can be made, and the bitsets before each step give the way back. The
    bitsets have at most about ``reserve`` plus the greatest size bits.
    """
    order = sorted((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: -sizes[i])
    taken = [0] * len(sizes)
    total = sum(sizes[i] * counts[i] for i in order)
    budget = max(0, min(budget, total))
    left, rest = max(0, budget - reserve), total
    for i in order:
        k = min(counts[i], counts[i] * left // rest if rest else 0)
        taken[i], left, rest = k, left - k * sizes[i], rest - counts[i] * sizes[i]
    want = budget - sum(taken[i] * sizes[i] for i in order)
    reach, mask, steps = 1, (1 << (want + 1)) - 1, []
    for i in reversed(order):
        if reach >> want & 1:
            break
        spare, piece = min(counts[i] - taken[i], want // sizes[i]), 1
        while spare > 0:
            piece = min(piece, spare)
            steps.append((i, piece, reach))
            reach = (reach | reach << piece * sizes[i]) & mask
            spare, piece = spare - piece, piece * 2
    at = reach.bit_length() - 1
    for i, piece, old in reversed(steps):
        if not old >> at & 1:
            taken[i] += piece
            at -= piece * sizes[i]
    return taken


def plan(group: pd.DataFrame) -> pd.DataFrame:
    """One source's (size, n) -> ``base`` takes of every document and one more for ``more`` of the n."""
    total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    base = min(MOST, int(target // total)) if total else 0
    budget = round(target - base * total) if base < MOST else 0
    order = group.sort_values("size")
    more = fill(order["size"].tolist(), order["n"].tolist(), budget)
    return order.assign(base=base, more=more)[["source", "size", "n", "source_size", "target", "base", "more"]]


def planned_for(rows: DataFrame, planned: DataFrame, share: int = 1000) -> DataFrame:
    """``rows`` with their (source, size)'s plan.

    A length that more than one in ``share`` rows have is a hot key; there are less than ``share`` of them, so they
    are broadcast, and only the others' rows are dealt by key.
    """
    total = planned.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(planned.where(F.col("_n") * share > F.lit(total)))
    rest = planned.where(F.col("_n") * share <= F.lit(total))

    def same(side: DataFrame):
        return rows["source"].eqNullSafe(side["_s"]) & (rows["size"] == side["_z"])

    return rows.join(hot, same(hot)).unionByName(rows.join(hot, same(hot), "left_anti").join(rest, same(rest)))


def mix(docs: DataFrame, sizes: DataFrame, seed: int = 17, ties: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies`` (0 to 3) to ``docs``, which has ``source`` and ``size``.

    ``sizes`` is a cheap (source, size) table of the same rows. What each source's length counts say is fitted
    to its target in one small task a source (its input: a row a distinct length); which documents of a length are
    taken once more is decided by seeded rank over the ``ties`` columns, which should tell rows apart: rows alike
    in all of them are ranked in one task, in no fixed order. Null source: a source of its own, last in order. Null
    size: 0. Documents of size 0 are taken as often as the source's base. Repeated rows are documents of their own.
    All columns of ``docs`` are kept (names that start with an underscore and one letter are taken); an empty table
    gives an empty one.
    """
    by_size = sizes.groupBy("source", F.coalesce("size", F.lit(0)).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    by_source = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    told = targets(by_source).select(F.col("source").alias("_s"), "source_size", "target")
    wide = by_size.join(told, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    planned = wide.groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, base int, more long")
    planned = cut(planned).select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("n").alias("_n"), "source_size", "target", F.col("base").alias("_base"), F.col("more").alias("_more"))
    kept = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    rows = planned_for(docs.select(*kept).withColumn("size", F.coalesce("size", F.lit(0))), planned).withColumn("_u", uniform(seed, *[F.col(c) for c in ties]))
    chosen = ranked(rows, ["_s", "_z"], "_u", list(ties), "_n", "_rank")
    copies = (F.col("_base") + F.when(F.col("_rank") < F.col("_more"), 1).otherwise(0)).cast("int")
    return chosen.select(*kept, "source_size", "target", copies.alias("copies"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = cut(docs.select(F.col("doc_id").cast("long"), "source", words_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")))
    mixed = mix(sizes, sizes, ties=("doc_id", "text_hash"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
