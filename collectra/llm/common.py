"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, shared_folder  # noqa: F401

#: Word pattern of the size and shingle contracts: runs of anything but ASCII white space.
SPACE_SPLIT = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: int, *cols: Column) -> Column:
    """A seeded 62-bit number that looks random, the same on every run."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 62) - 1))


def scaled(u: Column, n: Column) -> Column:
    """The bucket 0..n-1 of ``u`` (62 bits, as of ``uniform``), in the order of ``u``; n below 2^31."""
    return F.least(F.floor(u.cast("double") * n.cast("double") / F.lit(float(1 << 62))).cast("long"), n - 1)


def identity(*columns: str) -> Column:
    """A number that rows with other values in these columns don't share (but for one pair in 2^64); nulls are values."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def once(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with one row for each value of ``keys``, nulls too; ``counted`` is a cheap table of the same rows' keys.

    Only rows whose key repeats are shuffled.
    """
    names = [f"_{k}" for k in keys]
    often = counted.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("_often")).where("_often > 1")
    often = cut(often.drop("_often"))
    if often.isEmpty():
        return rows
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return rows.join(often, same, "left_anti").unionByName(rows.join(often, same, "left_semi").dropDuplicates(keys))


def before(counts: DataFrame, group: list[str], bucket: str, n: str, out: str, block: int = 1024) -> DataFrame:
    """Adds ``out``: the sum of ``n`` over smaller buckets of the group.

    Two levels, so that one group's buckets never meet in one task: sums by blocks of ``block``
    buckets, running sums over the blocks, then running sums inside each block.
    """
    blocked = counts.withColumn("_block", F.floor(F.col(bucket) / block))
    sums = blocked.groupBy(*group, "_block").agg(F.sum(n).alias("_sum"))
    over = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(over), F.lit(0)))
    keys = [*group, "_block"]
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    joined = blocked.join(sums, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    inner = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(n).over(inner), F.lit(0))).select(*counts.columns, out)


def ranked(df: DataFrame, group: list[str], u: str, ties: list[str], n: str, out: str, bucket_rows: int = 64) -> DataFrame:
    """Adds ``out``: the 0-based rank in the group by ``u`` (as of ``uniform``), then ``ties``.

    ``n`` is the group's row count. A group is dealt by ``u`` into buckets of about ``bucket_rows``
    rows; a row's rank is the count of rows in earlier buckets plus its place in its own. So a group
    may hold any share of all rows: no task sorts more than buckets of it. Only rows with the same
    ``u`` (repeats of one row) stay together. Rows are shuffled once: the counts reach them as a
    marker row in each bucket. ``df`` is read twice, once for the counts. Its columns stay; names that
    start with an underscore are taken.
    """
    dealt = df.withColumn("_bucket", scaled(F.col(u), F.greatest(F.lit(1), F.ceil(F.col(n) / bucket_rows))))
    keys = [*group, "_bucket"]
    counts = before(dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), group, "_bucket", "_n", "_earlier")
    markers = counts.select(*keys, F.col("_earlier").cast("long"), F.lit(0).alias("_mark"))
    both = dealt.withColumns({"_earlier": F.lit(None).cast("long"), "_mark": F.lit(1)}).unionByName(markers, allowMissingColumns=True)
    over = Window.partitionBy(*keys).orderBy("_mark", u, *ties)
    placed = both.withColumn("_place", F.first("_earlier").over(over.rowsBetween(Window.unboundedPreceding, 0)) + F.row_number().over(over) - 2)
    return placed.where("_mark = 1").withColumn(out, F.col("_place").cast("long")).select(*df.columns, out)
