"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ranked, table, uniform


def shard(docs: DataFrame, shards: int = 16, seed: int = 23, ties: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``shard`` (0 .. shards - 1) and ``slot`` (gapless from 0 in each shard) to ``docs``.

    Rows are shuffled by seed inside their source; row r of n has the fractional rank (2 r + 1) / 2 n.
    In the order of fractional ranks every stretch has the mixture of the whole, so cutting it into
    ``shards`` equal stretches gives shards whose row counts differ by one at most and whose source
    counts follow the mixture. Both ranks come from counts over buckets (see ``ranked``), so one source
    may hold any share of the rows. Null source: a source of its own. ``ties`` should tell rows apart: rows
    alike in all of these columns are placed next to each other, in one task and in no fixed order. Fewer rows than shards: some shards are empty. Empty
    table: no rows. All columns of ``docs`` are kept; ``shard`` and ``slot`` are overwritten.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("source", "_s")
    counts = cut(counts)
    total = counts.agg(F.sum("_n")).first()[0] or 0
    rows = docs.select(*kept).join(counts, F.col("source").eqNullSafe(F.col("_s")))
    rows = rows.withColumn("_u", uniform(seed, *[F.col(c) for c in ties]))
    inside = ranked(rows, ["_s"], "_u", list(ties), "_n", "_rank")
    fraction = (2 * F.col("_rank") + 1) / (2.0 * F.col("_n"))
    keyed = inside.withColumns({"_f": F.floor(fraction * F.lit(float(1 << 62))).cast("long"), "_all": F.lit(0), "_total": F.lit(total).cast("long")})
    placed = ranked(keyed, ["_all"], "_f", [F.asc_nulls_last("_s")], "_total", "_at")
    number = F.expr(f"(_at * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(((_at * {shards}L) div {max(total, 1)}L) * {total}L + {shards - 1}L) div {shards}L")
    return placed.select(*kept, number.cast("int").alias("shard"), (F.col("_at") - first).cast("long").alias("slot"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.encode("text", "utf-8"), F.lit(b""))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long"), "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")
    )
    placed = shard(cut(docs), 16, ties=("doc_id", "size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
