"""From raw documents to shards: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents and
nothing else, whatever other columns there are. Null and empty texts, ties and repeated rows are as each stage
says; an empty table gives an empty one in all of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collectra.llm import decontaminate, mixing, nearcopies, quality, sharding
from collectra.llm.common import cut, identity, once, shared_folder, table, words_count

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and ``key``; (doc_id, key) is the same for rows alike in all columns only."""
    return docs.select(*COLUMNS, identity(*COLUMNS).alias("key"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go; it learns from the labels of ``docs``.

    A row is judged by its text alone: null and empty texts by the model's bias (kept if that is 0 or more), repeated
    rows alike. Labels of a null doc_id are not learnt from; without any, all rows score 0.5 and stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a five-word Jaccard similarity of 0.8 or more one row stays, the least doc_id.

    Null doc_ids come last; rows that share a doc_id are told apart by their other columns, and of rows alike in all
    columns one stays. Null and wordless texts are copies of each other.
    """
    rows = keyed(docs)
    found = nearcopies.near_copies(rows, tie=F.col("key"))
    found = cut(found.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("tie") == F.col("component_tie"))))
    gone = found.where("not stays").select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t")).distinct()
    gone = F.broadcast(gone) if found.where("not stays").count() <= 500_000 else gone
    kept = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_t")), "left_anti")
    return once(kept, found.where("stays").select("doc_id", F.col("tie").alias("key")), ["doc_id", "key"]).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an occurrence of a benchmark window go. Null and wordless texts stay; repeated rows fare alike."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is repeated as often as the mix takes it (0 to 3 times).

    Rows alike in all columns are taken as often, all together, as the mix takes them. Null texts have size 0, as
    empty ones, and are taken as often as their source's base; null sources are one source.
    """
    sized = keyed(docs).withColumn("size", words_count(F.col("text")))
    small = cut(sized.select("doc_id", "source", "size", "key"))
    copies = mixing.mix(small, small, ties=("doc_id", "key")).where("copies > 0")
    copies = cut(copies.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.sum("copies").cast("int").alias("copies")))
    copies = F.broadcast(copies) if copies.count() <= 500_000 else copies
    distinct = once(sized, small, ["doc_id", "key"])
    taken = distinct.join(copies, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard and slot. Null sources are one source; rows alike in all columns get slots of their own."""
    rows = keyed(docs)
    small = cut(rows.select("doc_id", "source", "key"))
    placed = sharding.shard(small, 16, ties=("doc_id", "key")).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "shard", "slot")
    placed = F.broadcast(cut(placed)) if small.count() <= 500_000 else placed
    found = once(rows, small, ["doc_id", "key"]).join(placed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")))
    return found.select(*COLUMNS, "shard", "slot")


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can't express a trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what stands between them is written under spark.checkpoint.dir."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
