"""Cutting lineage in iterative operators, and reading plans."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset: a temporary one on a local master, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
    return named or tempfile.mkdtemp(prefix="checkpoints-")


def checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and goes on from the written copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as Parquet: a fraction of the bytes, and its size tells Spark which tables it can broadcast."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nodes(df: DataFrame) -> Counter:
    """How often each physical operator stands in the plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return Counter(re.findall(r"[A-Z]\w+(?=[ \n(\[])", text))
