"""A live map: micro-batches of edits merged into a written table, generation by generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..operators import maps


class LiveMap:
    """``folder/<n>`` holds the map after batch n; a batch that is run again writes the same generation."""

    def __init__(self, folder: str, merge: Callable[[Column, Column], Column] | None = None):
        self.folder, self.merge, self.last = folder, merge, None

    def apply(self, edits: DataFrame, batch: int) -> None:
        """For ``writeStream.foreachBatch``; edits are (key, value, seq)."""
        spark = edits.sparkSession
        before = spark.read.parquet(f"{self.folder}/{batch - 1}") if batch else spark.createDataFrame([], edits.select("key", "value").schema)
        maps.put(before, edits, self.merge).write.mode("overwrite").parquet(f"{self.folder}/{batch}")
        self.last = batch

    def read(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{self.last}")
