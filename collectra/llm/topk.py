"""Exact top-k inner products, pruned by segment means and deviations from coarse to fine.

For a segment of m components, q.x = m mean(q) mean(x) + (q - mean(q)).(x - mean(x)), and the second
term is at most m dev(q) dev(x). Summed over segments that bounds the score from above (and, with
|q|^2 + |x|^2 - 2 q.x, the squared distance from below). Bounds over 1, 4 and 16 segments are dot
products of 2, 8 and 32 numbers; only candidates whose bound reaches the query's k-th best score so far
go to the next level, and survivors get their exact integer score, the best-bounded first. What that saves
depends on the vectors: neighbours much nearer than the rest let bounds cut, random directions don't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SEGMENTS = (1, 4, 16)


def integers(vector: Column) -> Column:
    """floor(1024 * x) of every component; null where the vector or a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(x * F.lit(1024.0)).cast("long")))


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """(rows, 2 * segments): means and deviations of each segment, times the root of its length."""
    out = []
    for part in np.array_split(rows.astype(np.float64), segments, axis=1):
        if part.shape[1]:
            m = part.shape[1] ** 0.5
            out += [part.mean(axis=1) * m, part.std(axis=1) * m]
    return np.stack(out, axis=1) if out else np.zeros((len(rows), 1))


class Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, n: int, k: int):
        self.score, self.ids, self.floor = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n, np.full(n, -np.inf)
        self.k = k

    def add(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        ids, score = np.concatenate([self.ids[q], ids]), np.concatenate([self.score[q], score])
        order = np.lexsort((ids, -score))[: self.k]
        self.ids[q], self.score[q] = ids[order], score[order]
        if len(order) == self.k:
            self.floor[q] = score[order[-1]]


def search(queries: tuple[np.ndarray, np.ndarray], ids: np.ndarray, rows: np.ndarray, best: Best, levels: list[np.ndarray]) -> int:
    """Scores ``rows`` against all queries, a tile of rows at a time, into ``best``; returns how many exact scores that took.

    In a tile a query's survivors are taken by falling bound: the k best-bounded first, which raise its floor, then
    those of the others that still reach it.
    """
    qid, qrows = queries
    exact, tile = 0, max(64, min(512, (1 << 22) // max(1, len(qid))))
    for at in range(0, len(rows), tile):
        own, mine = ids[at : at + tile], rows[at : at + tile]
        alive, bound = qid[:, None] != own[None, :], np.full((len(qid), len(own)), np.inf)
        for segments, stat in zip(SEGMENTS, levels, strict=True):
            need, use = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            if not len(need) or not len(use):
                break
            slack = 1e-9 * np.abs(stat[need]).sum(axis=1, keepdims=True) * (1 + np.abs(mine[use]).max(initial=0)) + 1e-6
            here = np.ix_(need, use)
            bound[here] = np.minimum(bound[here], stat[need] @ statistics(mine[use], segments).T + slack)
            alive[here] &= bound[here] >= best.floor[need][:, None]
        for q in np.flatnonzero(alive.any(axis=1)):
            c = np.flatnonzero(alive[q])
            if len(c) > best.k:
                c = c[np.argsort(-bound[q, c], kind="stable")]
                best.add(q, own[c[: best.k]], mine[c[: best.k]] @ qrows[q])
                exact += best.k
                c = c[best.k :]
                c = c[bound[q, c] >= best.floor[q]]
            best.add(q, own[c], mine[c] @ qrows[q])
            exact += len(c)
    return exact


def by_size(ids: np.ndarray, lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, rows as a matrix) by number of components."""
    offsets = lists.offsets.to_numpy()
    flat, lengths = lists.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    found = {}
    for size in np.unique(lengths).tolist():
        pick = np.flatnonzero(lengths == size)
        found[size] = ids[pick], flat[offsets[pick][:, None] + np.arange(size)]
    return found


def collected(block: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The block's distinct (id, vector) on the driver, by number of components."""
    got = block.toArrow().combine_chunks()
    if not got.num_rows:
        return {}
    lists = got.column(1).chunk(0).cast(pa.list_(pa.int64()))
    out = {}
    for size, (ids, rows) in by_size(got.column(0).to_numpy(), lists).items():
        both = np.unique(np.concatenate([ids[:, None], rows], axis=1), axis=0)
        out[size] = both[:, 0].copy(), both[:, 1:].copy()
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query, ties to the lesser id.

    Both tables have (vec_id, vector: array of long, null where it takes no part). Candidates are all rows
    with another id and as many components; rows with a null id or vector take no part. A query id that
    repeats with the same vector is one query; with another vector, the best of both count. Queries are
    taken in blocks of about ``block_bytes`` (ids and components), dealt by hash of the id; a block is collected
    and broadcast, and meets every candidate. A task returns at most k rows a query and partition. Fewer
    candidates: fewer rows. Empty tables: no rows. Scores outside 64 bits are not defined. Other columns,
    whatever their names, are left out.
    """
    spark = vectors.sparkSession
    usable = vectors.where("vec_id is not null and vector is not null").select(F.col("vec_id").cast("long"), "vector")
    asked = queries.where("vec_id is not null and vector is not null").select(F.col("vec_id").cast("long"), "vector")
    total = asked.agg(F.sum(8 * F.size("vector") + 8)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    parts = []
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(collected(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = {s: (q, Best(len(q[0]), k), [statistics(q[1], x) for x in SEGMENTS]) for s, q in shared.value.items()}
            for batch in batches:
                for size, (ids, rows) in by_size(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)).items():
                    if size in held:
                        q, best, levels = held[size]
                        search(q, ids, rows, best, levels)
            for q, best, _ in held.values():
                count = [len(x) for x in best.ids]
                if sum(count):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(q[0], count)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.score))], ["query_id", "vec_id", "score"]
                    )

        parts.append(usable.mapInArrow(run, "query_id long, vec_id long, score long"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), integers(F.col("embedding")).alias("vector"))
    return top_k(rows, rows.where("vec_id % 100 = 0"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
