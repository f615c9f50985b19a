"""Graphs as two tables: vertices (id) and edges (src, dst, value), one edge a pair.

A directed graph keeps pairs as they are; an undirected one keeps (least, greatest).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import maps


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    @staticmethod
    def of(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True, merge: Callable[[Column], Column] = F.max) -> Graph:
        """From edge rows; parallel edges are merged by an aggregate. Endpoints become vertices."""
        src, dst = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
        one = edges.groupBy(src.alias("src"), dst.alias("dst")).agg(merge(F.col("value")).alias("value"))
        ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
        return Graph((ends if vertices is None else ends.unionByName(vertices)).distinct(), one, directed)

    def both_ways(self) -> DataFrame:
        """Edges in each direction in which they can be walked."""
        if self.directed:
            return self.edges
        turned = self.edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value")
        return self.edges.unionByName(turned)


def edge(g: Graph, pairs: DataFrame, default: Column) -> DataFrame:
    """``pairs`` (src, dst) with ``value``: the edge's, or ``default`` where there is none."""
    side = g.both_ways().select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.struct("value").alias("_e"))
    got = pairs.join(side, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left")
    return got.select("src", "dst", F.when(F.col("_e").isNotNull(), F.col("_e.value")).otherwise(default).alias("value"))


def edge_strict(g: Graph, pairs: DataFrame) -> DataFrame:
    """As ``edge``; a pair without an edge raises when the row is read."""
    side = g.both_ways().select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.struct("value").alias("_e"))
    got = pairs.join(side, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left")
    return got.select("src", "dst", F.when(F.col("_e").isNull(), F.raise_error(F.lit("no such edge"))).otherwise(F.col("_e.value")).alias("value"))


def out(g: Graph) -> DataFrame:
    """(id, neighbours: sorted array); isolated vertices have an empty one. A row holds one vertex's neighbours."""
    lists = g.both_ways().groupBy(F.col("src").alias("_i")).agg(F.array_sort(F.collect_set("dst")).alias("_n"))
    return g.vertices.join(lists, F.col("id") == F.col("_i"), "left").select("id", F.coalesce("_n", F.array().cast(lists.schema["_n"].dataType)).alias("neighbours"))


def in_(g: Graph) -> DataFrame:
    return out(transpose(g))


def link(g: Graph, edges: DataFrame, merge: Callable[[Column, Column], Column] | None = None) -> Graph:
    """Adds edges (src, dst, value) and their endpoints; ``merge(old, new)`` on a pair that is there."""
    return merge_graphs(g, Graph.of(edges, directed=g.directed), merge)


def unlink(g: Graph, pairs: DataFrame) -> Graph:
    """Takes edges out; endpoints stay."""
    if not g.directed:
        pairs = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return Graph(g.vertices, g.edges.join(pairs.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "value"), g.directed)


def add_vertices(g: Graph, ids: DataFrame) -> Graph:
    return Graph(g.vertices.unionByName(ids).distinct(), g.edges, g.directed)


def remove_vertices(g: Graph, ids: DataFrame) -> Graph:
    """Takes vertices and their edges out."""
    kept = g.edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return Graph(g.vertices.join(ids, "id", "left_anti"), kept.select("src", "dst", "value"), g.directed)


def select(g: Graph, ids: DataFrame) -> Graph:
    """The induced subgraph; unknown ids are ignored."""
    kept = g.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return Graph(g.vertices.join(ids, "id", "left_semi"), kept.select("src", "dst", "value"), g.directed)


def replace(g: Graph, a: object, b: object, merge: Callable[[Column], Column] = F.max) -> Graph:
    """Renames a to b; edges that fall together are merged by an aggregate."""
    swap = lambda c: F.when(F.col(c) == F.lit(a), F.lit(b)).otherwise(F.col(c))
    moved = g.edges.select(swap("src").alias("src"), swap("dst").alias("dst"), "value")
    return Graph.of(moved, g.vertices.select(swap("id").alias("id")), g.directed, merge)


def transpose(g: Graph) -> Graph:
    return g if not g.directed else Graph(g.vertices, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value"), True)


def merge_graphs(a: Graph, b: Graph, f: Callable[[Column, Column], Column] | None = None) -> Graph:
    """Vertices of both; ``f(left, right)`` on shared edges (by default the right's)."""
    if a.directed != b.directed:
        raise ValueError("a directed and an undirected graph do not merge")
    pair = F.struct("src", "dst").alias("key")
    both = maps.merge(a.edges.select(pair, "value"), b.edges.select(pair, "value"), f or (lambda x, y: y))
    return Graph(a.vertices.unionByName(b.vertices).distinct(), both.select("key.src", "key.dst", "value"), a.directed)


def map_edges(g: Graph, f: Callable[[Column, Column, Column], Column]) -> Graph:
    return Graph(g.vertices, g.edges.withColumn("value", f(F.col("src"), F.col("dst"), F.col("value"))), g.directed)


def equals(a: Graph, b: Graph) -> DataFrame:
    """One row (equal)."""
    pair = F.struct("src", "dst").alias("key")
    edges = maps.equals(a.edges.select(pair, "value"), b.edges.select(pair, "value"))
    ids = a.vertices.exceptAll(b.vertices).unionByName(b.vertices.exceptAll(a.vertices)).agg((F.count(F.lit(1)) == 0).alias("_v"))
    return edges.crossJoin(ids).select((F.col("equal") & F.col("_v") & F.lit(a.directed == b.directed)).alias("equal"))  # one row each


def hash_(g: Graph) -> DataFrame:
    """One row (hash), whatever the order of rows; equal graphs have equal hashes."""
    rows = g.vertices.select(F.xxhash64(F.lit(0), "id").alias("h")).unionByName(g.edges.select(F.xxhash64(F.lit(1), "src", "dst", "value").alias("h")))
    return rows.agg(F.xxhash64(F.lit(g.directed), F.coalesce(F.bit_xor("h"), F.lit(0))).alias("hash"))


def top(g: Graph) -> DataFrame:
    """Vertices without an edge into them."""
    return g.vertices.join(g.edges.select(F.col("dst").alias("id")), "id", "left_anti")


def bottom(g: Graph) -> DataFrame:
    return g.vertices.join(g.edges.select(F.col("src").alias("id")), "id", "left_anti")
