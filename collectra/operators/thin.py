"""Few edges in place of many, between which the same vertices hang together: found in a task, without a shuffle.

A graph's components stay if in each part of its edges a component's vertices are joined to one of them. Its blocks are those of a breadth-first
forest of each part together with a spanning forest of that part's other edges (Cheriyan, Kao and Thurimella, 1993;
Eppstein, Galil, Italiano and Nissenzweig, 1997): an edge (u, v) left out has a way from u to v in the second forest, and
where that passes a vertex x, x's neighbours on it lie beside x in the first, so they meet in it without x. So no
vertex parts what it didn't part before, whatever other edges there are. At most two edges a vertex of a part are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROWS, BYTES = 2_000_000, 256 << 20  # edges that a task holds at a time; what is left of them goes on with those that follow


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a spanning forest of the edges (a, b) between vertices 0 to n - 1, and a vertex's component, named by one of its vertices.

    Every component takes its first edge to another one, all at once, so rounds grow with the logarithm of n.
    """
    label, kept, left = np.arange(n), [np.empty(0, np.int64)], np.arange(len(a))
    while True:
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return np.concatenate(kept), label
        first, rows = np.full(n, len(left)), np.arange(len(left))
        np.minimum.at(first, x, rows)
        np.minimum.at(first, y, rows)
        own = np.flatnonzero(first < len(left))
        edge = first[own]
        other = x[edge] + y[edge] - own
        up = np.arange(n)
        up[own] = other
        mutual = own[(up[other] == own) & (own < other)]  # both took the same edge
        up[mutual] = mutual
        while not np.array_equal(further := up[up], up):
            up = further
        label = up[label]
        kept.append(left[np.unique(edge)])


def heads(label: np.ndarray) -> np.ndarray:
    """The least vertex of each vertex's component."""
    n = len(label)
    least = np.full(n, n)
    np.minimum.at(least, label, np.arange(n))
    return least[label]


def breadth_first(keys: np.ndarray, n: int) -> np.ndarray:
    """Of edges a * n + b (a < b, each once, in order) those of a breadth-first forest, from the least vertex of each component."""
    a, b = np.divmod(keys, n)
    _, label = forest(a, b, n)
    front, tree = np.unique(heads(label)), [np.empty(0, np.int64)]
    near, to = np.divmod(np.sort(np.concatenate([keys, b * n + a])), n)
    start = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=n))])
    seen = np.zeros(n, bool)
    seen[front] = True
    while len(front):
        many = start[front + 1] - start[front]
        at = np.arange(many.sum()) + np.repeat(start[front] - (np.cumsum(many) - many), many)
        by, found = np.repeat(front, many), to[at]
        new = ~seen[found]
        front, once = np.unique(found[new], return_index=True)
        parent = by[new][once]
        seen[front] = True
        tree.append(np.minimum(parent, front) * n + np.maximum(parent, front))
    return np.concatenate(tree)


def lasting(edges: pa.Table, blocks: bool) -> pa.Table:
    """For ``edges`` (src, dst), ends different: of every vertex but one of each component an edge to that one, the least if ids
    are numbers; with ``blocks`` those edges that keep these."""
    ids = pa.chunked_array([*edges["src"].chunks, *edges["dst"].chunks]).combine_chunks().dictionary_encode()
    names, codes = ids.dictionary, ids.indices.to_numpy().astype(np.int64)
    n = len(names)
    if pa.types.is_integer(names.type):
        order = np.argsort(names.to_numpy())
    if blocks or not pa.types.is_integer(names.type):
        order = np.argsort(-np.bincount(codes, minlength=n), kind="stable")  # vertices of many edges first, which makes trees flat
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    a, b = rank[codes[: len(edges)]], rank[codes[len(edges) :]]
    if blocks:
        keys = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
        tree = breadth_first(keys, n)
        others = np.delete(keys, np.searchsorted(keys, tree))
        dst, src = np.divmod(np.concatenate([tree, others[forest(*np.divmod(others, n), n)[0]]]), n)
    else:
        dst = heads(forest(a, b, n)[1])
        src = np.flatnonzero(dst != np.arange(n))
        dst = dst[src]
    return pa.table({"src": names.take(pa.array(order[src])), "dst": names.take(pa.array(order[dst]))}, schema=edges.schema)


def thinner(blocks: bool, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n >= rows or size >= BYTES:
                held = lasting(pa.Table.from_batches(held), blocks).to_batches()
                n, size = sum(x.num_rows for x in held), sum(x.nbytes for x in held)
                if 2 * n >= rows or 2 * size >= BYTES:
                    yield from held
                    held, n, size = [], 0, 0
        if n:
            yield from lasting(pa.Table.from_batches(held), blocks).to_batches()

    return run


def thinned(edges: DataFrame, blocks: bool = False, rows: int = ROWS) -> DataFrame:
    """Edges (src, dst) with the components of the given ones, loops left out; with ``blocks`` some of the given, with the same blocks too.

    Every edge is read. How few are left depends on how edges of near vertices lie together; ``gathered_near`` sees to that.
    Ids other than whole numbers, plain strings, binaries and dates are compared by Spark only, so their edges stay.
    """
    edges = edges.where("src <> dst").select("src", "dst")
    kinds = [edges.schema[x].dataType for x in ("src", "dst")]
    if kinds[0] != kinds[1] or not (isinstance(kinds[0], T.IntegralType | T.BinaryType | T.DateType) or kinds[0] == T.StringType()):
        return edges
    return edges.mapInArrow(thinner(blocks, rows), edges.schema)


def gathered_near(edges: DataFrame) -> DataFrame:
    """Edges dealt by ranges of src and dst: a hub's lie in several tasks, and a task sees few vertices beside many edges."""
    return edges.repartitionByRange("src", "dst")
