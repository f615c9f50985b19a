"""Graph algorithms as loops of joins; every round is written and so survives lost executors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, stored
from .graph import Graph, link
from .positions import positions
from .thin import gathered_near, thinned


class CycleError(ValueError):
    """The graph has a cycle."""


def gathered(tables: list[DataFrame]) -> DataFrame:
    """The union of written tables; every sixteenth time they are written as one, so plans stay small."""
    if len(tables) >= 16:
        tables[:] = [cut(reduce(DataFrame.unionByName, tables))]
    return reduce(DataFrame.unionByName, tables)


def bfs_levels(starts: DataFrame, adjacent: Callable[[DataFrame], DataFrame] | DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, level) of what is reachable from ``starts`` (id), by rounds of the frontier.

    ``adjacent`` is an edge table, written once, or a function of the frontier (id) that returns its edges (src, dst).
    A round writes its frontier only. It ends as every round finds new vertices or stops; for a function over
    endlessly many ``max_rounds`` may be set, beyond which it raises.
    """
    edges = None if callable(adjacent) else cut(adjacent.select(F.col("src").alias("id"), "dst"))
    found = [cut(starts.select("id").distinct().withColumn("level", F.lit(0)))]
    for level in count(1):
        if max_rounds is not None and level > max_rounds:
            raise RuntimeError(f"not done in {max_rounds} rounds")
        frontier = found[-1] if len(found) == 1 and level == 1 else last
        own = edges if edges is not None else adjacent(frontier.select("id")).select(F.col("src").alias("id"), "dst")
        step = frontier.join(own, "id").select(F.col("dst").alias("id")).distinct()
        last = cut(step.join(gathered(found), "id", "left_anti").withColumn("level", F.lit(level)))
        if last.isEmpty():
            return gathered(found)
        found.append(last)


def stars(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``links`` (a, b) -> (node, component): the least node reachable from each linked node.

    Self links and nulls say nothing and are dropped; an empty table gives an empty one. Large-star and
    small-star rounds: every step is a minimum a node (combined before the shuffle) and an equi-join that
    AQE may split, so a hub with any share of the links does not meet in one task. Rounds grow with the
    logarithm of the longest path, so ``max_rounds`` is out of reach; hitting it raises.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    for _ in range(max_rounds):
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == mark or not now[0]:
            ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return ends.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        mark = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def undirected(g: Graph) -> Graph:
    if g.directed:
        raise ValueError("components are of undirected graphs")
    return g


def numbered(g: Graph, blocks: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, n), n in the order of the ids, and edges between different ones as numbers (a, b), a < b, written once.

    Only edges that keep the components, with ``blocks`` also these, are numbered: each task thins out its own before any
    join. Minima of numbers are combined by hash where those of strings are sorted, and a row is a third of the size.
    """
    few = stored(thinned(undirected(g).edges, blocks))
    names = stored(positions(stored(g.vertices), F.asc_nulls_first("id"), out="n"))
    a, b = names.select(F.col("id").alias("src"), F.col("n").alias("a")), names.select(F.col("id").alias("dst"), F.col("n").alias("b"))
    return names, stored(few.join(a, "src").join(b, "dst").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def turned(edges: DataFrame) -> DataFrame:
    """Edges (a, b) in both directions."""
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def labelled(edges: DataFrame) -> DataFrame:
    """(node, component) as ``stars`` gives them, by few passes over many edges (a, b).

    Each task finds the parts that its own edges form, named by their least vertex. Vertices that lie in several parts join
    these; only the parts' names, as a rule few, go through rounds.
    """
    links = stored(thinned(gathered_near(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))))
    own = links.select(F.col("src").alias("node"), F.col("dst").alias("part")).unionByName(links.select(F.col("dst").alias("node"), F.col("dst").alias("part")).distinct())
    ends = stored(own.groupBy("node").agg(F.min("part").alias("component"), F.max("part").alias("_most")))
    several = ends.where("component <> _most").select("node", "component")
    between = stored(own.join(several, "node").where("part <> component").select(F.col("part").alias("a"), F.col("component").alias("b")).distinct())
    joined = stars(between).select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return stored(ends.join(joined, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component")))


def connected_components(g: Graph) -> DataFrame:
    """(id, component): the least vertex of each component. Directed graphs are refused."""
    return components(Graph(g.vertices, gathered_near(undirected(g).edges), False))


def components(g: Graph) -> DataFrame:
    """``connected_components`` of edges as they lie."""
    names, edges = numbered(g)
    own = names.join(labelled(edges), F.col("n") == F.col("node"), "left").select("id", F.coalesce("component", "n").alias("_c"))
    return own.join(names.select(F.col("id").alias("component"), F.col("n").alias("_c")), "_c").select("id", "component")


def levels(g: Graph) -> DataFrame:
    """(id, level) by peeling: level 0 has no edge into it, level n + 1 only from levels up to n. A cycle raises.

    Every round takes a level off or raises, so it ends. The edges are written once; a round writes how many edges into
    each vertex are left.
    """
    if not g.directed:
        raise ValueError("levels are of directed graphs")
    edges, found = stored(g.edges.select("src", "dst")), []
    waiting = stored(edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")))
    free = stored(g.vertices.join(waiting, "id", "left_anti").select("id", F.lit(0).alias("level")))
    for level in count(1):
        if free.isEmpty():
            break
        found.append(free)
        met = free.select(F.col("id").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("_met"))
        left = stored(waiting.join(met, "id", "left").select("id", (F.col("n") - F.coalesce("_met", F.lit(0))).alias("n")))
        free, waiting = left.where("n = 0").select("id", F.lit(level).alias("level")), left.where("n > 0")
        gathered(found)
    if not waiting.isEmpty():
        raise CycleError("the graph has a cycle")
    return gathered(found) if found else g.vertices.withColumn("level", F.lit(0))


def ascends(edges: DataFrame) -> bool:
    """Whether every edge goes to a greater vertex. Then so does every way, and none comes back."""
    return edges.where(~F.coalesce(F.col("src") < F.col("dst"), F.lit(False))).isEmpty()


def is_acyclic(g: Graph) -> bool:
    """Edges that all ascend close no cycle, which one pass tells; other graphs are peeled."""
    if not g.directed:
        raise ValueError("only directed graphs are tested for cycles")
    edges = stored(g.edges.select("src", "dst"))
    if ascends(edges):
        return True
    try:
        levels(Graph(edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct(), edges))
    except CycleError:
        return False
    return True


def dag(g: Graph) -> Graph:
    """The graph itself if it is directed and has no cycle; raises otherwise."""
    if not is_acyclic(g):
        raise CycleError("the graph has a cycle")
    return g


def dag_link(g: Graph, edges: DataFrame, merge: Callable[[Column, Column], Column] | None = None) -> Graph:
    """``link`` on a graph without cycles; raises if the edges close one."""
    return dag(link(g, edges, merge))


def closing(g: Graph, pairs: DataFrame) -> DataFrame:
    """``pairs`` (src, dst) with ``closes``: whether linking them would close a cycle, as dst reaches src (or is it).

    In an undirected graph that is to lie in one component. In a directed one most pairs need no search: their ends
    are alike, an edge leads from dst to src, or all edges ascend and dst is greater. The others are searched from all
    dst at once, only over vertices whose level is no deeper than the deepest src that is wanted of that dst, and a dst
    stops when all its pairs are found. Such a search can still visit any vertex from any dst.
    """
    known = stored(pairs.select("src", "dst").distinct())
    if not g.directed:
        ids = stored(connected_components(g))
        a, b = ids.select(F.col("id").alias("src"), F.col("component").alias("_a")), ids.select(F.col("id").alias("dst"), F.col("component").alias("_b"))
        return known.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", F.coalesce((F.col("src") == F.col("dst")) | (F.col("_a") == F.col("_b")), F.lit(False)).alias("closes"))
    edges = stored(g.edges.select("src", "dst"))
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("_edge")).distinct()
    back = F.lit(ascends(edges)) & (F.col("dst") > F.col("src"))
    known = stored(known.join(against, ["src", "dst"], "left").select("src", "dst", F.when((F.col("src") == F.col("dst")) | F.col("_edge"), True).when(back, False).alias("closes")))
    found = searched(g, edges, known.where("closes is null").select("src", "dst"))
    if found is None:
        return known.select("src", "dst", F.coalesce("closes", F.lit(False)).alias("closes"))
    return known.join(found.withColumn("_hit", F.lit(True)), ["src", "dst"], "left").select("src", "dst", F.coalesce("closes", "_hit", F.lit(False)).alias("closes"))


def searched(g: Graph, edges: DataFrame, pairs: DataFrame) -> DataFrame | None:
    """Those ``pairs`` (src, dst) of which dst reaches src; None where there are no pairs to search."""
    if pairs.isEmpty():
        return None
    try:
        level, below = stored(levels(g)), "low < top"
    except CycleError:
        level, below = stored(g.vertices.withColumn("level", F.lit(0))), "true"
    tops, lows = level.select(F.col("id").alias("src"), F.col("level").alias("top")), level.select(F.col("id").alias("dst"), F.col("level").alias("low"))
    left = stored(pairs.join(tops, "src").join(lows, "dst").where(below).select("src", "dst", "top"))
    onward = stored(edges.join(lows, "dst").select("src", "dst", "low"))
    frontier = stored(left.select(F.col("dst").alias("origin"), F.col("dst").alias("id")).distinct())
    seen, hits = [frontier], [left.select("src", "dst").limit(0)]
    while not left.isEmpty() and not frontier.isEmpty():
        wanted = left.groupBy(F.col("dst").alias("origin")).agg(F.max("top").alias("top"))
        step = frontier.join(wanted, "origin").join(onward, F.col("id") == F.col("src")).where("low <= top").select("origin", F.col("dst").alias("id")).distinct()
        frontier = stored(step.join(gathered(seen), ["origin", "id"], "left_anti"))
        seen.append(frontier)
        hit = stored(left.join(frontier.select(F.col("origin").alias("dst"), F.col("id").alias("src")), ["src", "dst"], "left_semi").select("src", "dst"))
        hits.append(hit)
        left = stored(left.join(hit, ["src", "dst"], "left_anti"))
    return gathered(hits)


def split(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, component) and edges (component, src, dst, value): pieces that share nothing. Directed graphs are refused."""
    edges = stored(gathered_near(undirected(g).edges))
    ids = stored(components(Graph(g.vertices, edges, False)))
    own = ids.select(F.col("id").alias("_i"), "component")
    return ids, edges.join(own, F.col("src") == F.col("_i")).select("component", "src", "dst", "value")


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, colour): what each colour's seed (id, colour) reaches over edges inside one ``_g``."""
    found = [cut(seeds)]
    frontier = found[0]
    while not frontier.isEmpty():
        step = frontier.join(edges, frontier["id"] == edges["src"]).where("colour = _g").select(F.col("dst").alias("id"), "colour").distinct()
        frontier = cut(step.join(gathered(found), ["id", "colour"], "left_anti"))
        found.append(frontier)
    return gathered(found)


def strongly_connected(g: Graph, singletons: bool = True, small: int = 200_000) -> DataFrame:
    """(id, component): the least vertex of each strongly connected component.

    Vertices without edges in or out of their part are peeled off as components of their own. A
    remainder of at most ``small`` edges (counted) is solved in one task; a larger one by colouring:
    every vertex takes the greatest vertex that reaches it, and what reaches back to that one inside
    the colour is its component. Each loop runs until nothing changes, however long the paths are (a round an
    edge of the longest). Undirected graphs are refused.
    """
    if not g.directed:
        raise ValueError("strong components are of directed graphs")
    edges = cut(g.edges.where("src <> dst").select("src", "dst"))
    found: list[DataFrame] = []
    n = edges.count()
    while n > small:
        trimmed = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, n = n, trimmed.count()
        if n < before:
            edges = trimmed
            continue
        colour, moved = cut(edges.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id"))), True
        while moved:
            pushed = edges.join(colour, edges["src"] == colour["id"]).groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("p"))
            after = cut(colour.join(pushed, "id", "left").select("id", F.greatest("colour", "p").alias("colour"), (F.col("p") > F.col("colour")).alias("moved")))
            colour, moved = after.select("id", "colour"), not after.where("moved").isEmpty()
        a, b = colour.select(F.col("id").alias("src"), F.col("colour").alias("_g")), colour.select(F.col("id").alias("dst"), F.col("colour").alias("_h"))
        inside = cut(edges.join(a, "src").join(b, "dst").where("_g = _h").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "_g"))
        part = reach(inside, colour.where("id = colour"))
        ids = part.groupBy("colour").agg(F.min("id").alias("component"))
        found.append(cut(part.join(ids, "colour").select("id", "component")))
        gone = found[-1].select("id")
        edges = cut(edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
        n = edges.count()
    none = edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    found.append(edges.groupBy(F.lit(0).alias("_one")).applyInPandas(tarjan_group(edges), edges_schema(edges)) if n else none)
    named = reduce(DataFrame.unionByName, found).select(F.col("id").alias("_i"), F.col("component").alias("_c"))
    out = g.vertices.join(named, F.col("id") == F.col("_i"), "left").select("id", F.coalesce("_c", "id").alias("component"))
    if singletons:
        return out
    many = out.groupBy(F.col("component").alias("_c")).count().where("count > 1").select("_c")
    return out.join(many, F.col("component") == F.col("_c"), "left_semi")


def edges_schema(edges: DataFrame) -> str:
    kind = edges.schema["src"].dataType.simpleString()
    return f"id {kind}, component {kind}"


def tarjan_group(_: DataFrame) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        for s, d in zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True):
            after.setdefault(s, []).append(d)
            after.setdefault(d, [])
        number, low, stack, on, rows = {}, {}, [], set(), []
        for root in after:
            if root in number:
                continue
            number[root] = low[root] = len(number)
            stack.append(root)
            on.add(root)
            work = [(root, iter(after[root]))]
            while work:
                v, rest = work[-1]
                for w in rest:
                    if w not in number:
                        number[w] = low[w] = len(number)
                        stack.append(w)
                        on.add(w)
                        work.append((w, iter(after[w])))
                        break
                    if w in on:
                        low[v] = min(low[v], number[w])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[v])
                    if low[v] == number[v]:
                        members = []
                        while not members or members[-1] != v:
                            members.append(stack.pop())
                            on.discard(members[-1])
                        rows += [(m, min(members)) for m in members]
        return pd.DataFrame(rows, columns=["id", "component"])

    return run


def strongly_connected_edges(g: Graph, singletons: bool = True) -> DataFrame:
    """(component, src, dst, value): the edges inside each strong component."""
    c = strongly_connected(g, singletons)
    a, b = c.select(F.col("id").alias("src"), "component"), c.select(F.col("id").alias("dst"), F.col("component").alias("_d"))
    return g.edges.join(a, "src").join(b, "dst").where("component = _d").select("component", "src", "dst", "value")


def cycles(g: Graph, max_paths: int | None = None) -> DataFrame:
    """(path: array): every elementary cycle once, from its least vertex back to it; a self-loop is [v, v].

    Paths grow only inside strong components and only over vertices greater than their start, so they end. There may
    be exponentially many; with ``max_paths``, over so many open paths raise.
    """
    inside = cut(strongly_connected_edges(g, False).select("src", "dst").where("src <> dst"))
    found = [g.edges.where("src = dst").select(F.array("src", "dst").alias("path"))]
    paths = cut(inside.where("dst > src").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path")))
    while n := paths.count():
        if max_paths is not None and n > max_paths:
            raise RuntimeError(f"over {max_paths} open paths")
        grown = cut(paths.join(inside, paths["last"] == inside["src"]).where("dst >= first").select("first", "dst", "path"))
        found.append(grown.where("dst = first").select(F.concat("path", F.array("dst")).alias("path")))
        paths = cut(grown.where("dst > first and not array_contains(path, dst)").select("first", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path")))
    return reduce(DataFrame.unionByName, found)


def shortest_path(g: Graph, starts: DataFrame, accept: Column, cost: Column) -> DataFrame:
    """(cost, path) of the cheapest path of one edge or more from a start (id) to a vertex that ``accept`` (over id) takes.

    ``cost`` is over src, dst, value; below zero it raises. Ties go to the least path. No path: no row.
    Unknown starts are ignored. Each round relaxes the frontier and keeps the least (dist, path) a vertex, so it ends:
    a round in which nothing gets better is the last.
    """
    priced = g.both_ways().select("src", "dst", cost.cast("double").alias("_w"))
    weight = F.when(F.col("_w") < 0, F.raise_error(F.lit("a cost is below zero")).cast("double")).otherwise(F.col("_w"))
    edges = cut(priced.select("src", "dst", weight.alias("_w")))
    known = starts.join(g.vertices, "id", "left_semi").distinct()
    frontier = cut(known.select("id", F.lit(0.0).alias("dist"), F.array("id").alias("path")))
    best = None
    while True:
        step = frontier.join(edges, frontier["id"] == edges["src"]).where(~F.array_contains(F.expr("slice(path, 2, size(path))"), F.col("dst")))
        step = step.select(F.col("dst").alias("id"), (F.col("dist") + F.col("_w")).alias("dist"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("id").agg(F.min(F.struct("dist", "path")).alias("new"))
        if best is None:
            frontier = cut(step.select("id", "new.dist", "new.path"))
            best = frontier
        else:
            old = best.select(F.col("id").alias("_i"), F.struct("dist", "path").alias("old"))
            better = step.join(old, F.col("id") == F.col("_i"), "left").where("old is null or new < old")
            frontier = cut(better.select("id", "new.dist", "new.path"))
            best = cut(best.join(frontier.select("id"), "id", "left_anti").unionByName(frontier))
        if frontier.isEmpty():
            return best.where(accept).agg(F.min(F.struct("dist", "path")).alias("b")).where("b is not null").select(F.col("b.dist").alias("cost"), F.col("b.path").alias("path"))


def trees(edges: DataFrame, parts: DataFrame) -> list[DataFrame]:
    """A breadth-first tree of each component (node, component) of the edges (a, b), from its least vertex: (id, parent, level), a table a level."""
    found = [stored(parts.where("node = component").select(F.col("node").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("level")))]
    both, seen = turned(edges), list(found)
    while True:
        step = found[-1].select(F.col("id").alias("a")).join(both, "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"), F.lit(len(found)).alias("level"))
        last = stored(step.join(gathered(seen), "id", "left_anti"))
        if last.isEmpty():
            return found
        found.append(last)
        seen.append(last)


def blocks(g: Graph) -> DataFrame:
    """(component, block, id, cut_vertex): the biconnected blocks' vertices. A block is named by one of its vertices; an isolated vertex is in none.

    In a breadth-first tree no other edge joins a vertex with one above it. Then all edges outside the tree that hang
    together lie in one block (Cong and Bader, 2005), and with them the tree edges between their ends: what these ends
    pass as they climb until they meet. So one row a vertex climbs, not one an edge. A class of ends takes a round a
    level of the tree and stops at the vertex where all of it has met; blocks are classes that share a tree edge.
    """
    names, edges = numbered(Graph(g.vertices, gathered_near(undirected(g).edges), False), blocks=True)
    parts = labelled(edges)
    by_level = trees(edges, parts)
    tree = stored(gathered(list(by_level)))
    limbs = tree.where("parent is not null").select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))
    classes = labelled(stored(edges.join(limbs, ["a", "b"], "left_anti").select("a", "b"))).select(F.col("node").alias("id"), F.col("component").alias("class"))
    ends = stored(classes.join(tree, "id").select("id", "class", "level"))
    ends = stored(ends.join(ends.groupBy("class").agg(F.min("level").alias("top")), "class").select("id", "class", "level", "top"))
    links, climbed = [ends.select(F.col("id").alias("a"), F.col("class").alias("b")).limit(0)], None
    begun = {r.level for r in ends.select("level").distinct().collect()}
    for level in range(len(by_level) - 1, 0, -1):
        if level not in begun and climbed is None:
            continue
        here = ends.where(F.col("level") == level).select("id", "class", "top")
        if climbed is not None:
            here = here.unionByName(climbed.select(F.col("parent").alias("id"), "class", "top")).distinct()
        met = here.groupBy("class").agg((F.count(F.lit(1)) == 1).alias("_met"))
        going = here.join(met, "class").where((F.col("top") < level) | ~F.col("_met"))
        climbed = stored(going.join(by_level[level].select("id", "parent"), "id").select("id", "class", "top", "parent"))
        links.append(climbed.select(F.col("id").alias("a"), (-1 - F.col("class")).alias("b")))
        gathered(links)
        climbed = None if climbed.isEmpty() else climbed
    shared = stored(labelled(gathered(links)).where("node >= 0"))
    least = shared.groupBy("component").agg(F.min("node").alias("_b"))
    named = shared.join(least, "component").select(F.col("node").alias("id"), "_b")
    own = tree.where("parent is not null").join(named, "id", "left").withColumn("block", F.coalesce("_b", "id"))
    members = own.select("block", "id").unionByName(own.select("block", F.col("parent").alias("id")))
    members = stored(members.distinct())
    cuts = members.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("cut_vertex"))
    found = members.join(cuts, "id").join(parts.select(F.col("node").alias("id"), "component"), "id")
    for column in ("component", "block", "id"):
        found = found.withColumnRenamed(column, "n").join(names.select("n", F.col("id").alias(f"_{column}")), "n").drop("n")
    return found.select(F.col("_component").alias("component"), F.col("_block").alias("block"), F.col("_id").alias("id"), "cut_vertex")


def biconnected_components(g: Graph) -> DataFrame:
    """(component, block, id)."""
    return blocks(g).select("component", "block", "id")


def articulation_points(g: Graph) -> DataFrame:
    """(id): vertices whose removal parts their component."""
    return blocks(g).where("cut_vertex").select("id").distinct()
