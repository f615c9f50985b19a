"""Few edges in place of many: the same components and blocks as a plain search finds, and how many are left."""

import random
from functools import partial

import pyarrow as pa

from collectra.operators import thin, traverse
from collectra.operators.graph import Graph


def graph(spark, pairs, kind="long"):
    return Graph.of(spark.createDataFrame([(a, b, 1) for a, b in pairs], f"src {kind}, dst {kind}, value int"), directed=False)


def labels(near, without=None):
    found = {}
    for start in sorted(near):
        if start == without or start in found:
            continue
        found[start], todo = start, [start]
        while todo:
            for w in near[todo.pop()]:
                if w != without and w not in found:
                    found[w] = start
                    todo.append(w)
    return found


def together(pairs):
    """Components, and the pairs of vertices that share a block: adjacent, or parted by no third vertex."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    whole, parted = labels(near), {x: labels(near, x) for x in near}
    alike = {(u, v) for u in near for v in near if u < v and whole[u] == whole[v]}
    return whole, {(u, v) for u, v in alike if v in near[u] or all(parted[x][u] == parted[x][v] for x in near if x not in (u, v))}


def test_thinned_edges_keep_components_and_blocks():
    rng = random.Random(5)
    for kind in (int, str):
        for _ in range(150):
            n = rng.randrange(2, 14)
            pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(1, 3 * n))})
            rng.shuffle(pairs)
            at = rng.randrange(len(pairs) + 1)
            for blocks in (True, False):
                kept = []
                for part in (pairs[:at], pairs[at:]):
                    table = pa.table({"src": [kind(a) for a, _ in part], "dst": [kind(b) for _, b in part]}) if part else None
                    for out in thin.thinner(blocks, rng.choice((4, 10, 1000)))(iter(table.to_batches(max_chunksize=3) if part else [])):
                        kept += [(int(a), int(b)) for a, b in zip(out["src"].to_pylist(), out["dst"].to_pylist(), strict=True)]
                want, got = together(pairs), together(kept)
                assert want[0] == got[0] and (not blocks or want[1] == got[1])


def test_blocks_and_components_in_many_parts_against_plain_search(spark, monkeypatch):
    monkeypatch.setattr(traverse, "thinned", partial(thin.thinned, rows=5))
    rng = random.Random(8)
    pairs = {tuple(sorted(rng.sample(range(base, base + 16), 2))) for base in (0, 14, 100) for _ in range(24)} | {(200, 201), (201, 202), (300, 301)}
    whole, share = together(pairs)
    loops = graph(spark, pairs | {(7, 7), (400, 400)})
    assert {r.id: r.component for r in traverse.connected_components(loops).collect()} == whole | {400: 400}
    found = {}
    for r in traverse.biconnected_components(loops).collect():
        found.setdefault(r.block, set()).add(r.id)
        assert r.component == whole[r.id]
    assert {(u, v) for block in found.values() for u in block for v in block if u < v} == share


def test_ids_that_tasks_do_not_compare(spark):
    pairs = [(0.5, 1.5), (1.5, 2.5), (0.5, 2.5), (7.0, 8.0)]
    assert {r.id: r.component for r in traverse.connected_components(graph(spark, pairs, "double")).collect()} == together(pairs)[0]


def test_trees_of_blocks_get_two_edges_a_vertex(spark, monkeypatch):
    given, trees = [], traverse.trees
    monkeypatch.setattr(traverse, "trees", lambda edges, parts: given.append(edges.count()) or trees(edges, parts))
    whole = [(a, b) for a in range(40) for b in range(a)] + [(39, 40), (40, 41)]
    assert {r.id for r in traverse.articulation_points(graph(spark, whole)).collect()} == {39, 40}
    assert given and max(given) <= 80


def test_split_sends_few_links_through_rounds(spark, monkeypatch):
    given, numbered, stars = [], [], traverse.stars
    labelled = traverse.labelled
    monkeypatch.setattr(traverse, "labelled", lambda edges: numbered.append(edges.count()) or labelled(edges))
    monkeypatch.setattr(traverse, "stars", lambda links: given.append(links.count()) or stars(links))
    whole = [(base + a, base + b) for base in (0, 50) for a in range(40) for b in range(a)]
    rows = traverse.split(graph(spark, whole))[1].collect()
    assert {(r.component, r.src, r.dst) for r in rows} == {(a // 50 * 50, min(a, b), max(a, b)) for a, b in whole} and len(rows) == len(whole)
    assert given and max(given) <= 16 and numbered and max(numbered) <= 160
