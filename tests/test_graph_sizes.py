"""Graph operators against plain Python, and how their work grows."""

import random

from collectra.operators import traverse
from collectra.operators.graph import Graph


def graph(spark, pairs, directed=True):
    return Graph.of(spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, value int"), directed=directed)


def reached(pairs, start):
    found, todo = {start}, [start]
    while todo:
        v = todo.pop()
        more = {b for a, b in pairs if a == v} - found
        found |= more
        todo += more
    return found


def test_closing_against_plain_search(spark):
    rng = random.Random(1)
    up = {tuple(sorted(rng.sample(range(12), 2))) for _ in range(16)}
    name = dict(zip(range(12), rng.sample(range(12), 12), strict=True))
    ring = {(a, (a + 1) % 5) for a in range(5)} | {(4, 7), (7, 8), (9, 0)}
    wanted = [(a, b) for a in range(13) for b in range(13)]
    ask = spark.createDataFrame(wanted, "src long, dst long")
    for pairs, directed in ((up, True), ({(name[a], name[b]) for a, b in up}, True), (ring, True), (up, False)):
        walk = pairs if directed else pairs | {(b, a) for a, b in pairs}
        want = {(a, b): a in reached(walk, b) for a, b in wanted}
        got = {(r.src, r.dst): r.closes for r in traverse.closing(graph(spark, pairs, directed), ask).collect()}
        assert got == want


def test_closing_searches_only_open_pairs(spark, monkeypatch):
    searches = []
    monkeypatch.setattr(traverse, "levels", lambda g: searches.append(1))
    chain = graph(spark, [(k, k + 1) for k in range(30)])
    ask = spark.createDataFrame([(k + 1, k) for k in range(30)] + [(k, k + 1) for k in range(30)], "src long, dst long")
    found = {(r.src, r.dst): r.closes for r in traverse.closing(chain, ask).collect()}
    assert found == {**{(k + 1, k): True for k in range(30)}, **{(k, k + 1): False for k in range(30)}} and not searches


def least(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    walk = {(a, b) for a in near for b in near[a]}
    return {v: min(reached(walk, v)) for v in near}


def test_components_pass_on_two_edges_a_vertex(spark, monkeypatch):
    given, stars = [], traverse.stars
    monkeypatch.setattr(traverse, "stars", lambda links: given.append(links.count()) or stars(links))
    whole = [(a, b) for a in range(40) for b in range(a)]
    assert {r.component for r in traverse.connected_components(graph(spark, whole, False)).collect()} == {0}
    assert given and max(given) <= 80


def test_components_that_least_and_greatest_neighbours_leave_apart(spark):
    rng = random.Random(2)
    # Two cliques over {0..9, 30..39}, interleaved; their one link is between middle neighbours.
    a, b = [*range(0, 5), *range(30, 35)], [*range(5, 10), *range(35, 40)]
    pairs = {(x, y) for c in (a, b) for x in c for y in c if x < y} | {(4, 5), (50, 51), (60, 60)}
    middle = {(x, y) for base in (100, 200) for x in range(base, base + 9) for y in range(x + 1, base + 9)} | {(108, 200), (103, 204)}
    some = {tuple(sorted(rng.sample(range(300, 400), 2))) for _ in range(70)}
    for g in (pairs, middle, some):
        got = {r.id: r.component for r in traverse.connected_components(graph(spark, g, False)).collect()}
        assert got == least(g)


def test_parts_are_joined_by_an_edge_between_middle_neighbours(spark):
    wings = {(0, 10), (0, 11), (10, 90), (11, 91), (90, 99), (91, 99)} | {(1, 20), (1, 21), (20, 80), (21, 81), (80, 98), (81, 98), (20, 79)}
    pairs = {(0, 50), (50, 99), (1, 51), (51, 98), (50, 51)} | wings  # 50: 0, 51, 99; 51: 1, 50, 98
    edges = spark.createDataFrame(sorted(pairs), "a long, b long")
    assert {r.node: r.component for r in traverse.labelled(edges).collect()} == least(pairs)
    assert set(least(pairs).values()) == {0}


def test_blocks_climb_a_row_a_vertex(spark, monkeypatch):
    given, stars = [], traverse.stars
    monkeypatch.setattr(traverse, "stars", lambda links: given.append(links.count()) or stars(links))
    whole = [(a, b) for a in range(40) for b in range(a)] + [(39, 40), (40, 41)]
    found = {}
    for r in traverse.biconnected_components(graph(spark, whole, False)).collect():
        found.setdefault(r.block, set()).add(r.id)
    assert sorted(map(sorted, found.values())) == [list(range(40)), [39, 40], [40, 41]]
    assert given and max(given) <= 84


def test_ascending_edges_are_acyclic_in_one_pass(spark, monkeypatch):
    peeled, levels = [], traverse.levels
    monkeypatch.setattr(traverse, "levels", lambda g: peeled.append(1) or levels(g))
    assert traverse.is_acyclic(graph(spark, [(k, k + 1) for k in range(30)])) and not peeled
    assert traverse.is_acyclic(graph(spark, [(2, 1), (1, 3)])) and not traverse.is_acyclic(graph(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])) and len(peeled) == 2


def test_split_passes_on_two_edges_a_vertex(spark, monkeypatch):
    given, stars = [], traverse.stars
    monkeypatch.setattr(traverse, "stars", lambda links: given.append(links.count()) or stars(links))
    whole = [(base + a, base + b) for base in (0, 50) for a in range(40) for b in range(a)]
    rows = traverse.split(graph(spark, whole, False))[1].collect()
    assert {(r.component, r.src, r.dst) for r in rows} == {(a // 50 * 50, min(a, b), max(a, b)) for a, b in whole} and len(rows) == len(whole)
    assert given and max(given) <= 160
