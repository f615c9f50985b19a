"""Semantics that queries on the tables do not reach; several examples a job."""

import random

import pytest
from pyspark.sql import functions as F

from collectra.functions import bits, encodings, nested, text
from collectra.operators import graph, maps, ordered, seq, sets, traverse
from collectra.operators.graph import Graph
from collectra.operators.positions import positions
from collectra.plans.lineage import nodes
from collectra.sources import virtual
from collectra.streaming.edits import LiveMap


def kv(spark, pairs):
    return spark.createDataFrame(pairs, "key long, value string")


def pairs(df):
    return {(r["key"], r["value"]) for r in df.collect()}


def test_merge_passes_left_then_right_and_keeps_nulls(spark):
    a, b = kv(spark, [(1, "a"), (2, None), (None, "n")]), kv(spark, [(1, "b"), (3, None), (None, "m")])
    got = pairs(maps.merge(a, b, lambda x, y: F.concat(x, y)))
    assert got == {(1, "ab"), (2, None), (3, None), (None, "nm")}


def test_union_keeps_a_null_right_value(spark):
    assert pairs(maps.union(kv(spark, [(1, "a"), (2, "b")]), kv(spark, [(1, None)]))) == {(1, None), (2, "b")}


def test_null_value_is_present_null_key_is_a_key(spark):
    m = kv(spark, [(1, None), (None, "x")])
    got = {(r.key, r.value, r.found) for r in maps.get(m, spark.createDataFrame([(1,), (2,), (None,)], "key long"), F.lit("d")).collect()}
    assert got == {(1, None, True), (2, "d", False), (None, "x", True)}


def test_contains_all_probes_the_other_map(spark):
    a, b = kv(spark, [(1, "a")]), kv(spark, [(1, "z"), (2, "z")])
    assert not maps.contains_all(a, b).first()[0] and maps.contains_all(b, a).first()[0]
    assert not maps.contains_any(a, kv(spark, [(9, "z")])).first()[0]
    assert maps.contains_all(a, a.limit(0)).first()[0]


def test_alike_keys_first_key_last_value(spark):
    df = spark.createDataFrame([("A", 1, 1), ("a", 2, 2), ("b", 3, 3)], "k string, v int, o int")
    got = {(r.key, r.value) for r in maps.from_rows_alike(df, F.col("k"), F.col("v"), F.col("o"), F.lower).collect()}
    assert got == {("A", 2), ("b", 3)}


def test_nan_key_is_refused(spark):
    with pytest.raises(Exception, match="NaN"):
        maps.float_keys(spark.createDataFrame([(float("nan"), 1)], "key double, value int")).collect()


def test_order_dependent_fold(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "c", 3)], "k int, v string, o int")
    assert maps.fold(df, F.col("k"), F.col("v"), F.col("o"), F.lit(""), lambda acc, v: F.concat(v, acc)).first()["value"] == "cba"


def test_sets_hold_null_and_one_zero(spark):
    a = sets.of(spark.createDataFrame([(0.0,), (-0.0,), (None,), (None,), (float("nan"),), (float("nan"),)], "x double"), "x")
    assert a.count() == 3
    assert sets.contains_all(a, spark.createDataFrame([(None,)], "value double")).first()[0]


def test_list_model(spark):
    rng = random.Random(5)
    model, s = list("abc"), seq.from_order(spark.createDataFrame([(i, c) for i, c in enumerate("abc")], "o int, v string"), "v", "o")
    for _ in range(8):
        op = rng.choice(["first", "last", "rf", "rl", "set", "slice", "rev"])
        if op == "first":
            model, s = ["x", *model], seq.add_first(s, "x")
        elif op == "last":
            model, s = [*model, "y"], seq.add_last(s, "y")
        elif op == "rf":
            model, s = model[1:], seq.remove_first(s)
        elif op == "rl":
            model, s = model[:-1], seq.remove_last(s)
        elif op == "set":
            i = rng.randint(0, len(model))
            model, s = [*model[:i], "s", *model[i + 1 :]], seq.set_(s, i, "s")
        elif op == "slice" and model:
            model, s = model[: max(1, len(model) - 1)], seq.slice_(s, 0, max(1, len(model) - 1))
        elif op == "rev":
            model, s = model[::-1], seq.reverse(s)
    assert [r.value for r in s.orderBy("idx").collect()] == model
    with pytest.raises(IndexError):
        seq.slice_(s, 0, 99)


def test_split_gives_the_remainder_to_the_last(spark):
    s = virtual.sequence(spark, 10, lambda i: i)
    sizes = {r["part"]: r["count"] for r in seq.split(s, 3).groupBy("part").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 4}


def test_positions_are_dense_and_inverse(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = positions(df, "k").orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(5000)) and [r.k for r in got] == sorted(r.k for r in got)
    assert positions(df.limit(0), "k").count() == 0


def test_bounds_on_exact_hits(spark):
    m = spark.createDataFrame([(1, 10), (3, 30), (5, 50)], "key long, value long")
    p = spark.createDataFrame([(0,), (1,), (2,), (3,), (6,), (None,)], "probe long")
    look = lambda floor, inc: {r.probe: r.key for r in ordered.lookup(m, p, floor, inc).collect()}
    assert look(True, True) == {0: None, 1: 1, 2: 1, 3: 3, 6: 5, None: None}
    assert look(True, False) == {0: None, 1: None, 2: 1, 3: 1, 6: 5, None: None}
    assert look(False, True) == {0: 1, 1: 1, 2: 3, 3: 3, 6: None, None: None}
    assert look(False, False) == {0: 1, 1: 3, 2: 3, 3: 5, 6: None, None: None}


def test_double_encoding_keeps_order(spark):
    xs = [float("-inf"), -1e300, -2.5, -0.0, 0.0, 1e-300, 3.0, float("inf")]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", encodings.double_to_long("x").alias("n")).collect()
    assert [r.n for r in rows] == sorted(r.n for r in rows) and rows[3].n == rows[4].n == 0


def test_text_by_code_point(spark):
    s = "a\u0080ࠀ\U00010000z"
    some = spark.createDataFrame([(s,), ("",), (None,)], "t string")
    within = lambda k: F.least(F.lit(k), F.length(F.col("t")))
    r = some.select(
        text.size(F.col("t")), text.nth(F.col("t"), 3), text.insert(F.col("t"), within(1), F.lit("é")), text.remove(F.col("t"), within(1), within(3)), text.slice_(F.col("t"), within(1), within(4)),
        text.utf16_length(F.col("t")), text.utf16_units(F.col("t")), text.code_points(F.col("t")),
    ).collect()
    assert list(r[0])[:6] == [5, 0x10000, s[:1] + "é" + s[1:], s[:1] + s[3:], s[1:4], 6]
    units = [int.from_bytes(s.encode("utf-16-be")[i : i + 2], "big") for i in range(0, 12, 2)]
    assert r[0][6] == units and r[0][7] == [ord(c) for c in s] and r[1][7] == []


def test_one_at_a_time_hash(spark):
    def model(data):
        h = 0
        for b in data:
            h = (h + b) & 0xFFFFFFFF
            h = (h + (h << 10)) & 0xFFFFFFFF
            h ^= h >> 6
        h = (h + (h << 3)) & 0xFFFFFFFF
        h ^= h >> 11
        return (h + (h << 15)) & 0xFFFFFFFF

    xs = ["", "a", "hello", "é\U00010000", "x" * 300]
    got = spark.createDataFrame([(x,) for x in xs], "t string").select("t", text.one_at_a_time("t").alias("h")).collect()
    assert {r.t: r.h for r in got} == {x: model(x.encode()) for x in xs}


def test_nested_merge_tells_null_from_absent(spark):
    df = spark.range(1).select(F.create_map(F.lit("a"), F.lit(None).cast("int"), F.lit("b"), F.lit(1)).alias("x"), F.create_map(F.lit("a"), F.lit(2)).alias("y"))
    got = df.select(nested.merge(F.col("x"), F.col("y"), lambda p, q: F.coalesce(p, F.lit(0)) + q).alias("m")).first()["m"]
    assert got == {"a": 2, "b": 1}


def test_bit_vector_edits(spark):
    a = F.array(*[F.lit(i) for i in (1, 2, 3)])
    r = spark.range(1).select(bits.vector_insert(a, 1, F.lit(9)), bits.vector_remove(a, 0), bits.vector_set(a, 2, F.lit(7)), bits.insertion_point(a, F.lit(4))).first()
    assert list(r) == [[1, 9, 2, 3], [2, 3], [1, 2, 7], -4]


def edges(spark, rows):
    return spark.createDataFrame([(a, b, 1) for a, b in rows], "src long, dst long, value long")


def test_square_with_opposite_cuts_is_one_block(spark):
    x = Graph.of(edges(spark, [(1, 2), (2, 3), (3, 4), (4, 1), (1, 5), (3, 6)]), directed=False)
    assert {r.id for r in traverse.articulation_points(x).collect()} == {1, 3}
    found = {}
    for r in traverse.biconnected_components(x).collect():
        found.setdefault(r.block, set()).add(r.id)
    assert sorted(map(sorted, found.values())) == [[1, 2, 3, 4], [1, 5], [3, 6]]


def test_undirected_edges_are_symmetric_and_isolated_vertices_stay(spark):
    a = Graph.of(edges(spark, [(2, 1)]), spark.createDataFrame([(9,)], "id long"), directed=False)
    b = Graph.of(edges(spark, [(1, 2)]), spark.createDataFrame([(9,)], "id long"), directed=False)
    assert graph.equals(a, b).first()[0]
    merged = graph.merge_graphs(Graph.of(edges(spark, [(3, 4), (4, 5)]), directed=False), a)
    assert {r.id for r in merged.vertices.collect()} == {1, 2, 3, 4, 5, 9}
    assert {r.id for r in graph.top(Graph(a.vertices, a.edges)).collect()} == {1, 9}


def test_replace_keeps_a_self_loop(spark):
    x = graph.replace(Graph.of(edges(spark, [(1, 1), (1, 2)])), 1, 7)
    assert {(r.src, r.dst) for r in x.edges.collect()} == {(7, 7), (7, 2)} and {r.id for r in x.vertices.collect()} == {2, 7}


def test_bfs_emits_each_vertex_once(spark):
    x = Graph.of(edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)]))
    assert sorted(map(tuple, traverse.bfs_levels(spark.createDataFrame([(1,)], "id long"), x.edges).collect())) == [(1, 0), (2, 1), (3, 1), (4, 2)]


def test_strong_components_by_colouring(spark):
    rng = random.Random(3)
    rows = {(rng.randrange(14), rng.randrange(14)) for _ in range(26)}
    x = Graph.of(edges(spark, rows))
    small = sorted(map(tuple, traverse.strongly_connected(x).collect()))
    assert small == sorted(map(tuple, traverse.strongly_connected(x, small=0).collect()))


def test_cycles_and_self_loops(spark):
    x = Graph.of(edges(spark, [(1, 2), (2, 1), (2, 3), (3, 1), (3, 3)]))
    assert sorted(r.path for r in traverse.cycles(x).collect()) == [[1, 2, 1], [1, 2, 3, 1], [3, 3]]
    with pytest.raises(RuntimeError):
        traverse.cycles(x, max_paths=1)


def test_shortest_path_rules(spark):
    x = Graph.of(spark.createDataFrame([(1, 2, 5), (1, 3, 1), (3, 2, 1), (2, 1, 1)], "src long, dst long, value long"))
    one = spark.createDataFrame([(1,), (99,)], "id long")
    assert tuple(traverse.shortest_path(x, one, F.col("id") == 2, F.col("value")).first()) == (2.0, [1, 3, 2])
    assert traverse.shortest_path(x, one, F.col("id") == 77, F.col("value")).count() == 0
    with pytest.raises(Exception, match="below zero"):
        traverse.shortest_path(x, one, F.col("id") == 2, -F.col("value")).collect()


def test_cycle_is_refused_as_dag(spark):
    with pytest.raises(traverse.CycleError):
        traverse.levels(Graph.of(edges(spark, [(1, 2), (2, 1)])))
    assert not traverse.is_acyclic(Graph.of(edges(spark, [(1, 1)])))
    with pytest.raises(ValueError):
        traverse.connected_components(Graph.of(edges(spark, [(1, 2)])))


def test_range_slice_reaches_the_scan(spark, sf):
    m = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_retailprice").alias("key"), F.col("p_partkey").alias("value"))
    plan = ordered.slice_(m, 950.0, 1000.0)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_retailprice,950.0)" in plan
    assert nodes(m)["FileScan"] >= 0


def test_live_map_replays_a_batch(spark, tmp_path):
    live = LiveMap(str(tmp_path), lambda old, new: old + new)
    edit = lambda rows: spark.createDataFrame(rows, "key long, value long, seq long")
    live.apply(edit([(1, 1, 0), (2, 5, 0)]), 0)
    live.apply(edit([(1, 2, 1)]), 1)
    live.apply(edit([(1, 2, 1)]), 1)
    assert sorted(map(tuple, live.read(spark).collect())) == [(1, 3), (2, 5)]
