"""Places and keys that must raise, nulls of the encodings, and loops longer than any bound."""

import pytest
from pyspark.sql import functions as F

from collectra.functions import bits, encodings, text
from collectra.operators import graph as g
from collectra.operators import maps, seq, sets, traverse
from collectra.operators.graph import Graph

T = "t string"


@pytest.mark.parametrize(
    "edit",
    [
        lambda c: text.nth(c, 3, strict=True), lambda c: text.insert(c, 4, F.lit("x")), lambda c: text.insert(c, -1, F.lit("x")), lambda c: text.remove(c, 2, 1), lambda c: text.remove(c, 1, 99),
        lambda c: text.slice_(c, -1, 2), lambda c: text.slice_(c, 0, 4), lambda c: text.char_at(c, 3), lambda c: text.sub_sequence(c, 1, 9),
    ],
)
def test_places_out_of_a_text_raise(spark, edit):
    assert spark.createDataFrame([(None,)], T).select(edit(F.col("t"))).collect()[0][0] is None
    with pytest.raises(Exception, match="out of the text"):
        spark.createDataFrame([("abc",)], T).select(edit(F.col("t"))).collect()


def test_text_and_units_both_ways(spark):
    s = "a\u0080ࠀ\U00010000z"
    df = spark.createDataFrame([(1, s), (2, ""), (3, None), (4, "x" * 10)], "id int, t string")
    c = F.col("t")
    r = df.select("id", text.from_code_points(text.code_points(c)).alias("p"), text.from_utf16(text.utf16_units(c)).alias("u")).collect()
    assert [(x.p, x.u) for x in r] == [(s, s), ("", ""), (None, None), ("x" * 10,) * 2]
    one = df.where("id = 1").select(text.char_at(c, 3), text.sub_sequence(c, 3, 6)).collect()[0]
    assert list(one) == [0xD800, "\U00010000z"]
    pieces = text.chunks(df, ["id"], "t", 3)
    assert {r.id: r.text for r in text.joined(pieces, ["id"]).collect()} == {1: s, 2: "", 4: "x" * 10}
    assert sorted(r.text for r in pieces.where("id = 4").collect()) == ["x", "xxx", "xxx", "xxx"]


def test_encodings_keep_nulls_and_bits(spark):
    xs = [1.5, None, 1.5000000000000002, -0.0, float("nan"), None, -2.25, float("-inf")]
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("n", encodings.double_to_long("x"))
    got = df.withColumn("back", encodings.long_to_double("n")).collect()
    assert [r.n is None for r in got] == [x is None for x in xs]
    assert all(r.back == r.x or r.x != r.x for r in got if r.x is not None) and all(r.back is None for r in got if r.x is None)
    assert got[0].n == 4609434218613702656 and got[2].n == got[0].n + 1


def test_bits_at_their_edges(spark):
    r = spark.createDataFrame([(0,), (8,), (-1,)], "n long").select(F.when(F.col("n") >= 0, bits.highest_bit(F.col("n"))), bits.slice_(F.col("n"), 0, 64), bits.slice_(F.col("n"), 1, 3)).collect()
    assert [list(x) for x in r] == [[0, 0, 0], [8, 8, 0], [None, -1, 3]]
    with pytest.raises(ValueError):
        bits.interleave([F.lit(0), F.lit(1), F.lit(0)], 32)
    with pytest.raises(Exception, match="logarithm"):
        spark.createDataFrame([(0,)], "n long").select(bits.log2_floor(F.col("n"))).collect()
    assert [bits.mask_below(3), bits.mask_above(3)] == [7, -8]
    with pytest.raises(Exception, match="fit"):
        spark.range(1).select(bits.vector_overwrite(bits.vector_create(2), 1, F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))).collect()


def test_absent_keys_and_edges_raise(spark):
    m = spark.createDataFrame([(1, None), (2, 5)], "key int, value int")
    probes = spark.createDataFrame([(1,), (2,)], "key int")
    assert sorted(map(tuple, maps.get_strict(m, probes).collect()), key=str) == [(1, None), (2, 5)]
    with pytest.raises(Exception, match="no such key: 3"):
        maps.get_strict(m, spark.createDataFrame([(3,)], "key int")).collect()
    x = Graph.of(spark.createDataFrame([(1, 2, 7)], "src long, dst long, value int"))
    with pytest.raises(Exception, match="no such edge"):
        g.edge_strict(x, spark.createDataFrame([(2, 1)], "src long, dst long")).collect()
    with pytest.raises(Exception, match="no integer"):
        maps.int_keys(spark.createDataFrame([(1.5, 1)], "key double, value int")).collect()


def test_small_sequences_and_helpers(spark):
    calls = []
    assert seq.on_exhaustion(seq.of(spark, "a", None, kind="string"), lambda d: calls.append(d.count())).count() == 2 and calls == [2]
    made = seq.memoized(lambda n: calls.append(n) or seq.span(spark, 0, n))
    assert made(3).count() == made(3).count() == 3 and calls == [2, 3]
    assert seq.of(spark, kind="long").count() == 0 and seq.span(spark, 3, 1).count() == 0 and seq.clear(seq.span(spark, 0, 4)).count() == 0
    assert sets.to_text(spark.createDataFrame([(2,), (1,), (None,)], "value int")).first()[0] in ("{null, 1, 2}", "{1, 2}")


def test_cycle_longer_than_any_round_count(spark):
    n = 14
    x = Graph.of(spark.createDataFrame([(i, (i + 1) % n, 1) for i in range(n)] + [(n, 0, 1)], "src long, dst long, value int"))
    got = {r.id: r.component for r in traverse.strongly_connected(x, small=0).collect()}
    assert got == {**dict.fromkeys(range(n), 0), n: n}
    chain = Graph.of(spark.createDataFrame([(i, i + 1, 1) for i in range(20)], "src long, dst long, value int"))
    assert {r.id: r.level for r in traverse.levels(chain).collect()} == {i: i for i in range(21)}
    assert {r.id: r.level for r in traverse.bfs_levels(spark.range(1), chain.edges).collect()} == {i: i for i in range(21)}
    closing = {(r.src, r.dst): r.closes for r in traverse.closing(chain, spark.createDataFrame([(20, 0), (0, 20), (5, 5), (99, 3)], "src long, dst long")).collect()}
    assert closing == {(20, 0): True, (0, 20): False, (5, 5): True, (99, 3): False}


def test_blocks_against_a_naive_cut(spark):
    import random

    rng = random.Random(4)
    pairs, base = [], 0
    for _ in range(12):  # small graphs beside each other
        n = rng.randint(2, 9)
        pairs += [(base + a, base + b) for a, b in {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(1, 12))}]
        base += 10
    ladder = [(base + k, base + k + d) for k in range(24) for d in (1, 2)]  # one deep block, with a tail and a chord across
    pairs += [*ladder, *[(base + 25 + k, base + 26 + k) for k in range(6)], (base + 27, base + 30)]
    base += 40
    pairs += [(base + a, base + b) for a, b in {tuple(sorted(rng.sample(range(40), 2))) for _ in range(48)}]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def parts(without):
        left, n = set(near) - {without}, 0
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                more = near[todo.pop()] & left
                left -= more
                todo += more
        return n

    x = Graph.of(spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, value int"), directed=False)
    assert {r.id for r in traverse.articulation_points(x).collect()} == {v for v in near if parts(v) > parts(None)}
    found = {}
    for r in traverse.biconnected_components(x).collect():
        found.setdefault((r.component, r.block), set()).add(r.id)
    assert all(sum({a, b} <= block for block in found.values()) == 1 for a, b in pairs)  # an edge lies in one block
    assert sum(len(block) - 1 for block in found.values()) == len(near) - parts(None)  # blocks and cut vertices are a tree
