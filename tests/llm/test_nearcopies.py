"""The near-duplicate stage against brute-force Jaccard similarity."""

from itertools import combinations

import corpus_pipeline as p
from collectra.llm import nearcopies


def grams(text, size=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([b" ".join(words)] if len(words) <= size else [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)])


def least_by_force(rows):
    """Component ids by doc_id, of (doc_id, text) rows with distinct ids."""
    found, holders, parent = {i: grams(t) for i, t in rows}, {}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in found.items():
        for x in s or [None]:
            holders.setdefault(x, set()).add(i)
    for a, b in {pair for ids in holders.values() for pair in combinations(sorted(ids), 2)}:
        if 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b]):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: root(i) for i in parent}


def test_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = least_by_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in p.near_duplicate_stage(spark, docs, sf).collect()) == sorted(set(want.values()))


def test_common_shingles_chains_and_thresholds(spark):
    words = [f"w{i}" for i in range(300)]
    line = " ".join(f"line{i}" for i in range(8))
    rows = [(i, " ".join([*words[: 250 - i], *(f"x{i}.{j}" for j in range(i))])) for i in range(40)]  # a chain: neighbours are similar, the ends are not
    rows += [(100 + i, line + " " + " ".join(f"y{i}.{j}" for j in range(i % 9))) for i in range(60)]  # a shared line, of short and long texts
    rows += [(200, " ".join(words[:13])), (201, " ".join([*words[:11], "z", "z"])), (202, ""), (203, None), (204, "one two"), (205, "ONE  two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = least_by_force(rows)
    for heavy in (1, 256):
        found = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs, heavy=heavy, block_rows=16 if heavy == 1 else 2048).collect()}
        assert found == want


def test_a_group_of_which_half_is_apart(spark):
    import random

    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):  # copies with few to many changed words: some are similar, others near only
        w = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 3, 5, 8, 12])):
            w[k] = f"c{i}.{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = least_by_force(rows)
    found = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs, block_rows=64).collect()}
    assert found == want and 20 < len(set(want.values())) < 400


def test_overlaps_and_checked_parts(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 200)
    sets = [np.unique(np.where(rng.random(200) < rng.choice([0.02, 0.05, 0.2]), rng.integers(0, 1 << 62, 200), base)) for _ in range(90)]
    n = np.array([len(s) for s in sets])
    got = nearcopies.overlaps(np.concatenate(sets).astype(np.uint64), n, np.arange(0, 40), np.arange(20, 90), step=64)
    assert all(got[i, j - 20] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(20, 90) if i != j)
    parent = list(range(90))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(90), 2):
        x = len(np.intersect1d(sets[i], sets[j]))
        if 5 * x >= 4 * (n[i] + n[j] - x):
            low, high = sorted((root(i), root(j)))
            parent[high] = low
    for c in (list(range(90)), [min(i, 1000) if i % 3 else 0 for i in range(90)]):  # all apart; a third already one
        groups = spark.createDataFrame([(i, 0, c[i], s.tolist()) for i, s in enumerate(sets)], "row long, component long, c long, grams array<long>")
        links = [(r.a, r.b) for r in nearcopies.checked(groups, (4, 5), part_rows=8).collect()]
        links += [(i, c.index(c[i])) for i in range(90)]
        found = nearcopies.stars(spark.createDataFrame(links, "a long, b long")).collect()
        mine = {r.node: r.component for r in found}
        whole = {i: root(i) for i in range(90)}
        if len(set(c)) == 90:
            assert {i: mine.get(i, i) for i in range(90)} == whole
        else:
            assert all(mine.get(i, i) == mine.get(root(i), root(i)) for i in range(90))
