"""The trained operators against plain forms of themselves, and the search that prunes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from collectra.llm import language, quality, registry, topk


def test_every_letter_has_a_vector_of_its_own():
    space = language.Space(1024, memory=50)
    letters = np.array([0, *range(0x430, 0x450), *range(0xE0, 0xF7), *range(97, 123), 0x4E00, 0x4E01])
    v = space.vectors(letters).astype(int)
    assert set(np.unique(v)) == {-1, 1} and np.abs(v @ v.T - 1024 * np.eye(len(v))).max() < 200
    assert (space.vectors(letters[::-1])[::-1] == v).all() and (language.Space(1024).vectors(letters) == v).all()


def by_force(space, text):
    """The bundle, n-gram by n-gram."""
    flat = "".join(c if c.isalpha() else " " for c in text.lower())
    words = " " + " ".join(flat.split()) + " "
    out = np.zeros(space.width)
    for i in range(len(words) - 2):
        a, b, c = (space.vectors(np.array([0 if x == " " else ord(x)]))[0].astype(int) for x in words[i : i + 3])
        out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


@pytest.mark.parametrize("text", ["a", "Ab, cd!", "Привет, мир 12 привет", "日本語のテキスト " * 40, "x" * 200])
def test_profiles_by_force(text):
    space = language.Space(1024)
    assert (space.profile(text) == by_force(space, text)).all()


def test_op7_cosines_by_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).collect()
    space = language.Space(1024)
    profiles = {r.doc_id: space.profile(r.text) for r in docs}
    unit = {i: p / np.linalg.norm(p) for i, p in profiles.items() if p is not None}
    names = sorted({r.lang for r in docs if not r.held and r.lang is not None})
    protos = np.stack([sum(unit[r.doc_id] for r in docs if not r.held and r.lang == x and r.doc_id in unit) for x in names])
    protos /= np.linalg.norm(protos, axis=1, keepdims=True)
    common = protos.mean(axis=0) / np.linalg.norm(protos.mean(axis=0))
    centred = protos - np.outer(protos @ common, common)
    centred /= np.linalg.norm(centred, axis=1, keepdims=True)
    for r in registry.QUERIES["op7_language"](spark, sf).collect():
        if r.doc_id not in unit:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        u = unit[r.doc_id] - (unit[r.doc_id] @ common) * common
        cosine = centred @ (u / np.linalg.norm(u))
        assert r.score == pytest.approx(max(0.0, cosine.max()), abs=1e-4) and cosine[names.index(r.lang_pred)] == pytest.approx(cosine.max(), abs=1e-4)


def test_two_thousand_languages_repeated_and_empty(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdefghijkl ") for _ in range(80)), f"l{i:04d}", 1) for i in range(2000)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    some = labelled.where("doc_id < 40").unionByName(labelled.where("doc_id < 3"))
    found = language.identify(some, labelled).collect()
    assert len(found) == 43 and all(r.lang_pred == r.lang for r in found)
    assert language.identify(some.limit(0), labelled).count() == 0


def test_op9_scores_by_force(spark, sf):
    import zlib

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    weights, bias = quality.fit(docs, labels)
    again = quality.fit(docs.unionByName(docs.limit(30)).repartition(3), labels.unionByName(labels))
    assert (again[0] == weights).all() and again[1] == bias  # repeats and order teach nothing
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in registry.QUERIES["op9_quality"](spark, sf).collect():
        f = [b for w in (texts[r.doc_id] or "").encode().split() for b in quality.features(w)]
        z = bias + (float(weights[f].astype(float).sum()) / len(f) if f else 0.0)
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6) and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert quality.score(docs.limit(0), (weights, bias)).count() == 0


def test_training_follows_the_gradient():
    texts, labels = [b"good words here", b"bad things there", b"good day", b"bad day"], [1, 0, 1, 0]
    weights, bias = quality.train(texts, labels, steps=400)
    margin = [bias + weights[[b for w in t.split() for b in quality.features(w)]].mean() for t in texts]
    assert all((m > 0) == bool(y) for m, y in zip(margin, labels))
    assert quality.train([], [])[1] == 0.0


def test_most_bytes_bounds_the_training_texts(spark):
    docs = spark.createDataFrame([(i, f"text{i} " * 100) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    seen = []
    train = quality.train
    try:
        quality.train = lambda texts, labels: seen.append(len(texts)) or train(texts, labels, steps=10)
        quality.fit(docs, labels, most_bytes=20_000)
    finally:
        quality.train = train
    assert quality.fit(docs, labels, most_bytes=1)[1] == 0.0


def test_bounds_cut_exact_scores_of_clustered_vectors():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 64))
    label = rng.integers(0, 40, 6000)
    rows = centres[label] + 0.1 * rng.normal(size=(6000, 64))
    rows = np.floor(1024 * rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.int64)
    ids, queries = np.arange(6000), np.arange(0, 6000, 100)
    best = topk.Best(len(queries), 10)
    exact = topk.search((queries, rows[queries]), ids, rows, best, [topk.statistics(rows[queries], s) for s in topk.SEGMENTS])
    for k, q in enumerate(queries.tolist()):
        want = sorted((-int(rows[q] @ rows[i]), i) for i in ids.tolist() if i != q)[:10]
        assert [(-s, i) for s, i in zip(best.score[k].tolist(), best.ids[k].tolist())] == want
    assert exact < 0.2 * len(queries) * len(rows)


def test_top_k_clashing_columns_and_repeated_queries(spark):
    rows = [(i, [i % 7, -i % 5, 3], "clash", 1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id int, vector array<long>, query_id string, rank int, score int")
    asked = df.where("vec_id in (0, 10)")
    plain, again = (sorted(map(tuple, topk.top_k(df.repartition(3), q, 4, block_bytes=n).collect())) for q, n in ((asked, 1 << 20), (asked.unionByName(asked), 40)))
    assert plain == again and len(plain) == 8
