"""The pipeline's stages against what they should keep."""

import re
from collections import Counter

import corpus_pipeline as p
import pytest
from collectra.llm import mixing, quality

from test_nearcopies import least_by_force

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def contaminated(text, items, size=10):
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    w = words(text)
    for own in map(words, items):
        n = min(size, len(own))
        if n and {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} & {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}:
            return True
    return False


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        before, after = ([r.doc_id for r in x.select("doc_id").collect()] for x in (docs, out))
        assert out.columns[:5] == p.COLUMNS
        if k == 0:
            model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert sorted(after) == sorted(r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect())
        if k == 1:  # a five-word Jaccard similarity of 0.8, by force
            assert sorted(after) == sorted(set(least_by_force([(r.doc_id, r.text) for r in rows]).values()))
        if k == 2:
            assert sorted(after) == sorted(r.doc_id for r in rows if not contaminated(r.text, items))
        if k == 3:
            taken, sizes = Counter(after), {r.doc_id: (r.source, len((r.text or "").encode().split())) for r in rows}
            mixed = mixing.mix(*[spark.createDataFrame([(i, *v) for i, v in sizes.items()], "doc_id long, source string, size long")] * 2).collect()
            assert set(after) <= set(before) and max(taken.values()) <= 3
            for s in {v[0] for v in sizes.values()}:
                words = sum(sizes[i][1] * n for i, n in taken.items() if sizes[i][0] == s)
                assert words == sum(r.size * r.copies for r in mixed if r.source == s)
        if k == 4:
            assert sorted(after) == sorted(before) and len({(r.shard, r.slot) for r in out.collect()}) == len(after)
        docs = out


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_near_duplicate_edges(spark, sf):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(3, long, "en", "a", 1), (3, long, "en", "a", 1), (7, long, "en", "b", 1), (None, long, "en", "a", 1), (9, None, None, None, None), (8, " ", "en", "a", 1), (5, long[::-1], "en", "a", 1)]
    rows += [(None, "a lone text", "en", None, 1), (None, "a lone text", None, "en", 1), (4, "one id", "en", "a", 1), (4, "two texts", "en", "a", 1)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", component_id string")
    out = [r.doc_id for r in p.near_duplicate_stage(spark, docs, sf).collect()]
    assert sorted(out, key=str) == [3, 4, 4, 5, 8, None]


@pytest.mark.parametrize("doc_id", [None, 7])
def test_mixing_takes_what_it_planned_of_rows_without_ids(spark, sf, doc_id):
    rows = [(doc_id, "one two three four five", "en", "a", 1) for _ in range(100)] + [(k, "a b c", "en", "b", 1) for k in range(100, 400)]
    rows += [(None, None, None, None, None), (None, "", "en", None, 0)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", size int")
    small = docs.selectExpr("doc_id", "source", "cast(case source when 'a' then 5 when 'b' then 3 else 0 end as long) as size", "text")
    want = Counter()
    for r in mixing.mix(small, small).collect():
        want[r.source] += r.copies
    out = p.mixing_stage(spark, docs, sf)
    got = Counter(r.source for r in out.collect())
    assert out.columns == p.COLUMNS and all(got[s] == want[s] for s in ("a", "b", None))


def test_edges_of_the_other_stages(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "w " * 30000, "en", None, 60000), (None, "same", "en", "a", 4), (None, "same", "en", "a", 4)]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", shard string, score int")
    for stage in (p.quality_stage, p.decontamination_stage):
        out = stage(spark, docs, sf)
        assert out.columns == p.COLUMNS and out.count() in (0, 6) or stage is p.quality_stage
    out = p.sharding_stage(spark, docs, sf)
    assert out.columns == [*p.COLUMNS, "shard", "slot"] and len({(r.shard, r.slot) for r in out.collect()}) == 6
