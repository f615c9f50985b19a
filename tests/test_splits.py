"""Splits of maps by ranges of their keys."""

from collectra.operators import maps


def test_split_range(spark):
    a = spark.createDataFrame([(k, -k) for k in range(10)] + [(None, 1)], "key long, value long")
    rows = maps.split_range(a, 4).collect()
    by_part = {}
    for r in rows:
        by_part.setdefault(r.part, []).append(-1 if r.key is None else r.key)
    assert sorted(map(len, by_part.values())) == [2, 3, 3, 3]
    assert [x for k in sorted(by_part) for x in sorted(by_part[k])] == list(range(-1, 10))
    assert maps.split_range(a.limit(0), 4).count() == 0
    assert sorted({r.part for r in maps.split_range(a.limit(2), 4).collect()}) == [0, 2]
