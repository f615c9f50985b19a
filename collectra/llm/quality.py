"""A quality classifier of supervised subword embeddings, trained by stochastic gradient descent in numpy.

A document is the average of the vectors of its words and of their character n-grams, all hashed into
one table; a softmax layer on top tells the classes. As the layer is linear, a trained table is folded
into one number a bucket, and a word's sum is remembered, so scoring is a lookup a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

BUCKETS = 1 << 17
#: Bytes up to which a word is remembered.
LONG = 64


def features(word: bytes) -> list[int] | np.ndarray:
    """Buckets of a word: itself and its 3- to 5-byte n-grams, with marks at its ends."""
    if len(word) > LONG:
        return long_features(word)
    marked = b"<" + word + b">"
    out = [zlib.crc32(word) % BUCKETS]
    for n in (3, 4, 5):
        out += [zlib.crc32(marked[i : i + n], n) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


CRC = crc_table()


def long_features(word: bytes) -> np.ndarray:
    """``features`` of a word of any length, the CRCs of all n-grams taken a byte at a time at once."""
    marked = np.frombuffer(b"<" + word + b">", np.uint8)
    out = [np.array([zlib.crc32(word) % BUCKETS], np.int32)]
    for n in (3, 4, 5):
        m = len(marked) - n + 1
        crc = np.full(m, n ^ 0xFFFFFFFF, np.uint32)
        for i in range(n):
            crc = CRC[(crc ^ marked[i : i + m]) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        out.append(((crc ^ np.uint32(0xFFFFFFFF)) % BUCKETS).astype(np.int32))
    return np.concatenate(out)


class Words:
    """Packed 32-bit features or folded sums by word, remembered up to ``memory`` words of up to LONG bytes."""

    def __init__(self, weights: np.ndarray | None = None, memory: int = 300_000):
        self.weights, self.memory, self.known = weights, memory, {}

    def __call__(self, words: list[bytes]) -> list:
        known = self.known
        if len(known) > self.memory:
            known.clear()
        for w in set(words):
            if w not in known and len(w) <= LONG:
                known[w] = self.value(w)
        return [known[w] if len(w) <= LONG else self.value(w) for w in words]

    def value(self, word: bytes) -> bytes | tuple[float, int]:
        f = features(word)
        return np.array(f, np.int32).tobytes() if self.weights is None else (float(self.weights[f].sum()), len(f))


def train(texts: list[bytes], labels: list[int], width: int = 16, steps: int = 30_000, rate: float = 1.0, seed: int = 37) -> tuple[np.ndarray, float]:
    """(folded weights by bucket, bias): the log-odds of label 1 is their average over the features plus the bias.

    Stochastic gradient descent on the cross-entropy, ``steps`` rows long whatever their number, with a falling
    rate. The classes weigh the same in the loss (up to ten times a row), so the rarer one is not drowned.
    """
    rng = np.random.default_rng(seed)
    known = Words()
    rows = []
    for t in texts:
        f = np.frombuffer(b"".join(known(t.split())), np.int32)
        buckets, counts = np.unique(f, return_counts=True)
        rows.append((buckets, counts.astype(np.int32), max(1, len(f))))
    table_ = (rng.random((BUCKETS, width), np.float32) - 0.5) / width
    layer, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    y = np.array(labels, np.int64)
    share = np.bincount(y, minlength=2) / max(1, len(y))
    weight = np.minimum(np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0.0), 10.0)
    for done in range(steps if rows else 0):
        if done % len(rows) == 0:
            turn = rng.permutation(len(rows))
        r = turn[done % len(rows)]
        buckets, counts, n = rows[r]
        share_of = (counts / n).astype(np.float32)
        hidden = share_of @ table_[buckets]
        z = hidden @ layer + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y[r]] -= 1
        p *= rate * (1 - done / steps) * weight[y[r]]
        back = layer @ p
        layer -= np.outer(hidden, p)
        bias -= p
        table_[buckets] -= share_of[:, None] * back
    return table_ @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, most_bytes: int = 64 << 20, seed: int = 41) -> tuple[np.ndarray, float]:
    """Trains on the texts of ``docs`` whose ``labels`` (doc_id, quality) may be learnt from (not ``held_out``).

    It takes a seeded sample of about ``per_class`` labels of each class at most, and of their texts about
    ``most_bytes`` at most, so the broadcast side of the join and what meets in the training task are bounded by
    parameters. Rows that repeat an id and its text count once; one id with several texts teaches all of them; an
    id labelled both 0 and 1 teaches both. The driver gets the folded weights. Labels with a null doc_id or quality
    are left out. Without labels or documents all scores are 0.5.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("_id")).distinct()
    counts = {r[0]: r[1] for r in rows.groupBy("quality").count().collect()}
    dealt = F.pmod(F.xxhash64(F.lit(seed), F.col("_id")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("quality") == 1, F.lit(min(1.0, per_class / counts.get(1, 1)))).otherwise(F.lit(min(1.0, per_class / counts.get(0, 1))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "utf-8").alias("text"))
    sample = texts.join(F.broadcast(rows.where(dealt < rate)), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "quality")
    sample = cut(sample.distinct())
    total = sample.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    if total > most_bytes:
        sample = sample.where(F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30) < most_bytes / total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted({(i, t or b"", y) for b in batches for i, t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)})
        if got:
            weights, bias = train([t for _, t, _ in got], [y for _, _, y in got])
            yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()]), pa.array([bias])], ["weights", "bias"])

    model = sample.repartition(1).mapInArrow(run, "weights binary, bias double").collect()
    if not model:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(model[0][0], np.float32), model[0][1]


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 by the whole text, and ``predicted`` (1 from 0.5 on).

    Null and empty texts get what the bias says, repeated rows the same. An empty table gives an empty one. Other columns are kept; ``score`` and ``predicted`` are
    overwritten. The model (``BUCKETS`` numbers, whatever the data) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        known = Words(weights)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for k, x in enumerate(batch.column(at)):
                text = x.as_py()
                sums = known(text.encode("utf-8", "surrogatepass").split()) if text else ()
                n = sum(s[1] for s in sums)
                z = bias + (sum(s[0] for s in sums) / n if n else 0.0)
                out[k] = 1 / (1 + np.exp(-min(max(z, -50.0), 50.0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array((out >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    plain = docs.select(*kept)
    return plain.mapInArrow(run, plain.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    found = score(docs.withColumn("held_out", held_out()), fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", "predicted")
