"""Benchmark decontamination: training token windows against a broadcast hash set of test n-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Bytes of words are 0-9, a-z (A-Z is lowered) and all from 0x80 on; any other byte parts words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolled(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` neighbouring ids."""
    n = len(ids) - length + 1
    h = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k in range(length):
            h = h * BASE + ids[k : k + n]
    return mixed(h)


class Grams:
    """The windows of some benchmark items: word numbers, and by window length the sorted hash set.

    All is held in flat arrays, about 100 bytes a benchmark word at the peak of building: the items' word
    numbers once, and of each window a hash, its first place and its owners.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str | None] = sorted({i for i, _ in items if i is not None}) + [None]
        number = {x: k for k, x in enumerate(self.items)}
        pieces: list[np.ndarray] = [np.zeros(0, np.uint32)]
        windows: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        end = 0
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.uint32)
            if length := min(size, len(ids)):
                h = rolled(ids.astype(np.uint64), length)
                windows.setdefault(length, []).append((h, end + np.arange(len(h)), np.full(len(h), number[item], np.int32)))
            pieces.append(ids)
            end += len(ids)
        self.ids = np.concatenate(pieces)
        self.sets = []
        for length in sorted(windows):
            h, at, owner = (np.concatenate(x) for x in zip(*windows.pop(length), strict=True))
            order = np.argsort(h, kind="stable")
            hashes, places, which = self.distinct(h[order], at[order], length)
            pairs = np.unique(which << 32 | owner[order])
            begin = np.searchsorted(pairs >> 32, np.arange(len(hashes) + 1))
            bits = np.zeros(1 << 16, bool)
            bits[hashes >> np.uint64(48)] = True
            self.sets.append((length, hashes, places, (begin, pairs.astype(np.int32)), bits))

    def distinct(self, h: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes (sorted) and places of the distinct windows, and which of them stands at each ``at``; ``h`` is sorted."""
        left, which, hashes, places, n = np.arange(len(h)), np.zeros(len(h), np.int64), [], [], 0
        while len(left):  # a second time only for windows that differ from the first of their hash
            own, here = h[left], at[left]
            change = np.r_[True, own[1:] != own[:-1]]
            first = np.flatnonzero(change)
            group = np.cumsum(change) - 1
            same = self.equal(here, here[first][group], length)
            which[left[same]] = n + group[same]
            hashes.append(own[first])
            places.append(here[first])
            n, left = n + len(first), left[~same]
        hashes, places = np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        return hashes[order], places[order], rank[which]

    def equal(self, a: np.ndarray, b: np.ndarray, length: int, ids: np.ndarray | None = None) -> np.ndarray:
        """Whether the words from ``a`` (in ``ids``, by default the items') and from ``b`` on are the same."""
        ids = self.ids if ids is None else ids
        same = np.ones(len(a), bool)
        for k in range(length):
            same &= ids[a + k] == self.ids[b + k]
        return same

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
        """For each length: positions of true occurrences, the number of the window found there, and owners by number."""
        for length, hashes, places, owners, bits in self.sets:
            known = np.cumsum(np.r_[0, ids == 0])
            h = rolled(ids, length)
            if not len(h):
                continue
            at = np.flatnonzero(bits[h >> np.uint64(48)] & (known[length:] == known[:-length]))
            left, right = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], "right")
            at, left, right = (x[right > left] for x in (at, left, right))
            while len(at):  # verify, also where different windows share a hash
                same = self.equal(at, places[left], length, ids)
                yield length, at[same], left[same], owners
                left = left + 1
                more = ~same & (left < right)
                at, left, right = at[more], left[more], right[more]


def scan(grams: Grams, texts: list[bytes | None], known: list[bytes | None]) -> tuple[list[int], list[bytes], list[list[str]]]:
    """By text: words, the bitmap of hit words (with ``known`` hits), the ids of items found."""
    counts, pieces, get = [], [np.zeros(1, np.uint64)], grams.vocabulary.get
    for t in texts:
        w = words(t)
        counts.append(len(w))
        pieces += [np.fromiter(map(get, w, repeat(0)), np.uint64, len(w)), np.zeros(1, np.uint64)]
    ids = np.concatenate(pieces)  # a zero, which no window holds, stands between texts
    starts = np.cumsum(np.r_[1, np.array(counts, np.int64) + 1])
    marks, found = np.zeros(len(ids) + 1, np.int64), [set() for _ in texts]
    for length, at, which, (begin, own) in grams.hits(ids):
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
        doc = np.searchsorted(starts, at, "right") - 1
        for d, w in {*zip(doc.tolist(), which.tolist(), strict=True)}:
            found[d].update(own[begin[w] : begin[w + 1]].tolist())
    hit = np.cumsum(marks)[:-1] > 0
    bitmaps = []
    for k, n in enumerate(counts):
        own = hit[starts[k] : starts[k] + n]
        if known[k]:
            own = own | np.unpackbits(np.frombuffer(known[k], np.uint8), count=n).astype(bool)
        bitmaps.append(np.packbits(own).tobytes() if own.any() else b"")
    return counts, bitmaps, [sorted(x for x in (grams.items[i] for i in f) if x is not None) for f in found]


def contaminations(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with ``_words`` (long), ``_hits`` (bitmap of hit words, most significant bit first; empty: none) and ``_items`` (sorted ids).

    A window is ``size`` consecutive words of an item, or all words of a shorter one; a word inside an
    occurrence of a window is hit. The broadcast set holds at most about ``block_bytes`` of benchmark
    text: a larger benchmark is cut by hash into blocks of that size, and the documents are scanned once
    a block, so neither the driver nor an executor ever holds more. Null texts have no words. Items
    with a null id mark words but are not listed; repeated item rows count once. Columns whose names
    start with an underscore are overwritten; all others, whatever their names, are kept.
    """
    plain = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.encode("text", "utf-8").alias("text"))
    total = plain.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    plain = plain.withColumn("_block", F.pmod(F.xxhash64(F.lit(11), "item_id", "text"), F.lit(blocks)))
    out = docs.select(*[c for c in docs.columns if c not in ("_words", "_hits", "_items")]).withColumns(
        {"_words": F.lit(0).cast("long"), "_hits": F.lit(b""), "_items": F.array().cast("array<string>")}
    )
    context = docs.sparkSession.sparkContext
    for b in range(blocks):
        rows = plain.where(F.col("_block") == b).collect()
        shared = context.broadcast(Grams([(r[0], bytes(r[1]) if r[1] is not None else None) for r in rows], size))
        names = out.columns

        def run(batches: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = 500
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    texts = [x.encode("utf-8", "surrogatepass") if x is not None else None for x in part.column(names.index("text")).to_pylist()]
                    old = part.column(names.index("_items")).to_pylist()
                    counts, bitmaps, items = scan(shared.value, texts, part.column(names.index("_hits")).to_pylist())
                    items = [sorted({*x, *y}) for x, y in zip(items, old, strict=True)]
                    columns = [part.column(k) for k in range(len(names) - 3)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(bitmaps, pa.binary()), pa.array(items, pa.list_(pa.string()))], names)

        out = out.mapInArrow(run, out.schema)
        if b < blocks - 1:
            out = cut(out)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", size: int = 10) -> DataFrame:
    """``docs`` without contaminated documents (``mode`` documents), or with their hit words cut out (spans).

    In mode ``spans`` the bytes from a hit run's first to its last word go, ``text`` changes and
    ``n_chars``, where there is one, follows. Empty benchmark: nothing changes. Columns are those of ``docs``.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    found = contaminations(docs, benchmark, size)
    if mode == "documents":
        return found.where(F.octet_length("_hits") == 0).select(*docs.columns)
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([without(t, h) for t, h in zip(columns[at].to_pylist(), batch.column(names.index("_hits")).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    cleaned = found.mapInArrow(run, found.schema)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.octet_length("_hits") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def without(text: str | None, bitmap: bytes) -> str | None:
    if text is None or not bitmap:
        return text
    data = text.encode("utf-8", "surrogatepass")
    separate = np.frombuffer(data.translate(TABLE), np.uint8) == 32
    edge = np.diff(np.r_[True, separate, True].astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hit = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(first)).astype(np.int8)
    runs = np.diff(np.r_[0, hit, 0])
    kept, at = [], 0
    for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1) - 1, strict=True):
        kept.append(data[at : first[a]])
        at = last[b]
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    found = contaminations(docs, table(spark, sf_dir, "benchmark"))
    names = found.columns

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [int.from_bytes(x, "big").bit_count() for x in batch.column(names.index("_hits")).to_pylist()]
            items = batch.column(names.index("_items")).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("doc_id")), batch.column(names.index("_words")), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items])],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"],
            )

    done = found.select(*[c if c != "text" else F.lit("").alias("text") for c in names]).mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return done.withColumn("contaminated", F.col("n_hit") > 0)


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bl AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)
), s AS (SELECT DISTINCT n FROM g), o AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n
), m AS (
  SELECT doc_id, i, o.n, item_id FROM o JOIN g ON g.n = o.n AND g.gram = array_to_string(w[i : i + o.n - 1], ' ')
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
