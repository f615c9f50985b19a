"""SimHash near-duplicates: fingerprints, and links found by bit-sliced comparison.

A fingerprint pair within ``radius`` = 3 bits agrees wholly on one of four 16-bit bands, and then on
one of four 12-bit parts of the other 48 bits. So the 16 keys of 28 bits that a fingerprint has lose
no pair. Rows that share a key form a block. A block is stored as 64 bit planes (bit b of all its
fingerprints in one row of machine words); one pass over the planes updates the distances of 64 pairs
a word in carry-save counters, and words whose pairs all exceed the radius are abandoned on the way.
``nearcopies`` is the same operator for a similarity of word shingles instead of a radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.traverse import stars
from .common import cut, table

BITS, SMALL = 64, 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | bytes | None, size: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over the XXH64 hashes of ``size``-word shingles; 0 without words."""
    data = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower().split()
    if not data:
        return 0
    if len(data) <= size:
        shingles = [b" ".join(data)]
    else:
        shingles = map(b" ".join, zip(*(data[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, seed) for x in shingles), np.uint64, max(1, len(data) - size + 1))
    lanes, n = np.uint64(0x0101010101010101), len(hashes)
    counts = np.zeros(BITS, np.int64)
    blocks = np.concatenate([hashes, np.zeros(-n % 255, np.uint64)]).reshape(-1, 255)
    for b in range(8):  # byte j of the sum counts bit 8 j + b of up to 255 hashes
        sums = ((blocks >> np.uint64(b)) & lanes).sum(axis=1, dtype=np.uint64)
        counts[b::8] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint: long, the 64 bits as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(x.as_py(), size, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fingerprint long")


def planes(values: np.ndarray) -> np.ndarray:
    """(bits, words): bit j of word w in row b is bit b of fingerprint 64 w + j; ``values`` is (n,) or (n, words a fingerprint)."""
    packed = np.packbits(bits_of(values), axis=1, bitorder="little")
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return packed.view(np.uint64)


def bits_of(values: np.ndarray) -> np.ndarray:
    """(bits, n) of zeros and ones."""
    raw = np.ascontiguousarray(values.reshape(len(values), -1)).view(np.uint8)
    return np.ascontiguousarray(np.unpackbits(raw, axis=1, bitorder="little").T)


def adder(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save: three bits of one weight make one of that weight and one of twice the weight."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def within(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of words within the radius; ``left`` and ``right`` (planes, ...) broadcast to (planes, rows, words).

    The counters are bit-sliced, one word array a binary digit, preset so that a carry out of the highest
    says "more than the radius". Eight planes at a time go through carry-save adders, so the digits from the
    eights on move once in eight planes; then word columns in which each lane is over are abandoned.
    """
    digits = max(4, radius.bit_length())
    rows, words = np.broadcast_shapes(left.shape[1:], right.shape[1:])
    start = (1 << digits) - 1 - radius
    digit = [np.full((rows, words), FULL if start >> k & 1 else 0, np.uint64) for k in range(digits)]
    over, alive = np.zeros((rows, words), np.uint64), np.arange(words)
    for b in range(0, len(left), 8):
        x = [left[b + i] ^ right[b + i] for i in range(8)]
        one, a = adder(digit[0], x[0], x[1])
        one, c = adder(one, x[2], x[3])
        two, e = adder(digit[1], a, c)
        one, a = adder(one, x[4], x[5])
        digit[0], c = adder(one, x[6], x[7])
        digit[1], f = adder(two, a, c)
        digit[2], carry = adder(digit[2], e, f)
        for k in range(3, digits):
            digit[k], carry = digit[k] ^ carry, digit[k] & carry
        over |= carry
        if b + 8 < len(left):
            live = (over != FULL).any(axis=0)
            if not live.any():
                alive = alive[:0]
                break
            if live.mean() < 0.5:
                alive, over, digit = alive[live], over[:, live], [d[:, live] for d in digit]
                left, right = (y[:, :, live] if y.shape[2] > 1 else y for y in (left, right))
    hits = np.zeros((rows, words), np.uint64)
    if len(alive):
        hits[:, alive] = ~over
    return hits


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) of booleans."""
    return np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; each root stays the least index of its set."""
    while True:
        x, y = parent[a], parent[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def near(groups: np.ndarray, values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (lesser, greater) of one group within the radius, each once, some at a time.

    ``groups`` is sorted. Groups of up to 64 rows are compared all at once, lane i against lane i + s;
    in larger ones 32 rows at a time meet all rows.
    """
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    small = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
    if len(small):
        small = small[np.argsort(-sizes[small], kind="stable")]
        own = sizes[small]
        rows = np.repeat(starts[small], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        label = np.repeat(np.arange(len(small)), own)
        for s in range(1, int(own[0])):
            n = int(own[own > s].sum())  # groups are in falling order of size
            for at in range(0, n, 1 << 15):  # bounds what is unpacked at a time
                end = min(n, at + (1 << 15))
                some = rows[at : min(n, end + s)]
                stack = planes(values[some])
                ahead = np.pad(stack, ((0, 0), (0, 1)))
                moved = stack >> np.uint64(s) | ahead[:, 1:] << np.uint64(64 - s)
                m = min(end - at, len(some) - s)
                if m <= 0:
                    continue
                hit = lanes(within(stack[:, None, :], moved[:, None, :], radius), m)[0]
                i = at + np.flatnonzero(hit & (label[at : at + m] == label[at + s : at + s + m]))
                yield rows[i], rows[i + s]
    for g in np.flatnonzero(sizes > SMALL):
        at, n = starts[g], sizes[g]
        block = values[at : at + n]
        stack = planes(block)[:, None, :]
        for q in range(0, n, 32):
            mask = np.where(bits_of(block[q : q + 32]) == 1, FULL, np.uint64(0))[:, :, None]
            word = q // 64
            hit = lanes(within(mask, stack[:, :, word:], radius), n - 64 * word)
            a, b = np.nonzero(hit)
            a, b = q + a, 64 * word + b
            yield at + a[a < b], at + b[a < b]


def forest(groups: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to), at most one a row, that connect what pairs within the radius connect in each group."""
    parent = np.arange(len(groups))
    for a, b in near(groups, values, radius):
        unite(parent, a, b)
    linked = np.flatnonzero(parent != np.arange(len(groups)))
    return linked, parent[linked]


def block_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, fingerprint) sorted by (key, part) -> links between fingerprints."""
    names = ["a", "b"]

    def done(key: np.ndarray, part: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        change = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
        group = np.cumsum(change)
        again = np.r_[group[1:] == group[:-1], False]
        kept = again | np.r_[False, again[:-1]]
        group, value = group[kept], value[kept]
        if not len(group):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names)
        a, b = forest(group, value.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(value[a]), pa.array(value[b])], names)

    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not batch.num_rows:
            continue
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        key, part, _ = columns
        last = (key == key[-1]) & (part == part[-1])
        first = int(np.argmax(last))
        held = [x[first:] for x in columns]
        if first:
            yield done(*(x[:first] for x in columns))
    if held is not None:
        yield done(*held)


def link_fingerprints(distinct: DataFrame, radius: int = 3, block_rows: int = 2048) -> DataFrame:
    """Links (a, b) between distinct ``fingerprint`` values, enough to connect all pairs within the radius.

    A key with more than ``block_rows`` fingerprints is dealt by hash into parts of about that many,
    and each pair of parts is compared in a task of its own, so no pair is lost and no task grows.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the key scheme is exact for a radius of at most 3")
    f, keys = F.col("fingerprint"), []
    for i in range(4):
        band = F.shiftrightunsigned(f, 16 * i).bitwiseAND(F.lit(0xFFFF))
        low = f.bitwiseAND(F.lit((1 << 16 * i) - 1))
        high = F.lit(0).cast("long") if i == 3 else F.shiftleft(F.shiftrightunsigned(f, 16 * (i + 1)), 16 * i)
        rest = low.bitwiseOR(high)
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((4 * i + j) << 28).cast("long") + F.shiftleft(band, 12) + part)
    keyed = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("key"))
    heavy = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    heavy = heavy.select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("parts"))
    dealt = keyed.join(heavy, "key", "left")
    mine = F.pmod(F.xxhash64(F.lit(7), "fingerprint"), F.col("parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.least(mine, other) * F.col("parts") + F.greatest(mine, other))
    dealt = dealt.select("key", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(pair)).alias("part"), "fingerprint")
    sorted_ = dealt.repartition("key", "part").sortWithinPartitions("key", "part")
    return sorted_.mapInArrow(lambda batches: block_links(batches, radius), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint: long, component_id) of every row.

    Rows are linked if their fingerprints differ in at most ``radius`` bits; ``component_id`` is the
    least doc_id reachable. Null and wordless texts have fingerprint 0 and are linked like any other. A
    null doc_id keeps its row; a component of nothing else has a null id. Repeated rows stay repeated.
    An empty table gives an empty one. Other columns, whatever their names, are left out.
    """
    prints = cut(fingerprints(docs, size, seed))
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    found = stars(link_fingerprints(classes.select("fingerprint"), radius))
    labelled = classes.join(found, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")
    )
    labelled = cut(labelled)
    ids = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = labelled.join(ids, "component").select("fingerprint", "component_id")
    return prints.join(by_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
