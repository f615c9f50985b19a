"""SimHash near-duplicates at a similarity of word shingles: the operator of ``simhash`` with another key scheme and a check.

A text is the set of its distinct ``size``-word shingles (64-bit hashes). Two sets of similarity p / q or more
share one among their first n - ceil(p n / q) + 1 in any one order of all shingles, so such a shingle is the key
that names a block, and no pair is lost by blocking. The order is by hash, with shingles that begin too many texts
put last. In a block, ``bits``-wide SimHash fingerprints of the sets are compared bit-sliced (``simhash.within``);
pairs within the radius are candidates, and what is linked is decided on all shingles of both texts.

A pair of similarity 0.8 differs in 15 % of its fingerprint bits, 19 % where texts have a handful of shingles: 39 to 48
of 256 with a deviation of 6. The radius of 80 passes it over with a chance below one in a million. At 80 bits two
sets share about 0.39 of their shingles, so few texts are checked in vain.

First each text is checked against one candidate of each block. Most copies are connected after that. Texts that
still have candidates they are not connected with are grouped by them, and in a group all pairs that are apart are
checked, part against part in tasks of their own; no pair is ever a row there, and each text travels once a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.traverse import stars
from .common import cut
from .simhash import near, unite

LANES, BASE = np.uint64(0x0101010101010101), np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """64-bit hashes of words; up to ``memory`` words are remembered."""

    memory = 100_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.memory:
            self[word] = value
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[bytes | None], size: int, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(all texts' distinct shingle hashes, sorted in each text; how many each text has). A text of fewer words is one shingle, one without has none."""
    split = [(t or b"").lower().split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    get = words.__getitem__
    ids = np.fromiter((h for w in split for h in map(get, w)), np.uint64, int(counts.sum()))
    starts = np.cumsum(counts) - counts
    n = np.where(counts >= size, counts - size + 1, counts > 0)
    first = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    short = np.repeat(counts < size, n)
    h = np.zeros(len(first), np.uint64)
    padded = np.r_[ids, np.zeros(size, np.uint64)]
    for k in range(size):
        h = h * BASE + padded[first + k] + np.uint64(1)
    h = mixed(h)
    if short.any():
        at = np.flatnonzero(short)
        owner = np.repeat(np.arange(len(texts)), n)[at]
        h[at] = [xxhash.xxh3_64_intdigest(b" ".join(split[o]), 1) for o in owner.tolist()]
    ends = np.cumsum(n)
    pieces = [np.unique(h[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
    return np.concatenate([*pieces, np.zeros(0, np.uint64)]), np.array([len(p) for p in pieces], np.int64)


def names_of(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Equal sets have equal names; 0 is that of texts without words."""
    raw, ends = memoryview(grams.tobytes()), np.cumsum(n) * 8
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(raw[b - 8 * k : b]) if k else 0 for b, k in zip(ends.tolist(), n.tolist(), strict=True)), np.uint64, len(n)).view(np.int64)


def fingerprints(grams: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """(texts, bits / 64): a bit is 1 if set in over half of the text's shingles, each hashed once a word."""
    out = np.zeros((len(n), bits // 64), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    starts, own = (np.cumsum(n) - n)[some], n[some]
    parts = -(-own // 255)  # byte sums hold up to 255 ones
    cuts = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    edge = np.cumsum(parts) - parts
    for w in range(bits // 64):
        h = mixed(grams * np.uint64(2 * w + 1) + np.uint64(int(BASE) * (w + 1) % 2**64))
        ones = np.zeros((len(some), 64), np.int64)
        for b in range(8):
            sums = np.add.reduceat((h >> np.uint64(b)) & LANES, cuts)
            ones[:, b::8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), edge, axis=0)
        out[some, w] = np.packbits(2 * ones > own[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def prefixes(grams: np.ndarray, n: np.ndarray, similarity: tuple[int, int], last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the first shingles by hash, those in ``last`` (sorted) after all others; and how many. A set as similar has one of them."""
    p, q = similarity
    owner = np.repeat(np.arange(len(n)), n)
    if len(last) and len(grams):
        bits = np.zeros(1 << 20, bool)
        bits[last >> np.uint64(44)] = True
        late = bits[grams >> np.uint64(44)]
        at = np.flatnonzero(late)
        late[at] = last[np.minimum(np.searchsorted(last, grams[at]), len(last) - 1)] == grams[at]
        grams = grams[np.argsort(owner * 2 + late, kind="stable")]
    m = np.where(n > 0, n + (-p * n // q) + 1, 0)
    place = np.arange(len(grams)) - np.repeat(np.cumsum(n) - n, n)
    return grams[place < np.repeat(m, n)], m


def read(batches: Iterator[pa.RecordBatch], size: int, words: Words, step: int = 250) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows at a time (the last column is the text): the rows, their shingles, how many."""
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            grams, n = shingle_sets([x.as_py() for x in part.column(part.num_columns - 1)], size, words)
            yield part, grams, n


def arrays(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(values.view(np.int64)))


def beginnings(texts: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """(gram, texts): how many texts each prefix shingle begins; equal texts read together count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for _, grams, n in read(batches, size, words):
            names = names_of(grams, n)
            kept = np.zeros(len(n), bool)
            kept[np.unique(names, return_index=True)[1]] = True
            grams, n = grams[np.repeat(kept, n)], n[kept]
            found, times = np.unique(prefixes(grams, n, similarity, np.zeros(0, np.uint64))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], ["gram", "texts"])

    return texts.mapInArrow(run, "gram long, texts long").groupBy("gram").agg(F.sum("texts").alias("texts"))


def described(texts: DataFrame, size: int, similarity: tuple[int, int], bits: int, last: np.ndarray) -> DataFrame:
    """(doc_id, tie, row, n, print, grams) of every row: the set's name and size, its fingerprint, its first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part, grams, n in read(batches, size, words):
            raw, w = fingerprints(grams, n, bits).tobytes(), bits // 8
            prints = pa.array([raw[w * i : w * i + w] for i in range(len(n))], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(names_of(grams, n)), pa.array(n.astype(np.int32)), prints, arrays(*prefixes(grams, n, similarity, last))],
                ["doc_id", "tie", "row", "n", "print", "grams"],
            )

    return texts.mapInArrow(run, "doc_id long, tie long, row long, n int, print binary, grams array<long>")


def whole_sets(texts: DataFrame, size: int) -> DataFrame:
    """(row, grams) of every row, all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for _, grams, n in read(batches, size, words):
            yield pa.RecordBatch.from_arrays([pa.array(names_of(grams, n)), arrays(grams, n)], ["row", "grams"])

    return texts.mapInArrow(run, "row long, grams array<long>")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Rows sorted by their first two columns, whole groups at a time, as columns."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        one, two = held.column(0).to_numpy(), held.column(1).to_numpy()
        first = int(np.argmax((one == one[-1]) & (two == two[-1])))
        if first:
            yield [c.combine_chunks() for c in held.slice(0, first).columns]
            held = held.slice(first)
    if held is not None:
        yield [c.combine_chunks() for c in held.columns]


def candidates(at: DataFrame, similarity: tuple[int, int], radius: int, block_rows: int, spanning: bool) -> DataFrame:
    """Pairs (a, b) of rows that share a gram, are near and apart (``c`` differs), at most one a row and block.

    With ``spanning`` they connect what near pairs connect (a and b themselves may be farther apart); else b is
    a's least-named near row, or its next one. Every row with a near one is in a pair. A gram with more than
    ``block_rows`` rows is dealt into parts, and each pair of parts is a block.
    """
    p, q = similarity
    parts = F.ceil(F.col("texts") / block_rows).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(7), "row"), F.col("parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.least(mine, other) * F.col("parts") + F.greatest(mine, other))
    dealt = at.withColumn("parts", parts).select("gram", F.explode(F.when(F.col("parts") < 2, F.array(F.lit(0))).otherwise(pair)).alias("part"), "row", "n", "c", "print")
    dealt = dealt.repartition("gram", "part").sortWithinPartitions("gram", "part", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in grouped(batches):
            key, part, row, n, c = (x.to_numpy(zero_copy_only=False) for x in columns[:5])
            prints = np.frombuffer(b"".join(columns[5].to_pylist()), np.uint64).reshape(len(row), -1)
            group, none = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]), len(row)
            parent, before, after = np.arange(none), np.full(none, none), np.full(none, none)
            for a, b in near(group, prints, radius):
                good = (c[a] != c[b]) & (np.minimum(n[a], n[b]) * q >= np.maximum(n[a], n[b]) * p)
                a, b = a[good], b[good]
                if spanning:
                    unite(parent, a, b)
                else:
                    np.minimum.at(before, b, a)
                    np.minimum.at(after, a, b)
            best = parent if spanning else np.where(before < none, before, after)
            at = np.flatnonzero((best < none) & (best != np.arange(none)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(row[best[at]])], ["a", "b"])

    found = dealt.mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def overlaps(grams: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """(left, right): how many shingles each text of ``left`` shares with each of ``right``, by bitmaps over the shared ones."""
    _, name, times = np.unique(grams, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    owner, kept = np.repeat(np.arange(len(n)), n), times[name] > 1
    owner, name = owner[kept], number[name[kept]]
    turn = np.argsort(name, kind="stable")
    owner, name = owner[turn], name[turn]
    out = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, int(name[-1]) + 1 if len(name) else 0, step):
        a, b = np.searchsorted(name, (low, low + step))
        bits = np.zeros((len(n), step), bool)
        bits[owner[a:b], name[a:b] - low] = True
        words = np.packbits(bits[:, : -(-min(step, int(name[b - 1]) - low + 1) // 64) * 64], axis=1).view(np.uint64)
        other = words[right]
        for i, x in enumerate(left.tolist()):
            out[i] += np.bitwise_count(words[x] & other).sum(axis=1, dtype=np.int64)
    return out


def checked(groups: DataFrame, similarity: tuple[int, int], part_rows: int = 512) -> DataFrame:
    """Links (a, b) that connect what pairs of the similarity connect, of rows (row, component, c, grams) in one ``component`` and apart (``c`` differs).

    A component's rows are dealt into parts, and each pair of parts is compared in a task of its own; rows of the
    component's commonest ``c``, if that has most of them, are not compared with each other.
    """
    p, q = similarity
    by_c = groups.groupBy("component", "c").agg(F.count(F.lit(1)).alias("_n"))
    about = by_c.groupBy(F.col("component").alias("_k")).agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "c")).alias("_top"))
    main = F.when(F.col("_top._n") * 2 > F.col("_all"), F.col("_top._n")).otherwise(F.lit(0))
    about = about.select("_k", F.col("_top.c").alias("_c"), F.ceil(main / part_rows).cast("long").alias("pm"), F.ceil((F.col("_all") - main) / part_rows).cast("long").alias("po"))
    u = F.xxhash64(F.lit(9), "row")
    others, mains = F.sequence(F.lit(0).cast("long"), F.col("po") - 1), F.sequence(F.lit(0).cast("long"), F.col("pm") - 1)
    mo, mm = F.pmod(u, F.greatest("po", F.lit(1))), F.pmod(u, F.greatest("pm", F.lit(1)))

    def place(code: Column, side: Column) -> Column:
        return F.struct(code.cast("long").alias("part"), side.cast("int").alias("side"))

    as_main = F.transform(others, lambda i: place(F.col("po") * F.col("po") + i * F.col("pm") + mm, F.lit(1)))
    as_other = F.transform(others, lambda i: place(F.least(mo, i) * F.col("po") + F.greatest(mo, i), F.when(i < mo, 1).otherwise(0)))
    with_mains = F.when(F.col("pm") > 0, F.transform(mains, lambda j: place(F.col("po") * F.col("po") + mo * F.col("pm") + j, F.lit(0)))).otherwise(F.array().cast("array<struct<part:long,side:int>>"))
    is_main = (F.col("pm") > 0) & (F.col("c") == F.col("_c"))
    places = F.when(F.col("po") < 1, F.array().cast("array<struct<part:long,side:int>>")).when(is_main, as_main).otherwise(F.concat(as_other, with_mains))
    dealt = groups.join(about, F.col("component") == F.col("_k")).select("component", F.explode(places).alias("at"), "row", "c", "grams")
    dealt = dealt.select("component", "at.part", "at.side", "row", "c", "grams").repartition("component", "part").sortWithinPartitions("component", "part", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in grouped(batches):
            key, part, side, row, c = (x.to_numpy(zero_copy_only=False) for x in columns[:5])
            flat, offsets = columns[5].values.to_numpy(), columns[5].offsets.to_numpy()
            edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]), True])
            a_all, b_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                n, own, at = np.diff(offsets[x : y + 1]), c[x:y], side[x:y]
                left, right = (np.flatnonzero(at == 0), np.flatnonzero(at == 1)) if 0 < at.sum() < y - x else (np.arange(y - x),) * 2
                both = overlaps(flat[offsets[x] : offsets[y]], n, left, right)
                good = ((p + q) * both >= p * (n[left][:, None] + n[right][None, :])) & (own[left][:, None] != own[right][None, :])
                i, j = np.nonzero(good)
                parent = np.arange(y - x)
                unite(parent, left[i], right[j])
                linked = np.flatnonzero(parent != np.arange(y - x))
                a_all.append(row[x + linked])
                b_all.append(row[x + parent[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_all)), pa.array(np.concatenate(b_all))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, grams: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of rows whose sets reach the similarity."""
    p, q = similarity
    left = grams.select(F.col("row").alias("a"), F.col("grams").alias("x"))
    right = grams.select(F.col("row").alias("b"), F.col("grams").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where((p + q) * both >= p * (F.size("x") + F.size("y"))).select("a", "b")


def near_copies(
    docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (4, 5), heavy: int = 256, most: int = 200_000, bits: int = 256, radius: int = 80, block_rows: int = 2048, tie: Column | None = None
) -> DataFrame:
    """(doc_id, tie, component_id, component_tie) of every row: the least (doc_id, tie) that links of ``similarity`` or more reach.

    Texts without words are copies of each other. A null doc_id comes after all others, and ``tie`` (a long, 0 by
    default) orders rows that share an id; repeated rows stay repeated. Other columns, whatever their names, are
    left out. An empty table gives an empty one. A shingle that begins over ``heavy`` texts is put last (for ``most``
    shingles, the commonest first, as they are broadcast), which changes the work and not the result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(0) if tie is None else tie).cast("long").alias("tie"), F.col("text").cast("binary"))
    common = beginnings(texts.select("text"), size, similarity).where(F.col("texts") > heavy).orderBy(F.desc("texts"), "gram").limit(most)
    last = np.sort(common.select("gram").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
    rows = cut(described(texts, size, similarity, bits, last))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("least")
    classes = cut(rows.groupBy("row").agg(least))
    dealt = rows.groupBy("row").agg(F.any_value("grams").alias("grams")).select("row", F.explode("grams").alias("gram")).repartition("gram")
    shared = dealt.join(dealt.groupBy("gram").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "gram")
    one = rows.groupBy("row").agg(F.any_value("n").alias("n"), F.any_value("print").alias("print"))
    shared = cut(shared.join(one, "row").select("gram", "texts", "row", "n", F.col("row").alias("c"), "print"))
    pairs = cut(candidates(shared, similarity, radius, block_rows, False))
    asked = cut(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct())
    ids = classes.join(asked, "row", "left_semi").select(F.col("least.doc_id").alias("_i")).distinct()
    ids = F.broadcast(ids) if asked.count() <= 500_000 else ids
    grams = whole_sets(texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_i")), "left_semi").select("text"), size)
    grams = cut(grams.join(asked, "row", "left_semi").dropDuplicates(["row"]))
    links = cut(similar(pairs, grams, similarity))
    found = cut(stars(links)).select(F.col("node").alias("row"), F.col("component").alias("_c"))
    apart = shared.drop("c").join(asked, "row", "left_semi").join(found, "row", "left").withColumn("c", F.coalesce("_c", "row"))
    groups = stars(candidates(apart, similarity, radius, block_rows, True)).withColumnRenamed("node", "row")
    groups = groups.join(found, "row", "left").select("row", "component", F.coalesce("_c", "row").alias("c")).join(grams, "row")
    links = cut(links.unionByName(checked(groups, similarity)))
    found = stars(links).withColumnRenamed("node", "row")
    labelled = cut(classes.join(found, "row", "left").select("row", "least", F.coalesce("component", "row").alias("component")))
    ids = labelled.groupBy("component").agg(F.min("least").alias("first"))
    by_row = labelled.join(ids, "component").select("row", "first")
    return rows.select("doc_id", "tie", "row").join(by_row, "row").select("doc_id", "tie", F.col("first.doc_id").alias("component_id"), F.col("first.tie").alias("component_tie"))
