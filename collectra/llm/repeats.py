"""Removal of repeated byte strings by suffix sorting, shard by shard.

A shard must hold all suffixes that may share ``length`` bytes. Sorting every suffix of the corpus
there would move ``length`` times its size, so places that can match are found first, without loss:

Exact copies go first: of equal texts only the one with the least doc_id matters, all bytes of the others
are covered if there are ``length`` of them. Copies inside one batch of rows are settled where they are
read, so of a copy group no more than a text a batch travels on; the rest meet in the folder that the
text's digest names.

1. Every ``length``-byte window names its anchor, the k-byte gram in it with the least hash (leftmost on
   ties). Equal windows have equal anchors. Each folder of documents (dealt by digest of the text) sends its
   distinct anchor hashes, six bytes each, to the hash's shard.
2. Shards tell folders which anchors occur in more than one document. For those a folder sends the
   anchor's context (the bytes of all windows that name it), once for each distinct one, with the least
   doc_id that holds it.
3. A shard sorts the suffixes of its contexts (``induce``). A run of suffixes with common prefixes of
   ``length`` or more is one string; its least doc_id decides. The folder gets a bit a window.
4. Folders mark the bytes under windows that start in a smaller document too, and cut them out.

A copy group of any size reaches a shard as one context a folder, so no key outgrows a task. Texts
travel compressed, in blocks of a few MB; nothing is collected on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .induce import suffixes

HASH_BITS, LAST = 47, np.iinfo(np.int64).max
#: Suffix shards a partition; more of them need less memory at a time.
SHARDS = 4
NOTE, REPLY, NAME, TEXT, DONE = 0, 1, 2, 3, 4
SCHEMA = "pid int, kind int, src int, blob binary"
Row = tuple[int, int, int, bytes]


def packed(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays one after the other, compressed; ``unpacked`` needs their types."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 8 * len(kinds)
    for n, kind in zip(np.frombuffer(data, np.int64, len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def joined(blobs: list[bytes]) -> bytes:
    return np.array([len(b) for b in blobs], np.int32).tobytes() + b"".join(blobs)


def part(blob: bytes, k: int, of: int) -> bytes:
    """The k-th of the blobs that ``joined`` made one."""
    sizes = np.frombuffer(blob, np.int32, of)
    at = 4 * of + int(sizes[:k].sum())
    return blob[at : at + int(sizes[k])]


def six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def dealt(values: np.ndarray, parts: int) -> np.ndarray:
    """A part for each 64-bit number."""
    h = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def digests(found: list[bytes]) -> np.ndarray:
    """(strings, 2): the 128-bit name of each string, as two numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), np.uint64).reshape(-1, 2)


def places(names: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``own`` are among ``names`` (both as of ``digests``; the latter sorted, by first number then second), and where."""
    spot = np.minimum(np.searchsorted(names[:, 0], own[:, 0]), len(names) - 1)
    while True:  # names that share the first number stand together
        on = (names[spot, 0] == own[:, 0]) & (names[spot, 1] < own[:, 1]) & (spot + 1 < len(names))
        if not on.any():
            break
        spot = spot + on
    hit = (names[spot] == own).all(axis=1)
    return np.flatnonzero(hit), spot[hit]


class Windows:
    """The anchors of all windows of some documents."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, data: np.ndarray, length: int):
        self.ids, self.lengths, self.data, self.length = ids, lengths, data, length
        self.starts = np.cumsum(lengths) - lengths
        k = max(2 * length // 5, length - 63)  # at most 64 windows name one anchor: a word of bits holds them
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        count = len(data) - length + 1
        none = np.zeros(0, np.int64)
        self.hash, self.first, self.last, self.doc = np.zeros(0, np.uint64), none, none, none
        if count <= 0:
            return
        low = self.lowest(self.grams(k) >> np.uint64(64 - HASH_BITS) << np.uint64(8), length - k + 1)[:count]
        at = np.flatnonzero(doc[:count] == doc[length - 1 :])
        if not len(at):
            return
        low = low[at]
        anchor = at + (low & np.uint64(255)).astype(np.int64)
        change = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[at[1:]] != doc[at[:-1]])]
        begin = np.flatnonzero(change)
        self.hash = low[begin] >> np.uint64(8)
        self.first, self.last = at[begin], at[np.r_[begin[1:], len(at)] - 1]
        self.doc = doc[self.first].astype(np.int64)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k bytes from each position on, by doubling."""
        power, width, at, out = self.data.astype(np.uint64) + np.uint64(1), 1, 0, None
        salt = np.uint64(0x9E3779B97F4A7C15)
        while width <= k:
            if k & width:
                out = power if out is None else out[: len(power) - at] * (salt | np.uint64(1)) + power[at : at + len(out)][: len(out)]
                at += width
            if width * 2 <= k:
                mult = np.uint64(0x9E3779B97F4A7C15 * (2 * width + 1) & (1 << 64) - 1 | 1)
                power = power[:-width] * mult + power[width:] if len(power) > width else power[:0]
            width *= 2
        h = (out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    @staticmethod
    def lowest(keys: np.ndarray, width: int) -> np.ndarray:
        """min over the next ``width`` keys of (hash, offset); offsets are the low eight bits."""
        span = 1
        while span < width:
            step = min(span, width - span)
            keys = np.minimum(keys[:-step], keys[step:] + np.uint64(step))
            span += step
        return keys

    def contexts(self, shared: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of the anchors whose hash is in ``shared`` (sorted), and their contexts."""
        spot = np.minimum(np.searchsorted(shared, self.hash), max(len(shared) - 1, 0))
        which = np.flatnonzero(shared[spot] == self.hash) if len(shared) else np.zeros(0, np.int64)
        raw = self.data.tobytes()
        ends = self.last[which] + self.length
        return which, [raw[a:b] for a, b in zip(self.first[which].tolist(), ends.tolist(), strict=True)]


def texts(parts: int, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs documents (doc_id, text as bytes) into compressed blocks by folder, after their names (digest, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array([x if x is not None else LAST for x in batch.column(0).to_pylist()], np.int64)
            data = [x or b"" for x in batch.column(1).to_pylist()]
            name = [xxhash.xxh3_128_digest(d) for d in data]
            least: dict[bytes, int] = {}
            for n, i in zip(name, ids.tolist(), strict=True):
                if i < least.get(n, LAST + 1):
                    least[n] = i
            first = ids == np.array([least[n] for n in name], np.int64)
            named = np.frombuffer(b"".join(name), np.uint64)[::2]
            folder = np.where(first, dealt(named, parts), dealt(ids, parts))
            order = np.lexsort((~first, folder))
            rows: list[Row] = []
            block: list[int] = []
            size = 0
            for k, i in enumerate(order.tolist()):
                block.append(i)
                size += len(data[i])
                following = order[k + 1] if k + 1 < len(order) else None
                if following is None or folder[following] != folder[i] or first[following] != first[i] or size > 4 << 20:
                    lengths, pid = np.array([len(data[j]) for j in block], np.int64), int(folder[i])
                    if first[i]:
                        rows.append((pid, NAME, 0, packed(ids[block], np.frombuffer(b"".join(name[j] for j in block), np.uint8))))
                        rows.append((pid, TEXT, 0, packed(ids[block], lengths, np.frombuffer(b"".join(data[j] for j in block), np.uint8), level=3)))
                    else:  # the same text has a smaller doc_id in this batch
                        rest = b"".join(data[j] for j in block if len(data[j]) < length)
                        rows.append((pid, DONE, 0, packed(ids[block], lengths, np.frombuffer(rest, np.uint8))))
                    block, size = [], 0
            yield from batched(iter(rows))

    return run


class Names:
    """The least doc_id of each text of a folder."""

    def __init__(self):
        self.least: dict[bytes, int] = {}

    def add(self, blob: bytes) -> None:
        ids, name = unpacked(blob, np.int64, np.uint8)
        raw = name.tobytes()
        for k, i in enumerate(ids.tolist()):
            n = raw[16 * k : 16 * k + 16]
            if i < self.least.get(n, LAST + 1):
                self.least[n] = i

    def windows(self, blob: bytes, length: int, once: set[bytes] | None = None) -> tuple[Windows, list[bool]]:
        """The windows of a block's texts without those of copies (with ``once``: also of repeated rows)."""
        ids, lengths, data = unpacked(blob, np.int64, np.int64, np.uint8)
        raw, ends, keep = data.tobytes(), np.cumsum(lengths), []
        for i, b, n in zip(ids.tolist(), ends.tolist(), lengths.tolist(), strict=True):
            name = xxhash.xxh3_128_digest(raw[b - n : b])
            good = self.least[name] == i and (once is None or name not in once)
            if once is not None and good:
                once.add(name)
            keep.append(good)
        if all(keep):
            return Windows(ids, lengths, data, length), keep
        chosen = np.array(keep, bool)
        return Windows(ids[chosen], lengths[chosen], data[np.repeat(chosen, lengths)], length), keep


def batched(rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
    held: list[Row] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[3]) + 32
        if size > 8 << 20:
            yield record(held)
            held, size = [], 0
    if held:
        yield record(held)


def record(rows: list[Row]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.int32()), pa.array(d, pa.binary())], ["pid", "kind", "src", "blob"])


def by_pid(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[Row]]:
    """Runs of rows with one pid, from rows sorted by (pid, kind)."""
    from itertools import groupby

    def rows() -> Iterator[Row]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), (x.as_py() for x in batch.column(3)), strict=True)

    for _, run in groupby(rows(), key=lambda r: r[0]):
        yield run


def dealt_rows(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "pid").sortWithinPartitions("pid", "kind")


def anchors(parts: int, length: int) -> Callable:
    """Folders: texts -> distinct anchor hashes by shard; the lowest bit says that two documents hold it."""

    def folder(rows: Iterator[Row]) -> Iterator[Row]:
        hashes, docs, pid, names, once, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, Names(), set(), 0
        for pid, kind, _, blob in rows:
            if kind == NAME:
                names.add(blob)
            elif kind == TEXT:
                w, _ = names.windows(blob, length, once)
                hashes.append(w.hash)
                docs.append(base + w.doc)
                base += len(w.ids)
        h, d = np.concatenate(hashes), np.concatenate(docs)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        if not len(start):
            return
        several = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)
        h = h[start]
        shard = dealt(h, parts)
        order = np.argsort(shard, kind="stable")
        entry, shard = (h << np.uint64(1) | several.astype(np.uint64))[order], shard[order]
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True):
            yield int(shard[a]), NOTE, pid, six(entry[a:b])

    return lambda batches: batched(r for run in by_pid(batches) for r in folder(run))


def shared_anchors() -> Callable:
    """Shards: hashes by folder -> to each folder those that more than one document holds."""

    def shard(rows: Iterator[Row]) -> Iterator[Row]:
        parts, own, pid = [], [], 0
        for pid, _, src, blob in rows:
            parts.append(unsix(blob))
            own.append(np.full(len(parts[-1]), src, np.int32))
        entry, src = np.concatenate(parts), np.concatenate(own)
        h = entry >> np.uint64(1)
        order = np.argsort(h, kind="stable")
        h, entry, src = h[order], entry[order], src[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[start, len(h)])
        good = (size > 1) | (np.bitwise_or.reduceat(entry, start) & np.uint64(1) > 0)
        keep = np.repeat(good, size)
        h, src = h[keep], src[keep]
        if not len(src):  # nothing in this shard is shared
            return
        order = np.argsort(src, kind="stable")
        h, src = h[order], src[order]
        cuts = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(src)], strict=True):
            yield int(src[a]), NOTE, pid, six(h[a:b])

    return lambda batches: batched(r for run in by_pid(batches) for r in shard(run))


def contexts(parts: int, length: int) -> Callable:
    """Folders: shared anchors and texts -> distinct contexts by shard, with the least doc_id and whether another has it."""

    def folder(rows: Iterator[Row]) -> Iterator[Row]:
        notes, shared, pid, names, once = [], None, 0, Names(), set()
        least: dict[bytes, list[int]] = {}
        for pid, kind, _, blob in rows:
            if kind == NOTE:
                notes.append(unsix(blob))
            elif kind == NAME:
                names.add(blob)
            if kind != TEXT:
                continue
            if shared is None:
                shared = np.sort(np.concatenate(notes)) if notes else np.zeros(0, np.uint64)
            w, _ = names.windows(blob, length, once)
            which, found = w.contexts(shared)
            for c, h, d in zip(found, w.hash[which].tolist(), w.ids[w.doc[which]].tolist(), strict=True):
                if (seen := least.get(c)) is None:
                    least[c] = [d, 0, h]
                elif seen[0] != d:
                    seen[0], seen[1] = min(seen[0], d), 1
        if not least:
            return
        told = list(least)
        about = np.array(list(least.values()), np.int64)
        fine = dealt(about[:, 2], SHARDS * parts)
        order = np.argsort(fine, kind="stable")
        fine = fine[order]
        cuts = np.searchsorted(fine, np.arange(SHARDS * parts + 1)).tolist()
        for shard in range(parts):
            if cuts[SHARDS * shard] == cuts[SHARDS * (shard + 1)]:
                continue
            blobs = []
            for a, b in zip(cuts[SHARDS * shard : SHARDS * (shard + 1)], cuts[SHARDS * shard + 1 :], strict=False):
                own = order[a:b]
                some = [told[i] for i in own]
                blobs.append(packed(about[own, 0], about[own, 1].astype(np.uint8), np.array([len(c) for c in some], np.int32), np.frombuffer(b"".join(some), np.uint8)))
            yield shard, NOTE, pid, joined(blobs)

    return lambda batches: batched(r for run in by_pid(batches) for r in folder(run))


def least_documents(found: list[bytes], least: np.ndarray, length: int, memory: int) -> np.ndarray:
    """(contexts, windows): the least doc_id of each window's string, from the suffix order of all contexts."""
    sizes = np.array([len(c) for c in found], np.int64)
    text = np.frombuffer(b"\0".join(found) + b"\0", np.uint8)
    owner = np.repeat(np.arange(len(found), dtype=np.int32), sizes + 1)
    offset = (np.arange(len(text)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)).astype(np.int32)
    whole = offset + length <= sizes[owner]
    out = np.full((len(found), int(sizes.max()) - length + 1), LAST, np.int64)
    for pos, lcp in suffixes(text, length, memory):
        start = np.flatnonzero(np.r_[True, lcp[1:] < length])
        mine = np.where(whole[pos], least[owner[pos]], LAST)
        low = np.repeat(np.minimum.reduceat(mine, start), np.diff(np.r_[start, len(pos)]))
        ok = whole[pos]
        out[owner[pos[ok]], offset[pos[ok]]] = low[ok]
    return out


def replies(length: int, memory: int) -> Callable:
    """Shards: contexts by folder -> by folder (digest, least doc_id there, bits of its windows that a smaller document has)."""

    def answers(sent: list[tuple[int, bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        number: dict[bytes, int] = {}
        known = []
        for src, blob in sent:
            doc, several, sizes, data = unpacked(blob, np.int64, np.uint8, np.int32, np.uint8)
            raw, ends = data.tobytes(), np.cumsum(sizes)
            some = (raw[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True))
            known.append((src, doc, several, np.fromiter((number.setdefault(c, len(number)) for c in some), np.int64, len(sizes))))
        if not number:
            return
        least = np.full(len(number), LAST, np.int64)
        for _, doc, _, at in known:
            np.minimum.at(least, at, doc)
        found = list(number)
        del number
        low = least_documents(found, least, length, memory)
        digest = digests(found)
        weight = np.uint64(1) << np.arange(low.shape[1], dtype=np.uint64)
        for src, doc, several, at in known:
            bits = np.zeros(len(at), np.uint64)
            for i in range(0, len(at), 65536):
                bits[i : i + 65536] = ((low[at[i : i + 65536]] < doc[i : i + 65536, None]) * weight).sum(axis=1, dtype=np.uint64)
            told = (bits > 0) | (several > 0)
            if told.any():
                yield src, digest[at[told]].ravel(), doc[told], bits[told]

    def shard(rows: Iterator[Row]) -> Iterator[Row]:
        got = list(rows)
        out: dict[int, list] = {}
        for k in range(SHARDS):
            for src, *arrays in answers([(r[2], part(r[3], k, SHARDS)) for r in got]):
                out.setdefault(src, []).append(arrays)
        for src, parts in out.items():
            yield src, REPLY, got[0][0], packed(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return lambda batches: batched(r for run in by_pid(batches) for r in shard(run))


def removals(length: int) -> Callable:
    """Folders: shared anchors, replies and texts -> by document its length, removed spans and what is left."""
    names = ["doc_id", "n_bytes", "spans", "kept"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def batch(rows: list[tuple[int, int, list, bytes]]) -> pa.RecordBatch:
        ids, sizes, spans, kept = zip(*rows, strict=True)
        ids = [None if i == LAST else i for i in ids]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names)

    def copy(i: int, n: int, text: bytes) -> tuple[int, int, list, bytes]:
        return (i, n, [{"start": 0, "end": n}], b"") if n >= length else (i, n, [], text)

    def block(w: Windows, shared: np.ndarray, digest: np.ndarray, least: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, int, list, bytes]]:
        marks = np.zeros(len(w.data) + 1, np.int32)
        which, found = w.contexts(shared)
        if len(digest) and len(found):
            hit, spot = places(digest, digests(found))
            which = which[hit]
            later = w.ids[w.doc[which]] > least[spot]
            width = w.last[which] - w.first[which] + 1
            mask = np.where(later, ~np.uint64(0), bits[spot])
            for o in range(int(width.max(initial=0))):
                at = w.first[which[(width > o) & (mask >> np.uint64(o) & np.uint64(1) > 0)]] + o
                np.add.at(marks, at, 1)
                np.add.at(marks, at + length, -1)
        gone = np.cumsum(marks)[:-1] > 0
        for i, a, n in zip(w.ids.tolist(), w.starts.tolist(), w.lengths.tolist(), strict=True):
            mine, data = gone[a : a + n], w.data[a : a + n]
            if mine.any():
                edge = np.flatnonzero(np.diff(np.r_[0, mine.view(np.int8), 0]))
                yield i, n, [{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()], data[~mine].tobytes()
            else:
                yield i, n, [], data.tobytes()

    def folder(rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
        notes, got, told, known = [], [], None, Names()
        for _, kind, _, blob in rows:
            if kind == NOTE:
                notes.append(unsix(blob))
            elif kind == REPLY:
                got.append(unpacked(blob, np.uint64, np.int64, np.uint64))
            elif kind == NAME:
                known.add(blob)
            elif kind == DONE:
                ids, lengths, rest = unpacked(blob, np.int64, np.int64, np.uint8)
                raw, at, out = rest.tobytes(), 0, []
                for i, n in zip(ids.tolist(), lengths.tolist(), strict=True):
                    out.append(copy(i, n, raw[at : at + n]))
                    at += n if n < length else 0
                yield batch(out)
            else:
                if told is None:
                    shared = np.sort(np.concatenate(notes)) if notes else np.zeros(0, np.uint64)
                    digest, least, bits = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
                    digest = digest.reshape(-1, 2)
                    order = np.lexsort((digest[:, 1], digest[:, 0]))
                    told = shared, digest[order], least[order], bits[order]
                w, own = known.windows(blob, length)
                out = list(block(w, *told))
                if not all(own):
                    ids, lengths, data = unpacked(blob, np.int64, np.int64, np.uint8)
                    raw, ends = data.tobytes(), np.cumsum(lengths)
                    out += [copy(i, n, raw[b - n : b]) for i, n, b, o in zip(ids.tolist(), lengths.tolist(), ends.tolist(), own, strict=True) if not o]
                yield batch(out)

    return lambda batches: (b for run in by_pid(batches) for b in folder(run))


def remove_repeats(docs: DataFrame, length: int = 50, memory: int = 128 << 20, folder_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, n_bytes, spans: removed [start, end) in bytes, kept: the remaining bytes) of every row.

    Bytes covered by a ``length``-byte string that also starts in a document with a smaller doc_id go.
    Null text: empty. A null doc_id counts as greater than all others; rows that share an id are not
    smaller than each other. Texts shorter than ``length`` stay whole. Empty table: no rows. Other columns,
    whatever their names, are left out. ``memory`` is what a shard's queues hold before they spill. There
    are as many folders and shards as the session has shuffle partitions, and more where a folder would
    else get over ``folder_bytes`` of text, so a task's memory does not grow with the corpus.
    """
    if not 8 <= length <= 128:
        raise ValueError("length is 8 to 128")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "utf-8").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // folder_bytes))
    folders = plain.mapInArrow(texts(parts, length), SCHEMA)
    sent = dealt_rows(folders, parts).mapInArrow(anchors(parts, length), SCHEMA)
    notes = cut(dealt_rows(sent, parts).mapInArrow(shared_anchors(), SCHEMA))
    sent = dealt_rows(folders.unionByName(notes), parts).mapInArrow(contexts(parts, length), SCHEMA)
    answers = cut(dealt_rows(sent, parts).mapInArrow(replies(length, memory), SCHEMA))
    done = dealt_rows(folders.unionByName(notes).unionByName(answers), parts)
    return done.mapInArrow(removals(length), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
