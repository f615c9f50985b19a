"""Language identification by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_letters: list[np.ndarray] = []
FINE = float(1 << 30)


def is_letter() -> np.ndarray:
    """By code point."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


class Space:
    """A random +-1 vector for every letter (code point) and one for the gap between words; n-grams bind permuted ones by multiplication.

    Vectors come from a hash of (seed, code point, place), so no table of letters is needed; up to ``memory`` of
    them are remembered.
    """

    def __init__(self, width: int = 1024, n: int = 3, seed: int = 29, memory: int = 8192):
        if width % 64:
            raise ValueError("width is a multiple of 64")
        self.width, self.n, self.seed, self.memory = width, n, seed, memory
        self.place: dict[int, int] = {}
        self.known = np.zeros((0, width), np.int8)

    def made(self, letters: np.ndarray) -> np.ndarray:
        """(letters, width): their vectors; 0 stands for the gap."""
        x = (letters.astype(np.uint64)[:, None] << np.uint64(16)) + np.arange(self.width // 64, dtype=np.uint64) + (np.uint64(self.seed) << np.uint64(40))
        for mult in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(mult)
            x ^= x >> np.uint64(31)
        bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little")
        return 1 - 2 * bits.view(np.int8)

    def vectors(self, letters: np.ndarray) -> np.ndarray:
        """As ``made``, remembered."""
        names = letters.tolist()
        new = [x for x in names if x not in self.place]
        if new:
            if len(self.place) + len(new) > self.memory:
                self.place, self.known = {}, self.known[:0]
                new = names
            self.place.update({x: len(self.place) + i for i, x in enumerate(new)})
            self.known = np.concatenate([self.known, self.made(np.array(new, np.int64))])
        return self.known[[self.place[x] for x in names]]

    def profile(self, text: str | None) -> np.ndarray | None:
        """The bundle of all n-grams of the whole text (words apart); None without a letter."""
        if not text:
            return None
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = np.where(is_letter()[cp], cp, 0).astype(np.int64)
        if not letter.any():
            return None
        letter = np.r_[0, letter, 0]
        letter = letter[np.r_[True, (letter[1:] > 0) | (letter[:-1] > 0)]]  # one gap between words
        letter = np.concatenate([np.zeros(max(0, self.n - len(letter)), np.int64), letter])
        alphabet, local = np.unique(letter, return_inverse=True)
        grams = code = local[: len(local) - self.n + 1]
        for k in range(1, self.n):  # numbers of the distinct n-grams, one letter at a time, so they never overflow
            code = code * len(alphabet) + local[k : k + len(code)]
            grams, code = np.unique(code, return_inverse=True)
        counts = np.bincount(code)
        where = np.zeros(len(counts), np.int64)
        where[code] = np.arange(len(code))  # a place of each n-gram
        permuted = [np.roll(self.vectors(alphabet), self.n - 1 - k, axis=1) for k in range(self.n)]
        out = np.zeros(self.width, np.float32)
        for i in range(0, len(counts), 4096):
            bound = None
            for k in range(self.n):
                one = permuted[k][local[where[i : i + 4096] + k]]
                bound = one if bound is None else bound * one
            out += counts[i : i + 4096].astype(np.float32) @ bound.astype(np.float32)
        return out


def unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.linalg.norm(v)), 1e-12)


def prototypes(labelled: DataFrame, space: Space, per_label: int = 4000, most_labels: int = 20_000) -> tuple[list[str], np.ndarray]:
    """Bundles of the labelled rows (doc_id, text, lang), one a language.

    The fit takes a seeded sample of about ``per_label`` rows of each language at most, dealt by id and text. Each
    task returns one sum a language, in whole numbers so that their order doesn't matter; they are added up by
    language, and the driver gets one vector a language: 8 KB each, over ``most_labels`` raise.
    """
    known = labelled.where("lang is not null")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    if counts.limit(most_labels + 1).count() > most_labels:
        raise ValueError(f"over {most_labels} languages")
    rates = F.broadcast(counts.select(F.col("lang").alias("_lang"), (F.lit(float(per_label)) / F.col("_n")).alias("_rate")))
    dealt = F.pmod(F.xxhash64(F.lit(31), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(rates, F.col("lang") == F.col("_lang")).where(dealt < F.col("_rate")).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (p := space.profile(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + np.rint(unit(p).astype(np.float64) * FINE).astype(np.int64)
        yield from told(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(raw, np.int64)
        yield from told(sums)

    def told(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()])], ["lang", "sum"])

    schema = "lang string, sum binary"
    rows = sorted((r[0], r[1]) for r in sample.mapInArrow(bundle, schema).repartition("lang").mapInArrow(add, schema).collect())
    if not rows:
        return [], np.zeros((0, space.width))
    return [r[0] for r in rows], np.stack([unit(np.frombuffer(r[1], np.int64) / FINE) for r in rows])


def identify(docs: DataFrame, labelled: DataFrame, width: int = 1024, n: int = 3, seed: int = 29) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine of the whole text's profile with the nearest prototype.

    Profiles and prototypes are compared after the mean prototype's share is taken off, which is what
    languages have in common. ``score`` lies in 0 to 1 (negative cosines count as 0). Null texts and texts without
    a letter: ``und``, 0. Ties go to the first language by code point. No labelled row: all ``und``. Repeated
    rows get equal answers, and each counts where it is learnt from; an empty table gives an empty one. Other
    columns are kept, except that ``lang_pred`` and ``score`` are overwritten. Languages: see ``prototypes``.
    """
    space = Space(width, n, seed)
    names, protos = prototypes(labelled, space)
    common = unit(protos.mean(axis=0)) if len(names) > 1 else np.zeros(width)
    centred = np.stack([unit(p - (p @ common) * common) for p in protos]) if len(names) else protos
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for x in batch.column(at):
                p = space.profile(x.as_py()) if names else None
                if p is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                cosine = centred @ unit(p - (p @ common) * common)
                best = int(np.argmax(cosine))
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosine[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    plain = docs.select(*kept)
    schema = plain.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return plain.mapInArrow(run, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    found = identify(docs.select(F.col("doc_id").cast("long"), "text", "held_out"), docs.where("not held_out").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")
