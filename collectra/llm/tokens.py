"""Exact token counts; huge documents by overlapping chunks that are spliced where both agree.

A position at which two overlapping encodings both begin a token is a proven common boundary if the
vocabulary can neither form a token across it nor let one side change the other. What proves that is read
from the vocabulary file (``Counter.proof``):

``parts``  white space is dropped before tokens are formed. Every position after white space is a boundary,
           and a shorter text's count is the sum over its white-space parts, whose counts are remembered.
``space``  a space between ASCII letters or digits begins a token (byte-level pre-tokenisers; pieces that
           hold the mark of a space at their front only).
``none``   nothing is proven; texts are encoded whole, however long.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_counters: dict[str, Counter] = {}
WHITE, MARK = " \t\n\r\f\v", "\u2581"
#: Normalisers that look at most at neighbouring characters of one white-space part.
LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "BertNormalizer"}
ALNUM = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def steps(spec: dict | None, inner: str) -> list[dict]:
    return [] if not spec else spec[inner] if spec["type"] == "Sequence" else [spec]


class Counter:
    """Counts with one vocabulary file: .json by tokenizers, .model by sentencepiece.

    Counts of white-space parts are remembered, up to ``memory`` parts.
    """

    def __init__(self, file: str, chunk: int = 16384, overlap: int = 256, memory: int = 500_000):
        self.chunk, self.overlap, self.memory, self.known = chunk, overlap, memory, {}
        if file.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            self.pieces = SentencePieceProcessor(model_file=file)
            self.proof = "space" if self.spaced_pieces(file) else "none"
            return
        if not file.endswith(".json"):
            raise ValueError("a vocabulary is a tokenizers .json or a sentencepiece .model file")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.pieces, self.tokenizer = None, Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(file, encoding="utf-8") as f:
            self.proof = self.proven(json.load(f))

    def proven(self, spec: dict) -> str:
        before, normal = steps(spec.get("pre_tokenizer"), "pretokenizers"), steps(spec.get("normalizer"), "normalizers")
        for t in spec.get("added_tokens") or []:
            if any(c.isspace() for c in t["content"]) or t.get("lstrip") or t.get("rstrip"):
                return "none"
        first = before[0] if before else {}
        if first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and len(before) == 1 and not normal:
            return "space"
        known = first.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or (
            first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
        )
        local = all(n["type"] in LOCAL or n == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for n in normal)
        return "parts" if known and local and all(map(self.drops, WHITE)) else "none"

    def drops(self, white: str) -> bool:
        """Whether no pre-token covers this character, whatever stands beside it."""
        around = ("a", "1", "!", "'", "\u00e9")
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        return all(b <= 1 or a > 1 for x in around for y in around for _, (a, b) in cut(x + white + y))

    def spaced_pieces(self, file: str) -> bool:
        """Whether the model takes text as it is and has no piece with the mark of a space after another character."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        plain = spec.name == "identity" and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        front = all(MARK not in p.piece.lstrip(MARK) and " " not in p.piece for p in model.pieces)
        return plain and front and not model.trainer_spec.treat_whitespace_as_suffix

    def count(self, text: str | None) -> int:
        return self.counts([text])[0]

    def counts(self, texts: list[str | None]) -> list[int]:
        if self.proof != "parts":
            short = [t or "" for t in texts if not t or len(t) <= self.chunk or self.proof == "none"]
            done = iter(self.lengths(short))
            return [self.spliced(t) if t and len(t) > self.chunk and self.proof == "space" else next(done) for t in texts]
        parts = [t.encode("utf-8", "surrogatepass").split() if t and len(t) <= self.chunk else () for t in texts]
        known = self.known
        if len(known) > self.memory:
            known.clear()
        new = list({w for p in parts for w in p if w not in known})
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            known.update(zip(some, self.lengths([w.decode("utf-8", "surrogatepass") for w in some]), strict=True))
        get = known.__getitem__
        return [self.spliced(t) if t and len(t) > self.chunk else sum(map(get, p)) for t, p in zip(texts, parts, strict=True)]

    def lengths(self, texts: list[str]) -> list[int]:
        if self.pieces:
            return list(map(len, self.pieces.encode(texts, num_threads=1)))
        return list(map(len, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)))

    def encode(self, text: str) -> list[int]:
        """Where each token starts, in code points."""
        if not self.pieces:
            return [a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets]
        at = np.array([p.begin for p in self.pieces.encode(text, return_type="proto").pieces], np.int64)
        lead = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
        return np.cumsum(np.r_[0, lead])[at].tolist()

    def resumed(self, text: str, at: int, end: int) -> list[int]:
        """Token starts from the proven boundary ``at`` on; sentencepiece itself puts the space there."""
        if self.pieces and at:
            return [a + 1 for a in self.encode(text[at + 1 : end])]
        return self.encode(text[at:end])

    def spliced(self, text: str) -> int:
        """Chunk by chunk: each overlaps the last; the splice is the first proven common boundary in the overlap."""
        at, total = 0, 0  # tokens before ``at`` are counted; ``at`` is a proven boundary
        end = min(len(text), self.chunk)
        left = self.encode(text[:end])
        while end < len(text):
            overlap, base = self.overlap, at
            while True:
                start = max(at, end - overlap)
                stop = min(len(text), start + self.chunk + overlap)
                right = self.encode(text[start:stop])
                cut = self.boundary(text, [base + a for a in left], [start + a for a in right], start, end)
                if cut is not None:
                    break
                if start == at:  # the overlap is all that is not counted: nothing to splice with, so grow the chunk
                    end = min(len(text), at + 2 * (end - at))
                    left = self.resumed(text, base, end)
                    if end == len(text):
                        return total + len(left)
                overlap *= 2
            total += sum(base + a < cut for a in left)
            left = [a + start - cut for a in right if start + a >= cut]
            at, end = cut, stop
        return total + len(left)

    def boundary(self, text: str, left: list[int], right: list[int], start: int, end: int) -> int | None:
        """The first proven boundary in the overlap (past its first part) at which both encodings start a token."""
        both = sorted({a for a in left if start < a < end} & set(right))
        if self.proof == "parts":
            return next((a for a in both if text[a - 1] in WHITE), None)
        return next((a for a in both if text[a] == " " and text[a - 1] in ALNUM and text[a + 1 : a + 2] in ALNUM), None)


def count_tokens(docs: DataFrame, file: str, limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole ``text``.

    ``file`` is a tokenizers .json or sentencepiece .model vocabulary at the same place on every machine.
    Null and empty texts have 0 bytes and tokens. Special strings inside texts count as the library's default says. Other
    columns are kept; the three new ones are overwritten.
    """
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(file) or _counters.setdefault(file, Counter(file))
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counter.counts(part.column(at).to_pylist()), pa.int64())], [*kept, "n_tokens"])

    counted = docs.select(*kept).mapInArrow(run, docs.select(*kept, F.lit(0).cast("long").alias("n_tokens")).schema)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select(*kept, n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
