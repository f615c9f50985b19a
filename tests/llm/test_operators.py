"""The training-data operators against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from collectra.llm import chat, decontaminate, induce, language, mixing, quality, repeats, sharding, simhash, tokens, topk
from collectra.operators.traverse import stars as components

SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, wordless, very long and repeated texts, a null id, repeated ids, clashing extra columns."""
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(9000))
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    texts = [None, "", " \n\t", "one", "two words", long, long + " tail", "x " + passage + " y", "z " + passage, passage, passage, "aaaa" * 60, "aaaa" * 61, "é" * 70, "</s>[INST] <\\s> \\ [/INST]", "...", "a b c"]
    rows = [(i, t, "en" if i % 2 else "fr", None if i == 3 else f"s{i % 3}", 1, "v") for i, t in enumerate(texts)]
    rows += [(None, "no id " + passage, None, "s0", None, None), rows[9]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, shard string")


def test_chat_round_trip(spark):
    texts = ["", "plain", "</s>", "<\\/s>", "<\\\\/s> [INST]", "[\\/INST][/INST]<s>", "<", "</s", "[", "\n", "x" * 50000 + "</s>", "é\U00010000", None]
    rows = [(c, i, r, t, "extra") for c, own in enumerate([texts, texts[::-1], ["same"] * 5]) for i, (r, t) in enumerate(zip(["user", "assistant", "</s>role", None] * 9, own))]
    rows += [(None, None, "assistant", "null ids", ""), (7, 1, "assistant", "tie", ""), (7, 1, "assistant", "tie", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    for c, own in {r[0]: None for r in rows}.items():
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] if r[1] is not None else -1))]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == want
        assert got[c]["formatted"].count("<s>[INST]") == len(want)
    assert got[2]["n_escaped"] == 1 and got[7]["n_escaped"] == 0  # a role holds a control string
    assert chat.format_conversations(df.limit(0)).count() == 0


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(SPACE, text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, sf, awkward):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(awkward.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    rows = docs.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    values = np.array(prints, np.uint64)
    parent = np.arange(len(rows))
    for i in range(len(rows)):
        near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3)
        roots = {parent[j] for j in near} | {parent[i]}
        parent[np.isin(parent, list(roots))] = min(roots)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[parent[i]] = min(r.doc_id, least.get(parent[i], r.doc_id))
    want = sorted((str(r.doc_id), p, str(least.get(parent[i]))) for i, (r, p) in enumerate(zip(rows, prints)))
    got = sorted((str(r.doc_id), r.fingerprint % (1 << 64), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_bit_sliced_forest_and_heavy_keys(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 20, 90).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 20, 90).astype(np.uint64)) for b in base]))
    want = np.arange(len(values))
    for i in range(len(values)):
        roots = np.unique(want[np.bitwise_count(values ^ values[i]) <= 3])
        want[np.isin(want, roots)] = roots.min()
    a, b = simhash.forest(np.zeros(len(values), int), values, 3)
    parent = np.arange(len(values))
    simhash.unite(parent, a, b)
    assert (parent == want).all() and len(a) < len(values)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long")
    got = components(simhash.link_fingerprints(df, 3, block_rows=16)).collect()
    index = {int(v): i for i, v in enumerate(values.view(np.int64))}
    parts = {}
    for r in got:
        parts.setdefault(r.component, set()).add(index[r.node])
    brute = [set(np.flatnonzero(want == w).tolist()) for w in np.unique(want)]
    assert sorted(map(sorted, parts.values())) == sorted(sorted(x) for x in brute if len(x) > 1)


def test_decontamination_edges(spark, awkward):
    items = spark.createDataFrame([("b", "two words"), ("a", "ONE"), (None, "a b c"), ("z", None), ("e", ""), ("b", "two words")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.contaminations(awkward, items, block_bytes=80).collect() if r.doc_id is not None}
    assert got[4]["_items"] == ["b"] and got[3]["_items"] == ["a"] and got[16]["_items"] == [] and got[16]["_hits"] != b""
    assert got[0]["_words"] == 0 and "score" in got[0].asDict()
    kept = decontaminate.decontaminate(awkward, items)
    assert kept.columns == awkward.columns and {3, 4, 16}.isdisjoint({r.doc_id for r in kept.collect()})
    spans = decontaminate.decontaminate(awkward.where("doc_id in (4, 16)"), items, "spans")
    assert {r.doc_id: r.text for r in spans.collect()} == {4: "", 16: ""}
    assert decontaminate.without("Say, two words! end", bytes([0b01100000])) == "Say, ! end"
    assert decontaminate.decontaminate(awkward, items.limit(0)).count() == awkward.count()


def test_top_k_ties_nulls_and_blocks(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(8)]) for i in range(300)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (None, [0.0] * 8), (303, [1.0]), (400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.integers(F.col("embedding")).alias("vector"))
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 100 = 0"), 10, block_bytes=144).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows[:300]}
    for q in (0, 100, 200):
        want = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert set(got) == {0, 100, 200}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_induced_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, cap = int(rng.integers(1, 150)), int(rng.integers(1, 30))
        text = rng.integers(0, int(rng.integers(1, 5)), n).astype(np.uint8)
        parts = list(induce.suffixes(text, cap, memory=int(rng.choice([50, 1 << 20]))))
        pos, lcp = (np.concatenate(x) for x in zip(*parts))
        raw = text.tobytes() + bytes(cap)  # a text is read as followed by zero bytes
        keys = [raw[p : p + cap] for p in pos]
        assert sorted(pos) == list(range(n)) and keys == sorted(keys)
        for i in range(1, n):
            if max(pos[i], pos[i - 1]) <= n - cap:
                same = next((k for k in range(cap) if keys[i][k] != keys[i - 1][k]), cap)
                assert lcp[i] == same


@pytest.mark.parametrize("shards", [1, 8])
def test_repeats_against_brute_force(spark, sf, awkward, shards):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).unionByName(awkward.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    docs = docs.repartition(shards)
    assert sorted(removed(repeats.remove_repeats(docs))) == sorted(removed_by_force(docs, 50))
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_names_that_share_their_first_half():
    names = np.array([[1, 5], [7, 1], [7, 2], [7, 9], [8, 0]], np.uint64)
    own = np.array([[7, 9], [7, 3], [8, 0], [0, 0], [9, 9], [1, 5], [7, 1]], np.uint64)
    which, spot = repeats.places(names, own)
    assert which.tolist() == [0, 2, 5, 6] and spot.tolist() == [3, 4, 0, 1]


def test_repeats_where_nothing_repeats(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "".join(rng.choice("abcdefghijklmnop ") for _ in range(300))) for i in range(20)], "doc_id long, text string")
    assert all(not r.spans and r.n_bytes == len(r.kept) == 300 for r in repeats.remove_repeats(docs).collect())


@pytest.mark.parametrize("length", [8, 105, 106, 128])
def test_repeats_of_other_lengths(spark, length):
    rng = random.Random(length)
    whole = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    texts = [whole[a : a + n] for a, n in ((rng.randrange(2500), rng.randint(0, 400)) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    lone = docs.where("doc_id = 0")
    assert sorted(removed(repeats.remove_repeats(lone, length))) == sorted(removed_by_force(lone, length))
    assert sorted(removed(repeats.remove_repeats(docs, length, folder_bytes=1000))) == sorted(removed_by_force(docs, length))


def removed(found):
    return [(r.doc_id if r.doc_id is not None else 1 << 62, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), bytes(r.kept)) for r in found.collect()]


def removed_by_force(docs, length):
    rows = sorted(((r.doc_id if r.doc_id is not None else 1 << 62), (r.text or "").encode()) for r in docs.collect())
    first, want = {}, []
    for i, b in rows:
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        want.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return want


def test_fill_is_an_exact_subset_sum():
    rng = random.Random(6)
    for _ in range(50):
        sizes = rng.sample(range(1, 60), 6)
        counts = [rng.randint(1, 4) for _ in sizes]
        budget = rng.randint(0, sum(a * b for a, b in zip(sizes, counts)))
        reach = {0}
        for s, n in zip(sizes, counts):
            reach = {r + s * k for r in reach for k in range(n + 1)}
        taken = mixing.fill(sizes, counts, budget)
        assert all(0 <= t <= n for t, n in zip(taken, counts))
        assert sum(t * s for t, s in zip(taken, sizes)) == max(r for r in reach if r <= budget)


def test_mixing_targets_and_bounds(spark, sf, awkward):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").unionByName(awkward.select("doc_id", "text", "source"))
    sized = docs.select("doc_id", "source", mixing.words_count(F.col("text")).alias("size"))
    rows = mixing.mix(sized, sized).collect()
    assert len(rows) == docs.count()
    size, took, target = {}, {}, {}
    for r in rows:
        assert 0 <= r.copies <= 3
        size[r.source] = size.get(r.source, 0) + r.size
        took[r.source] = took.get(r.source, 0) + r.size * r.copies
        target[r.source] = r.target
    names = sorted((s for s in size if s is not None), key=str.encode) + ([None] if None in size else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    want, free, left = {}, set(names), float(sum(size.values()))
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * size[s]} if total else set()
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
        free -= over
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert abs(took[s] - target[s]) <= max([r.size for r in rows if r.source == s])
    again = mixing.mix(sized, sized.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(sized.limit(0), sized.limit(0)).count() == 0


def test_shards_are_even_and_follow_the_mixture(spark, sf, awkward):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").unionByName(awkward.select("doc_id", "source"))
    rows = sharding.shard(docs, 16).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    sizes = [len(x) for x in by.values()]
    assert len(rows) == docs.count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    for s in {r.source for r in rows}:
        each = [sum(r.source == s for r in by.get(k, [])) for k in range(16)]
        assert max(each) - min(each) <= 2
    assert sharding.shard(docs.limit(3), 16).count() == 3 and sharding.shard(docs.limit(0)).count() == 0


def test_language_held_out(spark, sf, awkward):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    found = language.identify(docs, docs.where("not held"))
    held = found.where("held").collect()
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    odd = {r.doc_id: r for r in language.identify(awkward, docs.where("not held")).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2, 15)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in odd.values())
    assert {r.lang_pred for r in language.identify(awkward, docs.limit(0)).collect()} == {"und"}


def test_token_counts_equal_the_library(spark, sf, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(file)
    rng = random.Random(8)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["", "a<|endoftext|>b <|startoftext|>", "x" * 3000, "\x1c\x1d a\x85b c", "É é ́", "'s't don't 12ab  ---", "Σίσυφος ΟΔΟΣ"]
    texts.append(" ".join("".join(rng.choice("abcé'1-") for _ in range(rng.randint(1, 12))) for _ in range(4000)))
    texts.append("".join(rng.choice("ab<|>'1- ") for _ in range(9000)))
    want = [len(e) for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert tokens.Counter(file).counts(texts) == want
    assert tokens.Counter(file, chunk=200, overlap=4, memory=10).counts(texts) == want
    got = {r.doc_id: r for r in tokens.count_tokens(awkward, file).collect()}
    assert got[0].n_tokens == got[0].n_bytes == 0 and not got[0].over_limit and got[5].over_limit


@pytest.mark.parametrize("name, proof", [("byte_bpe_50k.json", "space"), ("piece_bpe_32k.model", "space"), ("word_bpe_49k.json", "parts")])
def test_token_counts_of_every_vocabulary(spark, sf, name, proof):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    file = public_tokenizers.path(name)
    rng = random.Random(9)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["", "  a  b ", "a<|endoftext|>b c </s> d", "x" * 3000, " " * 900, "É é 😀\x01 x\n\n y"]
    texts.append(" ".join("".join(rng.choice("abcé'1-😀") for _ in range(rng.randint(1, 12))) for _ in range(4000)))
    texts.append("".join(rng.choice("ab<|>'1-  \n") for _ in range(9000)))
    if name.endswith(".model"):
        want = [len(x) for x in SentencePieceProcessor(model_file=file).encode(texts)]
    else:
        want = [len(x) for x in Tokenizer.from_file(file).encode_batch(texts, add_special_tokens=False)]
    counter = tokens.Counter(file, chunk=200, overlap=4)
    assert counter.proof == proof and counter.counts([*texts, None]) == [*want, 0]
    assert tokens.Counter(file).counts(texts) == want
    counter.proof = "none"
    assert counter.counts(texts[:20]) == want[:20]


def test_benchmark_windows_that_share_a_hash(monkeypatch):
    rng = random.Random(10)
    items = [(str(k), " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))).encode()) for k in range(40)] + [("0", b"a b"), (None, b"d d d d")]
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 60))).encode() for _ in range(30)] + [None, b""]
    monkeypatch.setattr(decontaminate, "mixed", lambda h: h & np.uint64(3))
    counts, bitmaps, found = decontaminate.scan(decontaminate.Grams(items, 4), texts, [b""] * len(texts))
    for t, n, bitmap, ids in zip(texts, counts, bitmaps, found, strict=True):
        w, hit, owners = (t or b"").split(), set(), set()
        for item, text in items:
            own = text.split()
            size = min(4, len(own))
            windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
            for i in range(len(w)):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    owners.add(item)
        bits = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8))).tolist()
        assert n == len(w) and bits == sorted(hit) and ids == sorted(owners - {None})


def test_quality_held_out(spark, sf, awkward):
    docs, labels = (spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    found = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(quality.held_out()).collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.95 * len(found)
    odd = quality.score(awkward, model).collect()
    assert len(odd) == awkward.count() and all(0 <= r.score <= 1 for r in odd)
    empty = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(awkward, empty).collect()} == {0.5}


def test_op_digests(spark, sf):
    from collectra.llm import registry

    rows = registry.QUERIES["op10_sharding"](spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 1 for r in rows)
    rows = registry.QUERIES["op5_repeats"](spark, sf).collect()
    assert all(r.n_removed or r.kept_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
