"""Features of words of any length."""

import zlib

from collectra.llm import quality


def test_every_byte_of_a_long_word_counts():
    word = "語".encode() * 200 + bytes(range(33, 127))
    for w in (word[:63], word[:64], word[:65], word):
        marked = b"<" + w + b">"
        want = [zlib.crc32(w) % quality.BUCKETS] + [zlib.crc32(marked[i : i + n], n) % quality.BUCKETS for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
        assert list(quality.features(w)) == want
    changed = word[:100] + b"#" + word[101:]
    assert sorted(quality.features(word)[1:]) != sorted(quality.features(changed)[1:])
    words = quality.Words()
    assert words([word, b"a", word])[0] != words([changed])[0] and set(words.known) == {b"a"}
