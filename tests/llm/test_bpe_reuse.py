"""Chunks that texts share are encoded once, wherever they stand, and the ids stay the library's."""

import numpy as np
import pytest

from millrace.llm import bpe

RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnop"), RNG.integers(2, 9))) for _ in range(3000)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n)) + " "


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_shared_passages_are_encoded_once(name):
    import public_tokenizers

    codec = bpe.Codec(public_tokenizers.path(name))
    passage = prose(8000)
    texts = [prose(RNG.integers(20, 200)) + passage + prose(50) for _ in range(30)]
    for at in range(0, 30, 5):  # several batches share a store
        got = codec.encode([t.encode() for t in texts[at : at + 5]])
        assert [g.tolist() for g in got] == [codec.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[at : at + 5]]
    own = sum(map(len, texts)) - 30 * len(passage)
    # of each copy the chunks at both ends of the passage are mixed with what stands around it
    assert codec.chunk_bytes > 25 * len(passage) and codec.new_bytes < 1.1 * len(passage) + own + 30 * 2 * 4096
    assert codec.by_word == name.startswith("word") and codec.encoded_bytes <= (codec.new_bytes / 5 if codec.by_word else codec.new_bytes)


def test_words_are_pieces():
    import json

    import public_tokenizers

    told = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert bpe.parts_at_spaces(json.dumps(told))
    for change in ({"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel"}}, {"normalizer": {"type": "Replace", "pattern": {"String": " "}, "content": "_"}}, {"post_processor": {"type": "ByteLevel"}}):
        assert not bpe.parts_at_spaces(json.dumps(told | change))
    codec = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(2)
    parts = ["ΑΣ", "Σ", "e", "\u0301", "'s", "<|endoftext|>", "<|", "9", "ß", "日本", ".", "\x85", "\u2003", "İ", "ﬁ", "A'", "\u00a0", "\ud55c"]
    for _ in range(3000):
        t = "".join(rng.choice([*parts, " ", "\n", "\t", "\r", "\x0b"]) for _ in range(rng.integers(1, 12))).encode()
        assert codec._by_words([t])[0].tolist() == codec.tokenizer.encode(t.decode(), add_special_tokens=False).ids


def test_a_full_store_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "STORE_BYTES", 20_000)
    codec = bpe.Codec(bpe.word_tokenizer_path())
    passage = prose(2000)
    for _ in range(6):
        texts = [prose(100) + passage, passage + prose(100), prose(3000)]
        for t, g in zip(texts, codec.encode([t.encode() for t in texts]), strict=True):
            assert g.tolist() == codec.tokenizer.encode(t, add_special_tokens=False).ids
    assert codec.held < 200_000


def test_reuse_is_told(spark):
    text = prose(5000)
    df = spark.createDataFrame([(i, text) for i in range(20)] + [(30, None), (31, "")], "doc_id long, text string").repartition(1)
    row = bpe.reuse(df).first()
    assert row["chunk_bytes"] > 19 * len(text) and row["encoded_bytes"] <= row["new_bytes"] <= len(text)
    assert bpe.reuse(df.limit(0)).first()["chunk_bytes"] == 0


def test_borders_depend_on_content_only():
    data = prose(5000).encode()
    cuts = bpe.borders(np.frombuffer(data, np.uint8))
    moved = bpe.borders(np.frombuffer(b"something else in front " + data, np.uint8))
    assert len(cuts) > 10 and set((cuts + 24).tolist()) <= set(moved.tolist())


def test_capitals_compose_before_they_are_lowered():
    codec = bpe.Codec(bpe.word_tokenizer_path())
    lib = codec.tokenizer
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    for letter in letters:
        texts = [form.format(letter + chr(mark)) for mark in range(0x300, 0x370) for form in ("xx {} yy", "{}.", "Up{}Down, next", "{}́ A")]
        for t, got in zip(texts, codec.encode([t.encode() for t in texts]), strict=True):
            assert got.tolist() == lib.encode(t, add_special_tokens=False).ids, ascii(t)
            assert np.concatenate([*codec._by_words([t.encode()])]).tolist() == got.tolist(), ascii(t)


def test_spaces_emoji_and_random_strings():
    codec = bpe.Codec(bpe.word_tokenizer_path())
    spaces = [chr(c) for c in (*range(9, 14), 0x1C, 0x1F, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    emoji = ["\U0001f468\u200d\U0001f469\u200d\U0001f467", "\U0001f1e9\U0001f1ea", "\u2764\ufe0f", "\U0001f44d\U0001f3fd", "1\ufe0f\u20e3"]
    marks = [chr(c) for c in (0x301, 0x308, 0x30C, 0x331, 0x344, 0x345, 0x5B0, 0x64B, 0x93C, 0x1100, 0x1161, 0x11A8)]
    rng = np.random.default_rng(8)
    parts = [*spaces, *emoji, *marks, *"AJHTWYajhtwy.,'9", "Fox.", "It's", "<|endoftext|>"]
    for _ in range(4000):
        t = "".join(rng.choice(parts, rng.integers(1, 14)))
        want = codec.tokenizer.encode(t, add_special_tokens=False).ids
        assert codec.encode([t.encode()])[0].tolist() == want and codec._by_words([t.encode()])[0].tolist() == want, ascii(t)


def test_a_text_without_spaces_takes_linear_time():
    import time

    codec = bpe.Codec(bpe.word_tokenizer_path())
    took = []
    for n in (200_000, 1_600_000):
        text = "".join(RNG.choice(list("abcdefghij.,;0"), n)).encode()
        began = time.perf_counter()
        plan_only = bpe.plan(text)
        took.append(time.perf_counter() - began)
        assert plan_only == [("chunk", text)]
    assert took[1] < 40 * max(took[0], 0.005)
