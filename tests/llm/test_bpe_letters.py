"""Every code point, and bounded memories, against the tokenizers library."""

from __future__ import annotations

import random

import pytest

from readloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    out = tokenizers.Tokenizer.from_file(bpe.default_path())
    out.no_truncation()
    out.no_padding()
    return out


def test_every_code_point_is_read_as_the_library_reads_it(library):
    codec = bpe.codec()
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for text in ["a" + "b 1".join(every[i : i + 500]) + "c" for i in range(0, len(every), 500)]:
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(ord(text[1]))


def test_without_the_tables_the_rest_is_alike(library):
    codec = bpe.Codec(open(bpe.default_path(), "rb").read())
    for text in ("Hello, World's 12 ä ΣΑΣ <|endoftext|>", "日本語  x"):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_memories_are_bounded_in_bytes_and_change_nothing(monkeypatch):
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcdeé日1-") for _ in range(r.randint(1, 9))) for _ in range(200)) for _ in range(30)]
    want = [bpe.codec().packed(t) for t in texts]
    monkeypatch.setattr(bpe, "_MEMORY", 20_000)
    monkeypatch.setattr(bpe, "_FRAGMENTS", 8_000)
    small = bpe.codec()
    assert [small.packed(t) for t in texts] == want
    held = lambda d: sum(bpe._ENTRY + len(k) * (4 if isinstance(k, str) else 1) + len(v) for k, v in d.items())
    assert held(small.chunks) < 22_000 and held(small.old_chunks) < 22_000 * 2 and held(small.fragments) < 9_000
