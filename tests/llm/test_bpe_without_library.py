"""Ids do not depend on whether the tokenizers library is installed."""

from __future__ import annotations

import sys

from readloom.llm import bpe


def test_tables_do_without_the_library(monkeypatch):
    monkeypatch.setitem(sys.modules, "tokenizers", None)  # importing it fails
    bpe.tables.cache_clear()
    known = bpe.tables()
    assert known.differ and ("Ᲊ", "ᲊ") in known.lower  # a letter of Unicode 16
    odd = bpe.codec()
    assert odd.encode("aᲉ b") == odd.encode("aᲊ b")
    bpe.tables.cache_clear()
