"""Encoding and decoding with a published byte-pair vocabulary, split at forced boundaries.

A pair of adjacent bytes that occurs inside no vocabulary token can never be joined by a merge, so a
piece may be cut between them and the fragments encoded on their own; the ids are those of the whole
piece.  Fragments repeat far more often than pieces, so a bounded memory of encoded fragments and of
white-space separated chunks does most of the work.

The vocabulary file is a parameter (its path, or bytes).  The supported form is the one of
``word_bpe_49k.json``: NFC, white space runs to one space, lower case, a pattern split, a byte-level
alphabet, and an end-of-word suffix.  Added tokens in a text are taken literally before normalising.
What is a letter, a number and the lower case of a letter differs between versions of Unicode; all three are stored as the
tokenizers library sees them (``letters``), so ids do not depend on what is installed.

Defined results: a null or empty text has no ids and decodes to the empty string; equal texts get
equal ids; an empty table gives an empty result; the input's other columns are kept unless they have
the names of the new ones, which then replace them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from . import letters
from .common import give_back, to_python

#: White space of the vocabulary's pattern language (Unicode White_Space).  Fixed values.
_SPACE = "\t-\r \x85\xa0  -     　"
#: What str.split() takes as white space beyond it.
_ODD = regex.compile("[\x1c-\x1f]")
_SPLIT = regex.compile(f"[{_SPACE}]+")
#: Bytes of chunks and of fragments that are remembered: so many of late, and as many from before them; and what an
#: entry takes besides its characters and ids.
_MEMORY, _FRAGMENTS, _ENTRY = 40_000_000, 20_000_000, 180
#: Words of a text that are looked up in one go, and the longest chunk or fragment that is remembered.
_WORDS, _LONGEST = 200_000, 48


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def forced_cuts(tokens: list[bytes]) -> np.ndarray:
    """cuts[a, b] is true where byte b never follows byte a inside any token."""
    inside = np.zeros((256, 256), bool)
    flat = np.frombuffer(b"".join(tokens), np.uint8)
    ends = np.cumsum([len(t) for t in tokens]) - 1
    within = np.ones(max(len(flat) - 1, 0), bool)
    within[ends[:-1]] = False
    inside[flat[:-1][within], flat[1:][within]] = True
    return ~inside


@dataclass(frozen=True)
class Tables:
    """Where the tokenizers library and the tables used here see letters, numbers and lower case differently: ranges as in a set of a pattern."""

    letters: str = ""
    numbers: str = ""
    differ: str = ""
    lower: tuple[tuple[str, str], ...] = ()


def _ranges(points: list[int]) -> str:
    out, first = [], None
    for a, b in zip([*points], [*points[1:], -1], strict=True):
        first = a if first is None else first
        if b != a + 1:
            out.append(f"\\U{first:08x}-\\U{a:08x}")
            first = None
    return "".join(out)


def _points(text: str) -> set[int]:
    ends = ([int(x, 16) for x in part.split("-")] for part in text.split())
    return {p for e in ends for p in range(e[0], e[-1] + 1)}


@lru_cache(maxsize=1)
def tables() -> Tables:
    """From the stored letters, numbers and lower case, held against those of this process for every code point."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    whole = "".join(every)
    theirs, differ = {"L": _points(letters.LETTERS), "N": _points(letters.NUMBERS)}, set()
    for name, points in theirs.items():
        differ |= points ^ {ord(c) for run in regex.findall(rf"\p{{{name}}}+", whole) for c in run}
    pairs = (pair.split(":") for pair in letters.LOWER.split())
    lower = {chr(int(c, 16)): "".join(chr(int(x, 16)) for x in w.split("+")) for c, w in pairs}
    return Tables(_ranges(sorted(theirs["L"])), _ranges(sorted(theirs["N"])), _ranges(sorted(differ)), tuple((c, lower.get(c, c)) for c in every if lower.get(c, c) != c.lower()))


class Codec:
    """Encodes and decodes single texts; holds bounded memories, so one per worker is enough."""

    def __init__(self, spec: bytes, known: Tables = Tables()) -> None:
        conf = json.loads(spec)
        model, steps = conf["model"], conf["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["Split", "ByteLevel"] or conf["decoder"] or not steps[0]["invert"]:
            raise ValueError("unsupported vocabulary file")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.rank = {p: i for i, p in reversed(list(enumerate(pairs)))}
        pattern = steps[0]["pattern"]["Regex"]
        self.piece = regex.compile(pattern)
        # texts with code points that the library sees otherwise are rare, and its ranges slow
        self.differ = regex.compile(f"[{known.differ}]") if known.differ else None
        self.exact = regex.compile(pattern.replace(r"\p{L}", known.letters).replace(r"\p{N}", known.numbers)) if known.differ else None
        self.lower = str.maketrans(dict(known.lower))
        self.cased = regex.compile("[" + "".join(regex.escape(c) for c, _ in known.lower) + "]") if known.lower else None
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.char = byte_alphabet()
        byte = {c: b for b, c in enumerate(self.char)}
        bare = lambda t: t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t
        special = set(self.added)
        self.cuts = forced_cuts([bytes(byte[c] for c in bare(t)) for t in self.vocab if t not in special])
        self.cut = self.cuts.ravel().tobytes()
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered."""
        self.fragments: dict[bytes, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.old_fragments: dict[bytes, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}
        self.held = self.held_fragments = 0

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if self.cased and not text.isascii() and self.cased.search(text):
            text = text.translate(self.lower)
        # lower case is taken letter by letter, without the final form of sigma
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def _merge(self, data: bytes, last: bool) -> list[int]:
        """The ids of one fragment: the lowest-ranked adjacent pair is merged until none is left."""
        parts = [self.char[b] for b in data]
        if last:
            parts[-1] += self.suffix
        return [self.vocab[p] for p in (self._merge_short if len(parts) <= _LONGEST else self._merge_long)(parts)]

    def _merge_short(self, parts: list[str]) -> list[str]:
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list[str | None]) -> list[str]:
        n, rank = len(parts), self.rank
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i] if parts[i] == x else -1
            if j < 0 or parts[j] != y:
                continue
            parts[i], parts[j] = x + y, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p is not None]

    def _piece(self, data: bytes) -> bytes:
        """Packed ids of one piece, from its fragments between forced cuts."""
        cut = self.cut
        at = [i for i in range(1, len(data)) if cut[data[i - 1] << 8 | data[i]]]
        known, last, out = self.fragments, len(data), []
        for lo, hi in zip([0, *at], [*at, last], strict=True):
            key = data[lo:hi] + b"\xff" if hi == last else data[lo:hi]  # no UTF-8 text has this byte
            found = known.get(key)
            if found is None:
                found = self.old_fragments.get(key)
                if found is None:
                    ids = self._merge(data[lo:hi], hi == last)
                    found = struct.pack(f"<{len(ids)}I", *ids)
                if hi - lo <= _LONGEST:
                    if self.held_fragments > _FRAGMENTS:
                        self.old_fragments, self.fragments, self.held_fragments = known, (known := {}), 0
                    known[key] = found
                    self.held_fragments += _ENTRY + len(key) + len(found)
            out.append(found)
        return b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        """Packed ids of a chunk without white space."""
        found = self.old_chunks.get(chunk)
        if found is None:
            piece = self.exact if self.differ and not chunk.isascii() and self.differ.search(chunk) else self.piece
            found = b"".join([self._piece(m.encode("utf-8", "surrogatepass")) for m in piece.findall(chunk)])
        if len(chunk) <= _LONGEST:
            if self.held > _MEMORY:
                self.old_chunks, self.chunks, self.held = self.chunks, {}, 0
            self.chunks[chunk] = found
            self.held += _ENTRY + len(found) + (1 if chunk.isascii() else 4) * len(chunk)
        return found

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts: list[bytes] = []
        chunk = self._chunk
        for k, section in enumerate(self.special.split(text) if self.special and "<" in text else [text]):
            if k % 2:
                parts.append(struct.pack("<I", self.added[section]))
                continue
            section = self.normal(section)
            words = section.split() if not _ODD.search(section) else [w for w in _SPLIT.split(section) if w]
            for at in range(0, len(words), _WORDS):
                get = self.chunks.get
                parts += [get(w) or chunk(w) for w in words[at : at + _WORDS]]
        return b"".join(parts)

    def unpacked(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text or ""), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)


@lru_cache(maxsize=2)
def _codec(spec: bytes, known: Tables) -> Codec:
    return Codec(spec, known)


def codec(path: str | None = None) -> Codec:
    return Codec(Path(path or default_path()).read_bytes(), tables())


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", digests: bool = False) -> DataFrame:
    """Add ids (array of int) and decoded (string) to every row; with ``digests``, n_tokens and SHA-256 digests of both instead."""
    spec = docs.sparkSession.sparkContext.broadcast((Path(path or default_path()).read_bytes(), tables()))
    new = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digests else {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    keep = [f for f in docs.schema if f.name not in new and not (digests and f.name == text_col)]
    schema = T.StructType([*keep, *(T.StructField(k, v) for k, v in new.items())])
    source = docs.select(*[F.col(f"`{f.name}`") for f in keep], *([F.col(text_col)] if digests else []))
    at_text, width = source.columns.index(text_col), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(*spec.value)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 100):
                part = batch.slice(at, 100)
                out = [(i := c.packed(t or ""), c.unpacked(i)) for t in part.column(at_text).to_pylist()]
                if digests:
                    cols = [pa.array([len(i) // 4 for i, _ in out], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i, _ in out], pa.string()), pa.array([hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for _, d in out], pa.string())]
                else:
                    flat = pa.array(np.frombuffer(b"".join(i for i, _ in out), "<u4").astype(np.int32))
                    offsets = pa.array(np.cumsum([0, *(len(i) // 4 for i, _ in out)]), pa.int32())
                    cols = [pa.ListArray.from_arrays(offsets, flat), pa.array([d for _, d in out], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *cols], [*(f.name for f in keep), *new])
            pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batch took
        c.forget()
        give_back()

    return to_python(source).mapInArrow(run, schema)
