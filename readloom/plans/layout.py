"""The layout grammar: what segments a read is expected to have, in order.

A layout is written as words ``TYPE:SEQ[,SEQ...]``.  Types: R read, B barcode, S spacer, F random bases
(fingerprint, UMI), P adapter that may be cut, O optional bases, G bases added at the template's end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

TYPES = "RBSFPOG"
#: Segments with a null alternative of the same length: choosing it means that nothing was found.
WITH_NULL = "BS"


class LayoutError(ValueError):
    """A layout that the grammar does not allow."""


@dataclass(frozen=True)
class Segment:
    kind: str
    seqs: tuple[str, ...]

    @property
    def length(self) -> int:
        return len(self.seqs[0])

    @property
    def alternatives(self) -> tuple[str, ...]:
        """The sequences to score, the null one last where the type has one."""
        return (*self.seqs, "N" * self.length) if self.kind in WITH_NULL else self.seqs

    def __str__(self) -> str:
        return f"{self.kind}:{','.join(self.seqs)}"


@dataclass(frozen=True)
class Layout:
    segments: tuple[Segment, ...]

    @property
    def reads(self) -> int:
        return sum(s.kind == "R" for s in self.segments)

    @property
    def umi_length(self) -> int:
        return sum(s.length for s in self.segments if s.kind == "F")

    @property
    def plain(self) -> bool:
        """Nothing but a read: there is nothing to decode."""
        return [s.kind for s in self.segments] == ["R"]

    def __str__(self) -> str:
        return " ".join(map(str, self.segments))


def segment(word: str) -> Segment:
    kind, colon, rest = word.partition(":")
    if not colon or kind not in TYPES or len(kind) != 1:
        raise LayoutError(f"{word!r}: a segment is one of {TYPES}, a colon and sequences")
    if kind == "R":
        return Segment("R", ("N",))
    seqs = tuple(s.strip().upper().replace("U", "T") for s in rest.split(","))
    if not all(re.fullmatch("[ACGTN.]+", s) for s in seqs):
        raise LayoutError(f"{word!r}: sequences are of A C G T N and the dot")
    if len({len(s) for s in seqs}) > 1:
        raise LayoutError(f"{word!r}: sequences of one segment have one length")
    return Segment(kind, seqs)


def parse(text: str) -> Layout:
    """A layout from its words; ``-1 B:ACGT -2 R:N`` may number them, without gaps."""
    words, numbers, parts = text.split(), [], []
    while words:
        w = words.pop(0)
        if re.fullmatch(r"-\d+", w):
            numbers.append(int(w[1:]))
            if not words:
                raise LayoutError(f"nothing after {w}")
            parts.append(segment(words.pop(0)))
        elif ":" in w:
            parts.append(segment(w))
        elif parts:
            raise LayoutError(f"{w!r} is no segment")
    if numbers and (len(numbers) != len(parts) or sorted(numbers) != list(range(1, len(parts) + 1))):
        raise LayoutError("segments are numbered from 1, without gaps")
    if numbers:
        parts = [p for _, p in sorted(zip(numbers, parts, strict=True), key=lambda x: x[0])]
    if not parts:
        raise LayoutError("no segments")
    return Layout(tuple(parts))


def _segment_words(line: str) -> list[str]:
    """A line's segments, with their numbers if it has any; the values of other options are none."""
    out: list[str] = []
    before = ""
    for word in line.split("#")[0].split():
        numbered = re.fullmatch(r"-\d+", before)
        if re.match("[A-Z]:", word) and (numbered or not before.startswith("-")):
            out += [before, word] if numbered else [word]
        before = word
    return out


def parse_file(lines: list[str]) -> list[Layout]:
    """The distinct layouts of a file, one a line; a leading command word and other options are skipped."""
    out: list[Layout] = []
    for words in filter(None, map(_segment_words, lines)):
        layout = parse(" ".join(words))
        if layout in out:
            raise LayoutError(f"{layout} stands twice")
        out.append(layout)
    return out


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def least_distance(seqs: tuple[str, ...]) -> int | None:
    """The smallest edit distance between two of the sequences."""
    return min((edit_distance(a, b) for a, b in combinations(seqs, 2)), default=None)


def warnings(layout: Layout, filters: bool = False) -> list[str]:
    """What a user should know about a layout."""
    out = [f"barcodes of {s} are only {d} apart" for s in layout.segments if s.kind == "B" and (d := least_distance(s.seqs)) is not None and d < 2]
    if filters and layout.reads > 1:
        out.append("with several reads in one sequence, contaminant and low-complexity filters are off")
    return out
