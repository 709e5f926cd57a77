"""Fill-in-middle: a text is cut at two random unit ends and its parts are put in another order.

Units are runs of ASCII letters and single other characters.  One Aho-Corasick automaton goes once over a shadow of
the text, in which every character is replaced by its class (a letter, another character, or one of the five that
sentinels are made of; each of one byte, so that places are code points).  Its patterns are the pairs of classes where
a run of letters begins or ends, and the sentinels.  Between two such events lie letters only (one unit) or other
characters only (as many units as characters), so unit counts are sums over the events, and the place of the k-th
unit's end is found by bisection; no list of units is made.

The output is ``<P>``prefix``<S>``suffix``<M>``middle (psm), ``<S>``suffix``<P>``prefix``<M>``middle (spm) or the text
itself (plain), which empty texts, texts that hold a sentinel, and a share of the others chosen by hash get.

Defined results: a null text is an empty one and gives an empty plain output; texts of any length are taken whole;
rows that share an id share its draws, and repeated rows give repeated results; a null id draws as an empty one; the input's
other columns are kept unless they have the names of the new ones, which then replace them; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import give_back, to_python

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay as they are; of 100 others so many get the order with the suffix first.
PLAIN, SPM = 10, 20

_LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Classes: characters of sentinels stand for themselves, other letters for "a", all else for ".".
_SPECIAL = frozenset("".join((PREFIX, SUFFIX, MIDDLE)).encode())
_CLASSES = bytes(c if c in _SPECIAL else 0x61 if c in _LETTERS else 0x2E for c in range(256))
#: Texts are shadowed in slices of so many characters, each with what a pattern may reach back to.
_SLICE, _REACH = 1 << 20, 2


def automaton() -> ahocorasick.Automaton:
    """Pairs of classes where a run of letters begins or ends (0), and sentinels (1)."""
    out = ahocorasick.Automaton()
    inner, outer = ([chr(c) for c in {*_SPECIAL, 0x61, 0x2E} if (c in _LETTERS) == letter] for letter in (True, False))
    for a, b in (*product(inner, outer), *product(outer, inner)):
        out.add_word(a + b, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        out.add_word(s, 1)
    out.make_automaton()
    return out


_AUTOMATON = automaton()


class Ranks:
    """Where the units of a text end, by its events."""

    def __init__(self, text: str) -> None:
        starts, self.marked = array("q", [0]), False  # of the segments between events
        for at in range(0, len(text), _SLICE):
            back = min(at, _REACH)
            # a character outside of ASCII becomes one "?", which is no letter and in no sentinel
            shadow = text[at - back : at + _SLICE].encode("ascii", "replace").translate(_CLASSES).decode("ascii")
            for end, sentinel in _AUTOMATON.iter(shadow):
                if sentinel:
                    self.marked = True
                elif end >= back:  # an event of the slice before otherwise
                    starts.append(at - back + end)
        self.starts = np.frombuffer(starts, np.int64)
        sizes = np.diff(self.starts, append=len(text))
        letters = (np.arange(len(sizes)) + (not (text[:1].isascii() and text[:1].isalpha()))) % 2 == 0
        self.letters = letters
        self.until = np.cumsum(np.where(letters, 1, sizes)) if text else np.zeros(1, np.int64)
        self.ends = self.starts + sizes
        self.n = int(self.until[-1])

    def place(self, k: int) -> int:
        """Code points before the end of the k-th unit; 0 for none."""
        if not k:
            return 0
        j = int(np.searchsorted(self.until, k))
        return int(self.ends[j] if self.letters[j] else self.ends[j] - (self.until[j] - k))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits."""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transform(doc_id: int | None, text: str | None, seed: int = 1, plain: int = PLAIN, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output)."""
    text = text or ""
    ranks, (h1, h2, h3, h4) = Ranks(text), draws(doc_id, seed)
    n = ranks.n
    if not text or ranks.marked or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = (ranks.place(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


#: Characters of texts that are turned into one batch of results.
_BATCH_CHARS = 4_000_000


def fill_in_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 1, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars and output to every row, without a shuffle."""
    new = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
    keep = [f for f in docs.schema if f.name not in new]
    # the text may be a column that is replaced
    source = docs.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{id_col}`").cast("long").alias("\x00id"), F.col(f"`{text_col}`").alias("\x00text"))
    width, names = len(keep), [*(f.name for f in keep), *new]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, size, first = batch.column(width).to_pylist(), [], 0, 0
            for i in range(batch.num_rows):
                rows.append(transform(ids[i], batch.column(width + 1)[i].as_py(), seed, plain, spm))
                size += len(rows[-1][-1])
                if size >= _BATCH_CHARS or i == batch.num_rows - 1:
                    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(rows)).columns[:width], *cols], names)
                    rows, size, first = [], 0, i + 1
            pa.default_memory_pool().release_unused()
        give_back()

    return to_python(source).mapInArrow(run, T.StructType([*keep, *(T.StructField(k, v) for k, v in new.items())]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    o, s, p, m = output, F.instr(output, SUFFIX), F.instr(output, PREFIX), F.instr(output, MIDDLE)
    after = lambda at, end=None: F.substring(o, at + 3, F.lit(2**31 - 1) if end is None else end - at - 3)
    return F.when(form == "psm", F.concat(after(p, s), after(m), after(s, m))).when(form == "spm", F.concat(after(p, m), after(m), after(s, p))).otherwise(o)


def digests(rows: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle``, with SHA-256 digests of output and restored text in place of the texts."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = """
WITH h AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x
    FROM documents
), d AS (
    SELECT doc_id, text, u, CAST(length(u) AS BIGINT) AS n,
        CAST('0x' || substr(x, 1, 8) AS BIGINT) % (length(u) + 1) AS k1, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (length(u) + 1) AS k2,
        CASE WHEN text = '' OR strpos(text, '<P>') > 0 OR strpos(text, '<S>') > 0 OR strpos(text, '<M>') > 0 OR CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
             WHEN CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h
), p AS (
    SELECT doc_id, text, n, form, array_to_string(list_slice(u, 1, least(k1, k2)), '') AS a,
        array_to_string(list_slice(u, least(k1, k2) + 1, greatest(k1, k2)), '') AS b, array_to_string(list_slice(u, greatest(k1, k2) + 1, n), '') AS c
    FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b ELSE text END) AS output_sha256,
    sha256(CASE WHEN form = 'plain' THEN text ELSE a || b || c END) AS restored_sha256
FROM p
"""
