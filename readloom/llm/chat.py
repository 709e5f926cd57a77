"""Chat formatting at the level of tokens.

A conversation becomes one run of token ids, held as a row per turn: for every turn, reserved ids for its begin, between its
role and its text, and for its end, with the segments between them encoded on their own by a published
byte-level vocabulary.  Reserved ids are spliced in and no text can produce them; in the text form of the
template every control string begins with ``<|``, and segments are escaped so that none occurs in them
(``<``, any backslashes, ``|`` gets one more backslash), which is undone when read back.  The loss mask of a
batch is the prefix sum of +1 where an assistant's text begins and -1 where it ends.

Defined results: a null text or role is empty; turns are ordered by number (null first), then by role and text;
repeated rows are turns of their own; an empty table gives an empty result; turns of a null conversation
belong together; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import to_python

BEGIN, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_ESCAPE, _BACK = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"<\1|", text)


@dataclass
class Template:
    """Encodes segments with a byte-level vocabulary; three ids after its last are reserved."""

    ranks: bytes
    pattern: str

    def __post_init__(self) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
        self.encoding = tiktoken.Encoding("template", pat_str=self.pattern, mergeable_ranks=table, special_tokens={})
        top = max(table.values()) + 1
        self.begin, self.middle, self.end = top + 1, top + 2, top + 3
        self.names = {self.begin: BEGIN, self.middle: MIDDLE, self.end: END}

    def segment(self, text: str) -> list[int]:
        """Ids of an escaped segment.  Lone surrogates, which UTF-8 has not, cannot come from Spark."""
        return self.encoding.encode_ordinary(escape(text))

    def turns(self, roles: list[str | None], texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and loss masks of turns, assembled for the batch at once."""
        parts: list[list[int]] = []
        for role, text in zip(roles, texts, strict=True):
            parts += [[self.begin], self.segment(role or ""), [self.middle], self.segment(text or ""), [self.end]]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        stop = np.cumsum(size)
        ids = np.fromiter((i for p in parts for i in p), np.int32, int(size.sum()))
        step = np.zeros(len(ids) + 1, np.int8)
        ours = np.flatnonzero([r == "assistant" for r in roles]) * 5 + 3
        np.add.at(step, stop[ours] - size[ours], 1)
        np.add.at(step, stop[ours], -1)
        mask = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        cuts = stop[4::5][:-1]
        return np.split(ids, cuts), np.split(mask, cuts)

    def text(self, ids: np.ndarray) -> str:
        """The text form of a row of ids."""
        out, at = [], 0
        for k in np.flatnonzero(ids >= self.begin).tolist():
            out += [self.encoding.decode(ids[at:k].tolist()), self.names[int(ids[k])]]
            at = k + 1
        return "".join([*out, self.encoding.decode(ids[at:].tolist())])

    def read(self, ids: np.ndarray, mask: np.ndarray) -> list[tuple[str, str, str]]:
        """(role, text, text under the mask) of each turn, from ids and mask alone."""
        marks = np.flatnonzero(ids >= self.begin)
        out = []
        for b, m, e in marks.reshape(-1, 3).tolist():
            say = lambda x: unescape(self.encoding.decode(x.tolist()))
            under = ids[m + 1 : e][mask[m + 1 : e]]
            out.append((say(ids[b + 1 : m]), text := say(ids[m + 1 : e]), text if len(under) == e - m - 1 else say(under)))
        return out


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a conversation's text form."""
    return [tuple(map(unescape, turn.removeprefix(BEGIN).split(MIDDLE))) for turn in text.split(END)[:-1]]


@lru_cache(maxsize=2)
def _template(ranks: bytes, pattern: str) -> Template:
    return Template(ranks, pattern)


def format_turns(conversations: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text, ids, loss): one row per turn; a conversation's rows in order, one after another, are its row of tokens."""
    shared = conversations.sparkSession.sparkContext.broadcast((Path(path or default_path()).read_bytes(), pattern or default_pattern()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = _template(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, loss = template.turns(part.column(2).to_pylist(), part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.bool_()))], ["conv_id", "turn", "role", "text", "ids", "loss"])

    some = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return to_python(some).mapInArrow(run, "conv_id long, turn long, role string, text string, ids array<int>, loss array<boolean>")


def formatted_text(conversations: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Turns with their text form in place of ids."""
    shared = conversations.sparkSession.sparkContext.broadcast((Path(path or default_path()).read_bytes(), pattern or default_pattern()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = _template(*shared.value)
        for batch in batches:
            texts = [template.text(np.array(x, np.int32)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["conv_id", "turn", "formatted"])

    return format_turns(conversations, path, pattern).select("conv_id", "turn", "ids").mapInArrow(run, "conv_id long, turn long, formatted string")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per conversation, what is read back from the ids and masks of ``format_turns``.

    A digest of a whole conversation needs its turns one after another; they are sorted by Spark and
    streamed, so a conversation of any length takes little memory."""
    shared = formatted.sparkSession.sparkContext.broadcast((Path(path or default_path()).read_bytes(), pattern or default_pattern()))

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = _template(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for ids, mask in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    ids = np.array(ids, np.int32)
                    got = template.read(ids, np.array(mask, bool))
                    rows.append(("".join(f"{r}\n{t}\n" for r, t, _ in got), "".join(u for *_, u in got), len(template.text(ids))))
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *cols], ["conv_id", "turn", "said", "loss", "chars"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])
            done.clear()
            return out

        def close() -> None:
            if state:
                done.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, said, loss, chars in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if now != (conv,):
                    close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(said.encode("utf-8", "surrogatepass"))
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += chars
            yield flush()
        close()
        yield flush()

    back = formatted.select("conv_id", "turn", "ids", "loss").mapInArrow(read_back, "conv_id long, turn long, said string, loss string, chars long")
    return back.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "said").mapInArrow(sums, DIGEST)
