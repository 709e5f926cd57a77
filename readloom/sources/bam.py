"""BAM files as DataFrames, from Spark's text reader.

A BAM file is a row of compressed blocks of at most 64 KB, each with the same beginning, and its records run across blocks
and splits.  That beginning is the separator of the text reader, so Spark splits the file, on any file system, and every row is a block.
A task inflates the blocks of a split in their order, and looks for the first place from which records follow each other.
What lies before that place, and what is left at the end of a split, are pieces; pieces of neighbours are joined, and have to be
whole records, else the file is refused: a wrong guess cannot go unseen.

Defined results: records with any of the flags are left out; without bases or qualities the column is null; a file without records
gives none; cut or damaged blocks and records, and blocks with an unusual beginning, raise an error that names the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .scratch import cut

#: What every block begins with, up to its size.  Fixed values of the format.
_BEGIN = bytes((0x1F, 0x8B, 8, 4, 0, 0, 0, 0, 0, 0xFF, 6, 0)) + b"BC" + bytes((2, 0))
_MAGIC = b"BAM\x01"
#: Four bits a base, and sizes of the values of tags.  Fixed values of the format.
_BASES = str.maketrans("0123456789abcdef", "=ACMGRSVTWYHKDBN")
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
_PHRED = bytes(min(x + 33, 126) for x in range(256))
#: block_size, refID, pos, l_read_name, mapq, bin, n_cigar_op, flag, l_seq, next_refID, next_pos, tlen
_FIXED = struct.Struct("<iiiBBHHHiiii")
#: So many records have to follow each other from a place that is taken for the first of a split.  A split without such a
#: place is a piece as a whole.
_CHAIN = 6
#: Inflated bytes that are gathered before the first record of a split is looked for, and records in one batch.
_LOOK, _MANY = 1 << 21, 10_000

RECORD = "name string, seq string, qual string, flag int, mapq double, nm int"
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32()]
_ROWS = f"file string, split bigint, place bigint, {RECORD}"
_PIECES = "file string, split bigint, place bigint, kind int, data binary"


def inflate(raw: bytes, file: str) -> bytes:
    """The bytes of a block, without its beginning."""
    if len(raw) < 10 or int.from_bytes(raw[:2], "little") + 1 != len(raw) + len(_BEGIN):
        raise ValueError(f"{file}: a block is cut off or has an unusual beginning")
    try:
        data = zlib.decompress(raw[2:-8], -15)
    except zlib.error as e:
        raise ValueError(f"{file}: a block is damaged: {e}") from e
    if (zlib.crc32(data), len(data)) != struct.unpack("<II", raw[-8:]):
        raise ValueError(f"{file}: a block is damaged: its check sum is another")
    return data


def after_header(data: bytes, file: str) -> int | None:
    """Where the first record begins; nothing if there are too few bytes to tell."""
    if len(data) >= 4 and data[:4] != _MAGIC:
        raise ValueError(f"{file}: not a BAM file")
    try:
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        many = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(many):
            at += 8 + struct.unpack_from("<i", data, at)[0]
    except struct.error:
        return None
    return at if at <= len(data) else None


def likely(data: bytes, at: int) -> int | None:
    """The end of what looks like a whole record at this place; nothing if it does not."""
    if at + _FIXED.size > len(data):
        return None
    size, ref, pos, named, _, _, cigar, _, bases, mate, mate_pos, _ = _FIXED.unpack_from(data, at)
    begins = at + 36 + named + 4 * cigar + (bases + 1) // 2  # the qualities
    end, tags = at + 4 + size, begins + bases
    if min(ref, pos, mate, mate_pos) < -1 or bases < 0 or named < 2 or not tags <= end <= len(data):
        return None
    name = data[at + 36 : at + 36 + named]
    if name[-1] or any(c < 33 or c > 126 for c in name[:-1]):
        return None
    quality = data[begins : min(tags, begins + 256)]
    if quality and max(quality) > 93 and set(quality) != {0xFF}:
        return None
    tag = data[tags : min(end, tags + 3)]
    if len(tag) == 3 and not (chr(tag[0]).isalpha() and chr(tag[1]).isalnum() and tag[2] in b"AcCsSiIfZHB"):
        return None
    return end


def first_record(data: bytes) -> int | None:
    """The first place from which several likely records follow each other."""
    for begin in range(max(len(data) - _FIXED.size + 1, 0)):
        at: int | None = begin
        for _ in range(_CHAIN):
            at = likely(data, at)
            if at is None:
                break
        if at is not None:
            return begin
    return None


def _distance(tags: bytes, file: str) -> int | None:
    """The value of NM."""
    at = 0
    while at + 3 <= len(tags):
        key, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if key == b"NM" and kind in _NUMBERS:
            return struct.unpack_from(_NUMBERS[kind], tags, at)[0]
        if kind in "ZH":
            at = tags.index(b"\0", at) + 1
        elif kind == "B":
            at += 5 + _SIZES[chr(tags[at])] * struct.unpack_from("<i", tags, at + 1)[0]
        elif kind in _SIZES:
            at += _SIZES[kind]
        else:
            raise ValueError(f"{file}: a tag of unknown kind")
    return None


def record(data: bytes, at: int, end: int, file: str) -> tuple:
    """(name, seq, qual, flag, mapq, nm) of the record at this place."""
    _, _, _, named, mapq, _, cigar, flag, bases, _, _, _ = _FIXED.unpack_from(data, at)
    name = data[at + 36 : at + 35 + named].decode("latin-1").replace(" ", ";")
    at += 36 + named + 4 * cigar
    half = (bases + 1) // 2
    seq = data[at : at + half].hex().translate(_BASES)[:bases]
    qual = data[at + half : at + half + bases]
    return name, seq or None, None if not bases or qual[0] == 0xFF else qual.translate(_PHRED).decode("latin-1"), flag, float(mapq), _distance(data[at + half + bases : end], file)


class _Split:
    """The bytes of one split as they come: its first piece, its records, and what is left."""

    def __init__(self, file: str, begin: int, without: int) -> None:
        self.file, self.begin, self.without = file, begin, without
        self.data, self.found, self.head, self.place, self.look = b"", False, b"", 0, _LOOK

    def _start(self, last: bool) -> None:
        if self.begin:
            at = None
            if last or len(self.data) >= self.look:
                at, self.look = first_record(self.data), 2 * len(self.data)
        else:
            at = after_header(self.data, self.file)
            if at is None and last and self.data:
                raise ValueError(f"{self.file}: the header is cut off, or longer than a split")
        if at is not None:
            self.found, self.head, self.data = True, self.data[:at] if self.begin else b"", self.data[at:]

    def records(self, last: bool) -> Iterator[tuple[int, int]]:
        """Where kept records begin and end in ``data``; whole ones are taken off it afterwards."""
        if not self.found:
            self._start(last)
        if self.found:
            at = 0
            while (end := _next(self.data, at, self.file)) is not None:
                if not struct.unpack_from("<H", self.data, at + 18)[0] & self.without:
                    yield at, end
                    self.place += 1
                at = end
            self.data = self.data[at:]

    def pieces(self) -> list[tuple[str, int, int, int, bytes]]:
        """(file, split, place, kind, data): kind 1 goes with the pieces before, kind 2 begins anew."""
        key = self.file, self.begin, self.place
        return [(*key, 1, self.head), (*key, 2, self.data)] if self.found else [(*key, 1, self.data)]


def _next(data: bytes, at: int, file: str) -> int | None:
    """The end of the record at this place, if it is all there."""
    if at + 4 > len(data):
        return None
    size = int.from_bytes(data[at : at + 4], "little", signed=True)
    if size < 32:
        raise ValueError(f"{file}: a record is damaged")
    return at + 4 + size if at + 4 + size <= len(data) else None


def _walk(without: int, whole: bool):  # noqa: ANN202
    """Rows (file, split, raw) to the records that lie within a split, or else to the pieces between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Split | None = None
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [pa.string(), pa.int64(), pa.int64(), *(_TYPES if whole else [pa.int32(), pa.binary()])]
            names = [x.split()[0] for x in (_ROWS if whole else _PIECES).split(", ")]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def take(split: _Split, last: bool) -> None:
            for at, end in split.records(last):
                if whole:
                    out.append((split.file, split.begin, split.place, *record(split.data, at, end, split.file)))
            if last and not whole:
                out.extend(split.pieces())

        for rows in batches:
            for file, begin, raw in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
                if now is None or (file, begin) != (now.file, now.begin):
                    if now is not None:
                        take(now, True)
                    now = _Split(file, begin, without)
                if raw:  # before the first block of a file is nothing
                    now.data += inflate(raw, file)
                    take(now, False)
                if len(out) >= _MANY:
                    yield batch()
        if now is not None:
            take(now, True)
        if out:
            yield batch()

    return run


def _spliced(without: int):  # noqa: ANN202
    """Rows (file, split, place, parts): pieces of neighbours as the records that they make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for file, split, place, parts in zip(*(rows.column(k).to_pylist() for k in range(4)), strict=True):
                data, at = b"".join(p["data"] for p in parts), 0
                while (end := _next(data, at, file)) is not None:
                    one = record(data, at, end, file)
                    if not one[3] & without:
                        out.append((file, split, place, *one))
                        place += 1
                    at = end
                if at != len(data):
                    raise ValueError(f"{file}: a record is cut off, or records could not be told apart near byte {split}")
            columns = list(zip(*out, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.int64(), *_TYPES], strict=True)], [x.split()[0] for x in _ROWS.split(", ")])

    return run


def read_bam(spark: SparkSession, path: str, file_ix: int = 0, without_flags: int = 768) -> DataFrame:
    """Alignment records with none of the flags, numbered by their order; columns as those of ``read_sam``.

    The file is gone through twice: for the pieces and the numbers of records in each split, and for the records."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", _BEGIN.decode("latin-1")).text(path)
    blocks = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("raw"))
    pieces = cut(blocks.mapInArrow(_walk(without_flags, False), _PIECES))
    # two pieces for each split, none of them longer than a record but for splits in which no record begins
    over = Window.partitionBy("file").orderBy("split", "kind")
    chained = pieces.withColumn("chain", F.sum((F.col("kind") == 2).cast("bigint")).over(over))
    parts = F.sort_array(F.collect_list(F.struct("split", "kind", "data")))
    joined = chained.groupBy("file", "chain").agg(F.min("split").alias("at"), F.max(F.when(F.col("kind") == 2, F.col("split"))).alias("split"), F.max(F.when(F.col("kind") == 2, F.col("place"))).alias("place"), parts.alias("parts"))
    joined = joined.select("file", F.coalesce("split", "at").alias("split"), F.coalesce("place", F.lit(0)).alias("place"), "parts")
    between = cut(joined.mapInArrow(_spliced(without_flags), _ROWS))
    counts = pieces.where("kind = 2").select("file", "split", F.col("place").alias("n")).unionAll(between.groupBy("file", "split").agg(F.count("*").alias("n")))
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    first = counts.groupBy("file", "split").agg(F.sum("n").alias("n")).select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = blocks.mapInArrow(_walk(without_flags, True), _ROWS).unionAll(between).join(first, ["file", "split"])
    names = [x.split()[0] for x in RECORD.split(", ")]
    return rows.select(F.lit(file_ix).alias("file_ix"), (F.col("first") + F.col("place")).alias("ord"), *names)
