"""BAM files against SAM files of the same records."""

from __future__ import annotations

import random
import struct
import zlib

import pytest

from readloom.sources import bam, reads as R

BASES = "=ACMGRSVTWYHKDBN"


def block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return bam._BEGIN + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def packed(name: str, flag: int, mapq: int, seq: str, qual: str, tags: bytes, ref: int) -> bytes:
    codes = [BASES.index(c) for c in seq if seq != "*"]
    half = bytes((codes[i] << 4) | (codes[i + 1] if i + 1 < len(codes) else 0) for i in range(0, len(codes), 2))
    quality = bytes(ord(c) - 33 for c in qual) if qual != "*" else b"\xff" * len(codes)
    cigar = [len(codes) << 4] if codes and ref >= 0 else []
    rest = name.encode() + b"\0" + b"".join(struct.pack("<I", c) for c in cigar) + half + quality + tags
    return struct.pack("<iiiBBHHHiiii", 32 + len(rest), ref, 100 if ref >= 0 else -1, len(name) + 1, mapq, 4680, len(cigar), flag, len(codes), -1, -1, 0) + rest


def made(n: int, longest: int = 120) -> tuple[list[str], list[bytes]]:
    r = random.Random(n)
    lines, records = [], []
    for k in range(n):
        size = r.choice((0, 1, 36, 51, r.randint(2, longest)))
        seq = "".join(r.choice("ACGTN") for _ in range(size)) or "*"
        qual = "*" if seq == "*" or r.random() < 0.2 else "".join(chr(r.randint(33, 74)) for _ in seq)
        flag, mapq, nm = r.choice((0, 4, 16, 256, 512, 1024)), r.randint(0, 60), r.randint(0, 9)
        text, tags = r.choice((("", b""), (f"\tNM:i:{nm}", b"NMC" + bytes([nm])), (f"\tXZ:Z:NM:q\tXB:B:s,1,2\tXF:f:1\tNM:i:{nm}", b"XZZNM:q\0XBBs" + struct.pack("<ihh", 2, 1, 2) + b"XFf" + struct.pack("<f", 1) + b"NMi" + struct.pack("<i", nm))))
        lines.append(f"read:{k}\t{flag}\tchr1\t101\t{mapq}\t{'*' if seq == '*' else f'{size}M'}\t*\t0\t0\t{seq}\t{qual}{text}")
        records.append(packed(f"read:{k}", flag, mapq, seq, qual, tags, 0 if flag != 4 else -1))
    return lines, records


HEADER = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:5000\n"
HEAD = b"BAM\x01" + struct.pack("<i", len(HEADER)) + HEADER.encode() + struct.pack("<ii", 1, 5) + b"chr1\0" + struct.pack("<i", 5000)


def write(path, records: list[bytes], block_size: int) -> None:
    data, r, at, out = HEAD + b"".join(records), random.Random(block_size), 0, b""
    while at < len(data):  # records run across blocks
        n = r.randint(1, block_size)
        out += block(data[at : at + n])
        at += n
    path.write_bytes(out + block(b""))


@pytest.fixture
def splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def to(size: int) -> None:
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield to
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize(("block_size", "split"), [(60_000, 1 << 27), (4_000, 9_000), (700, 2_500), (60_000, 30_000), (90, 300)])
def test_equals_sam(spark, tmp_path, splits, block_size, split):
    lines, records = made(1_500 if split > 300 else 150)
    (tmp_path / "a.sam").write_text(HEADER + "\n".join(lines) + "\n")
    write(tmp_path / "a.bam", records, block_size)
    want = [tuple(r) for r in R.read_sam(spark, str(tmp_path / "a.sam")).orderBy("ord").collect()]
    splits(split)
    got = bam.read_bam(spark, str(tmp_path / "a.bam"))
    assert [tuple(r) for r in got.orderBy("ord").collect()] == want and got.columns == R.read_sam(spark, str(tmp_path / "a.sam")).columns
    assert len(want) > 50 and any(r[3] is None for r in want)


def test_several_files_and_other_flags(spark, tmp_path):
    lines, records = made(60)
    write(tmp_path / "p1.bam", records[:25], 500)
    write(tmp_path / "p2.bam", records[25:], 500)
    got = bam.read_bam(spark, str(tmp_path / "p*.bam"), 3, 0).orderBy("ord").collect()
    assert [(r["file_ix"], r["ord"], r["name"]) for r in got] == [(3, k, f"read:{k}") for k in range(60)]
    assert [r["name"] for r in R.read(spark, [str(tmp_path / "p1.bam")]).orderBy("ord").collect()] == [x.split("\t")[0] for x in lines[:25] if not int(x.split("\t")[1]) & 768]


def test_no_records_and_long_ones(spark, tmp_path, splits):
    write(tmp_path / "e.bam", [], 1_000)
    (tmp_path / "z.bam").write_bytes(b"")
    assert bam.read_bam(spark, str(tmp_path / "e.bam")).count() == bam.read_bam(spark, str(tmp_path / "z.bam")).count() == 0
    _, records = made(30, 40_000)
    write(tmp_path / "l.bam", records, 3_000)
    splits(4_000)  # records longer than splits
    assert [r["name"] for r in bam.read_bam(spark, str(tmp_path / "l.bam"), 0, 0).orderBy("ord").collect()] == [f"read:{k}" for k in range(30)]


@pytest.mark.parametrize(("harm", "message"), [("cut", "cut off"), ("bit", "damaged"), ("text", "unusual"), ("end", "cut off"), ("magic", "not a BAM")])
def test_damage_is_refused(spark, tmp_path, harm, message):
    _, records = made(200)
    path = tmp_path / "d.bam"
    write(path, records, 2_000)
    whole = bytearray(path.read_bytes())
    if harm == "cut":
        whole = whole[:-400]
    elif harm == "bit":
        whole[len(whole) // 2] ^= 0xFF
    elif harm == "text":
        whole = bytearray(b"@HD\tVN:1.6\n")
    elif harm == "end":  # whole blocks, but the last record is not
        data = HEAD + b"".join(records)
        whole = bytearray(block(data[:-10]) + block(b""))
    else:
        whole = bytearray(block(b"CRAM" * 20))
    path.write_bytes(bytes(whole))
    with pytest.raises(Exception, match=message):
        bam.read_bam(spark, str(path)).collect()
