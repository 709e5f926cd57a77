"""Media columns: Matroska files in binary columns, as packet tables.

The reader walks EBML elements (variable-length ids and sizes, known and unknown lengths), and turns
clusters, blocks and simple blocks with any lacing into packets with track, timestamp, flags and byte range;
cues are read as an index.  The writer stores 8-bit PCM samples in laced simple blocks with cues.

Defined results: a null value has no packets; bytes that end early or hold a broken element give the
packets before it and a note in ``error``; unknown elements are skipped, and so is a reference outside of a group of
blocks; an empty table gives an empty result; equal bytes give equal packets, and repeated rows a row each; texts of any
length are stored whole, in as many packets as they need; columns but the id and the text or file are not used.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import give_back, to_python

# Element ids of the format.  Fixed values.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, SCALE, DURATION, TRACK, NUMBER, UID, TYPE, CODEC, LACING = 0x4282, 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_PARENTS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_PLACE}
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770}
_UNKNOWN = -1

#: Payloads are multiples of this many bytes: 24 ms of samples, one frame.
FRAME = 192
SAMPLE_RATE = 8000
FRAME_MS = 24
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 160


class Broken(ValueError):
    """The bytes end early or break the format's rules."""


# -- writing ----------------------------------------------------------------------------------------


def vint(x: int, length: int | None = None) -> bytes:
    """A variable-length size."""
    n = length or next(k for k in range(1, 9) if x < (1 << 7 * k) - 1)
    return (x | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def _uint(ident: int, x: int) -> bytes:
    return element(ident, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: str) -> tuple[int, bytes]:
    """The flag bits and the body of a block with several frames."""
    if lacing == "none" or len(frames) == 1:
        if len(frames) != 1:
            raise ValueError("several frames need lacing")
        return 0, frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if lacing == "xiph":
        flag, head = 1, head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == "fixed":
        if len(set(sizes)) != 1:
            raise ValueError("frames differ in size")
        flag = 2
    else:
        flag, head = 3, head + vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            n = next(k for k in range(1, 9) if abs(b - a) < (1 << 7 * k - 1) - 1)
            head += vint(b - a + (1 << 7 * n - 1) - 1, n)
    return flag << 1, head + b"".join(frames)


def write_pcm(payload: bytes, lacing: str = "fixed", frame: int = FRAME) -> bytes:
    """A file with one audio track of 8-bit samples: the payload, whole."""
    head = element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    info = element(INFO, _uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)) + element(0x4D80, b"readloom") + element(0x5741, b"readloom"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, _uint(NUMBER, 1) + _uint(UID, 1) + _uint(TYPE, 2) + _uint(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, at, cues = [info, tracks], len(info) + len(tracks), []
    ms = lambda k: k * frame * 1000 // SAMPLE_RATE
    # a block's offset from its cluster is a signed 16-bit number of milliseconds
    per = max(1, min(FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER, 30 * SAMPLE_RATE // frame))
    for c in range(0, len(frames), per):
        blocks = [_uint(TIMESTAMP, ms(c))]
        for b in range(c, min(c + per, len(frames)), FRAMES_PER_BLOCK):
            flag, data = laced(frames[b : min(b + FRAMES_PER_BLOCK, c + per)], lacing)
            blocks.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", ms(b) - ms(c), 0x80 | flag) + data))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, ms(c)) + element(CUE_PLACE, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


# -- reading ----------------------------------------------------------------------------------------


@dataclass
class Media:
    """What a file holds.  Packets: (track, timestamp in ns, offset, size, keyframe, number of the cluster)."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, offset of the cluster in the segment
    clusters: list[int] = field(default_factory=list)  # offsets in the segment
    scale: int = 1_000_000
    duration: float | None = None
    error: str | None = None


def _number(data: bytes, at: int, end: int, marker: bool) -> tuple[int, int]:
    """A variable-length number and where it ends; ids keep their length marker."""
    if at >= end or not data[at]:
        raise Broken(f"no number at {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise Broken(f"a number at {at} ends early")
    x = int.from_bytes(data[at : at + n], "big")
    if marker:
        return x, at + n
    x -= 1 << 7 * n
    return (_UNKNOWN if x == (1 << 7 * n) - 1 else x), at + n


def _float(data: bytes) -> float:
    return struct.unpack(">d" if len(data) == 8 else ">f", data)[0] if len(data) in (4, 8) else 0.0


def frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames by its lacing (0 none, 1 Xiph, 2 fixed, 3 EBML) and where the first begins."""
    if not kind:
        return [end - at], at
    if at >= end:
        raise Broken(f"no lace at {at}")
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == 2:
        if (end - at) % n:
            raise Broken(f"uneven lace at {at}")
        return [(end - at) // n] * n, at
    for k in range(n - 1):
        if kind == 1:
            size = 0
            while True:
                if at >= end:
                    raise Broken(f"a lace ends early at {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
        else:
            raw, after = _number(data, at, end, False)
            if k == 0:
                size = raw
            else:
                raw = (1 << 7 * (after - at)) - 1 if raw == _UNKNOWN else raw
                size = sizes[-1] + raw - ((1 << 7 * (after - at) - 1) - 1)
            at = after
        if size < 0:
            raise Broken(f"a negative frame at {at}")
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if sizes[-1] < 0:
        raise Broken(f"a lace is longer than its block at {at}")
    return sizes, at


#: What the packet table's columns hold, and how deep elements may nest (the format's own parents nest four deep).
_MOST_TRACK, _MOST_TIME, _DEEPEST = (1 << 31) - 1, (1 << 63) - 1, 64


def read(data: bytes | None) -> Media:
    """Walk all elements of a file.  Where it is broken, or a number is out of the table's range, the walk ends with an error and keeps the packets so far."""
    out = Media()
    state = {"segment": 0, "time": 0, "track": {}, "cue": [0, 0, 0], "group": None}

    def block(at: int, end: int, simple: bool) -> None:
        track, at = _number(data, at, end, False)
        if at + 3 > end:
            raise Broken(f"a block ends early at {at}")
        if track > _MOST_TRACK:
            raise Broken(f"a track's number is out of range at {at}")
        offset, flags = struct.unpack_from(">hB", data, at)
        sizes, at = frame_sizes(data, at + 3, end, flags >> 1 & 3)
        start = (state["time"] + offset) * out.scale
        step = out.tracks.get(track, {}).get("frame_ns")
        key = bool(flags & 0x80) if simple else True
        first = at
        for size in sizes:
            # frames of a lace follow each other: by their samples where the codec is PCM
            when = start + step(at - first) if step else start
            if not -_MOST_TIME <= when <= _MOST_TIME:
                raise Broken(f"a time is out of range at {at}")
            out.packets.append((track, when, at, size, key, len(out.clusters) - 1))
            at += size

    def leaf(ident: int, at: int, end: int) -> None:
        if ident == SIMPLE_BLOCK:
            return block(at, end, True)
        if ident == BLOCK:
            return block(at, end, False)
        if ident == REFERENCE:
            first = state["group"]
            if first is None:  # it tells of a block of its own group only
                return None
            out.packets[first:] = [(*p[:4], False, p[5]) for p in out.packets[first:]]
            return None
        if end - at > 64 and ident != CODEC:
            return None
        raw = data[at:end]
        if ident == TIMESTAMP:
            state["time"] = int.from_bytes(raw, "big")
        elif ident == SCALE:
            out.scale = int.from_bytes(raw, "big")
        elif ident == DURATION:
            out.duration = _float(raw)
        elif ident in (NUMBER, TYPE, CHANNELS, DEPTH, UID):
            state["track"][ident] = int.from_bytes(raw, "big")
        elif ident == RATE:
            state["track"][ident] = _float(raw)
        elif ident == CODEC:
            state["track"][ident] = raw.decode("latin-1")
        elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            state["cue"][(CUE_TIME, CUE_TRACK, CUE_CLUSTER).index(ident)] = int.from_bytes(raw, "big")
        return None

    def closed(ident: int) -> None:
        if ident == TRACK:
            t = state["track"]
            width = max(1, t.get(CHANNELS, 1) * t.get(DEPTH, 8) // 8)
            rate = t.get(RATE) or 0.0
            pcm = str(t.get(CODEC, "")).startswith("A_PCM") and 1e-3 <= rate <= 1e12
            out.tracks[t.get(NUMBER, 0)] = {"codec": t.get(CODEC), "type": t.get(TYPE), "rate": t.get(RATE), "channels": t.get(CHANNELS), "depth": t.get(DEPTH)} | ({"frame_ns": lambda n: round(n / width * 1e9 / rate)} if pcm else {})
        elif ident == CUE_PLACE:
            time, track, place = state["cue"]
            if track > _MOST_TRACK or max(time, place) > _MOST_TIME:
                raise Broken("a cue is out of range")
            out.cues.append((time, track, place))

    def walk(at: int, end: int, parent: int, depth: int = 0) -> int:
        if depth > _DEEPEST:
            raise Broken(f"elements nest too deep at {at}")
        while at < end:
            start = at
            ident, at = _number(data, at, end, True)
            if parent == CLUSTER and ident in _TOP:
                return start  # a cluster of unknown length ends where the next part begins
            size, at = _number(data, at, end, False)
            stop = end if size == _UNKNOWN else at + size
            if size == _UNKNOWN and ident not in (SEGMENT, CLUSTER):
                raise Broken(f"an unknown length at {start}")
            short, stop = stop > end, min(stop, end)
            if ident in _PARENTS:
                if ident == SEGMENT:
                    state["segment"] = at
                elif ident == CLUSTER:
                    out.clusters.append(start - state["segment"])
                elif ident == TRACK:
                    state["track"] = {}
                elif ident == BLOCK_GROUP:
                    state["group"] = len(out.packets)
                at = walk(at, stop, ident if size == _UNKNOWN else 0, depth + 1)
                closed(ident)
                if ident == BLOCK_GROUP:
                    state["group"] = None
            elif not short:
                leaf(ident, at, stop)
                at = stop
            if short:
                raise Broken(f"an element at {start} ends early")
        return at

    if data:
        try:
            walk(0, len(data), 0)
        except Broken as e:
            out.error = str(e)
    return out


PACKETS = "packets array<struct<track:int,timestamp_ns:bigint,offset:bigint,size:bigint,keyframe:boolean,cluster:int>>, cues array<struct<time:bigint,track:int,cluster_offset:bigint>>, error string"


def packet_table(df: DataFrame, media_col: str, id_col: str) -> DataFrame:
    """(id, packets, cues, error) of every row's file; ``explode`` the packets for one row each."""
    kind = pa.list_(pa.struct([("track", pa.int32()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("cluster", pa.int32())]))
    cue = pa.list_(pa.struct([("time", pa.int64()), ("track", pa.int32()), ("cluster_offset", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 64):
                part = batch.slice(at, 64)
                found = [read(x) for x in part.column(1).to_pylist()]
                packets = pa.array([[dict(zip(("track", "timestamp_ns", "offset", "size", "keyframe", "cluster"), p, strict=True)) for p in m.packets] for m in found], kind)
                cues = pa.array([[dict(zip(("time", "track", "cluster_offset"), c, strict=True)) for c in m.cues] for m in found], cue)
                yield pa.RecordBatch.from_arrays([part.column(0), packets, cues, pa.array([m.error for m in found], pa.string())], ["id", "packets", "cues", "error"])
        give_back()

    kind_of = df.schema[id_col].dataType.simpleString()
    return to_python(df).select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, f"id {kind_of}, {PACKETS}")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's bytes, padded with spaces to a positive multiple of the frame; and their number without padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(FRAME, -(-len(raw) // FRAME) * FRAME), b" "), len(raw)


def features(payload: bytes, media: Media) -> str:
    """Figures of the samples (unsigned, centred on 128) and of the packet table."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    some = share[share > 0]
    y = x.astype(np.float64) - 128
    span = max((p[1] for p in media.packets), default=0) // 1_000_000 + FRAME_MS
    crossings = int(np.count_nonzero((y[1:] >= 0) != (y[:-1] >= 0)))
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={span};mean={y.mean():.4f};rms={np.sqrt((y * y).mean()):.4f};crossings={crossings};entropy={-(some * np.log2(some)).sum():.4f}"


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame) -> DataFrame:
    """Store every text of (doc_id, text) as samples of a file, read the packets back, and describe both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 256):
                part, rows = batch.slice(at, 256), []
                for text in part.column(1).to_pylist():
                    payload, n = payload_of(text)
                    blob = write_pcm(payload)
                    media = read(blob)
                    back = b"".join([blob[p[2] : p[2] + p[3]] for p in media.packets])
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), features(back, media)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [x.split()[0] for x in STORED.split(", ")])
        give_back()

    return to_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORED)
