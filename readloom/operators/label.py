"""Label reads with a layout's model: outcome, confidence, barcode, UMI and payloads of every read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..plans import kernel
from ..plans.model import Model, Options

#: From least to greatest precedence where mates or filters disagree.
OUTCOMES = ("success", "mismatch", "too_short", "barcode_missing", "low_complexity", "artifact")
READS = "file_ix int, ord bigint, name string, seq string, qual string"
_EXTRA = "outcome string, q double, barcode_ix int, barcode string, fp bigint, fp_seq string, labels array<int>, payloads array<struct<seq:string,qual:string>>"
LABELLED = f"{READS}, {_EXTRA}"
_PAYLOADS = pa.list_(pa.struct([("seq", pa.string()), ("qual", pa.string())]))
_DIGIT = {"C": 1, "G": 2, "T": 3, "U": 3}


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


def _parts(m: Model, labels: np.ndarray) -> tuple:
    """What follows from the labels alone: the runs of read segments, the barcode's number and bases, and the places of the UMI."""
    seg = m.segment[labels]
    kind = np.array([s.kind for s in m.layout.segments])[seg] if len(labels) else np.array([], "U1")
    found = labels[kind == "B"]
    code, barcode = None, None
    if len(found) and not m.null[found].any():
        code = int(m.alternative[found[0]])
        barcode = "".join(m.layout.segments[s].seqs[int(m.alternative[found[seg[kind == "B"] == s][0]])] for s in dict.fromkeys(seg[kind == "B"].tolist()))
    return _runs(kind == "R"), code, barcode, np.flatnonzero(kind == "F").tolist(), any(s.kind == "B" for s in m.layout.segments), m.layout.umi_length


#: So many ways to label a read are remembered with what follows from them.
_WAYS = 10_000


def take_apart(m: Model, o: Options, seq: str, qual: str | None, labels: np.ndarray, q: float, threshold: float, shift: int, known: dict[bytes, tuple] | None = None) -> tuple:
    """(outcome, barcode_ix, barcode, fp, fp_seq, payloads) of one labelled read; labels begin at base ``shift``.

    ``known`` remembers what follows from labels that were met before."""
    way = labels.tobytes() if known is not None else b""
    parts = known.get(way) if known is not None else None
    if parts is None:
        parts = _parts(m, labels)
        if known is not None:
            if len(known) >= _WAYS:
                known.clear()
            known[way] = parts
    runs, code, barcode, places, coded, umi_length = parts
    end = shift + len(labels)
    if runs and runs[-1][1] == len(labels) and end < len(seq):  # what follows the window goes with the read
        runs = [*runs[:-1], (runs[-1][0], len(seq) - shift)]
    payloads = [(seq[a + shift : b + shift] if seq else None, qual[a + shift : b + shift] if qual else None) for a, b in runs]
    umi = "".join([seq[shift + i] for i in places])
    if q < threshold:
        outcome = "mismatch"
    elif any([len(p[0]) < o.min_length for p in payloads]):
        outcome = "too_short"
    elif coded and code is None or len(umi) != umi_length:
        outcome = "barcode_missing"
    else:
        outcome = "success"
    key = 0
    for c in umi:
        key = key * 4 + _DIGIT.get(c.upper(), 0)
    return outcome, code, barcode, key if umi and len(umi) < 32 else None, umi or None, payloads


#: Bytes of reads that a task remembers with their labels, and what a read takes besides those of its bases.
_MEMORY, _ENTRY = 30_000_000, 400


class _Memory:
    """Labels and confidence of reads; each distinct one is scored once while it is remembered."""

    def __init__(self, m: Model) -> None:
        self.m, self.held = m, 0
        self.known: dict[str, tuple[np.ndarray, float]] = {}

    def label(self, seqs: list[str]) -> list[tuple[np.ndarray, float]]:
        new = [s for s in dict.fromkeys(seqs) if s not in self.known]
        if new:
            size = sum(map(len, new)) * 5 + len(new) * _ENTRY
            if self.held and self.held + size > _MEMORY:
                self.known, self.held = {}, 0
                return self.label(seqs)
            got = kernel.label(self.m, new)
            self.known.update(zip(new, zip(got.labels, got.q.tolist(), strict=True), strict=True))
            self.held += size
        out = [self.known[s] for s in seqs]
        if self.held > _MEMORY:  # a batch of long reads is more than is kept
            self.known, self.held = {}, 0
        return out


#: Reads that are labelled together (like beginnings share their steps), and the bases of as many of the longest.
_ROWS, _ROW_BASES = 10_000, 4_000_000


def _lists(parts: list, kind: pa.DataType, values: pa.Array) -> pa.Array:
    """A list of some of the values for each of the parts."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values).cast(kind)


def label(reads: DataFrame, m: Model, threshold: float, o: Options = Options()) -> DataFrame:
    """Label every read.  A layout of nothing but a read needs no model: all of each read is its payload."""
    reads = reads.select("file_ix", "ord", "name", "seq", "qual")
    if m.layout.plain:
        whole = F.array(F.struct(F.col("seq").alias("seq"), F.col("qual").alias("qual")))
        return reads.select(
            "*", F.lit("success").alias("outcome"), F.lit(-1.0).alias("q"), F.lit(None).cast("int").alias("barcode_ix"), F.lit(None).cast("string").alias("barcode"), F.lit(None).cast("bigint").alias("fp"),
            F.lit(None).cast("string").alias("fp_seq"), F.array_repeat(F.lit(0), F.length("seq")).alias("labels"), whole.alias("payloads"),
        )
    shared = reads.sparkSession.sparkContext.broadcast((m, o))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, opts = shared.value
        first = (opts.start or 1) - 1
        names = [x.split()[0] for x in READS.split(", ")] + ["outcome", "q", "barcode_ix", "barcode", "fp", "fp_seq", "labels", "payloads"]
        memory, ways = _Memory(model), {}
        for batch in batches:
            rows = max(1, min(_ROWS, _ROW_BASES // max(1, pc.max(pc.binary_length(batch.column(3))).as_py() or 0)))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                seqs, quals = [s or "" for s in part.column(3).to_pylist()], part.column(4).to_pylist()
                got = memory.label([s[first : opts.end] for s in seqs])
                out = [take_apart(model, opts, s, u, lab, q, threshold, first, ways) for s, u, (lab, q) in zip(seqs, quals, got, strict=True)]
                col = lambda k, kind: pa.array([r[k] for r in out], kind)
                flat = [p for r in out for p in r[5]]
                payloads = _lists([r[5] for r in out], _PAYLOADS, pa.StructArray.from_arrays([pa.array([p[k] for p in flat], pa.string()) for k in (0, 1)], ["seq", "qual"]))
                labels = _lists([x for x, _ in got], pa.list_(pa.int32()), pa.array(np.concatenate([x for x, _ in got]).astype(np.int32)))
                extra = [col(0, pa.string()), pa.array([q for _, q in got], pa.float64()), col(1, pa.int32()), col(2, pa.string()), col(3, pa.int64()), col(4, pa.string()), labels, payloads]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names)

    return reads.select(F.col("file_ix").cast("int").alias("file_ix"), F.col("ord").cast("bigint").alias("ord"), "name", "seq", "qual").mapInArrow(run, LABELLED)


#: A read that a layout cannot show at all counts as so unlikely; else one such read would rule the layout out.
LEAST_LOG = -1e6


def log_likelihoods(reads: DataFrame, models: list[Model]) -> DataFrame:
    """(layout_id, log_likelihood): the sum over all reads for every model, added up per batch before the shuffle.

    No read counts for less than ``LEAST_LOG``."""
    shared = reads.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [s or "" for s in batch.column(0).to_pylist()]
            sums = [float(np.maximum(kernel.log_likelihood(m, seqs), LEAST_LOG).sum()) if seqs else 0.0 for m in shared.value]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.float64())], ["layout_id", "part"])

    return reads.select("seq").mapInArrow(run, "layout_id int, part double").groupBy("layout_id").agg(F.sum("part").alias("log_likelihood"))
