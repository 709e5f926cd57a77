"""Filters over labelled reads: low complexity and known contaminants."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import sequence as S
from ..plans import kernel
from ..sources.scratch import cut
from .label import OUTCOMES

#: Bases of a payload that are held against contaminants.
PROBE = 32
#: References of at most so many bases together are sent to every executor.
PART_BASES = 2_000_000
_OTHER = re.compile(r"[^ACGT.]")


def rank(outcome: Column) -> Column:
    """Precedence of an outcome."""
    return F.array_position(F.array(*map(F.lit, OUTCOMES)), outcome)


def long_payloads(reads: DataFrame, seq: Column, least: int) -> DataFrame:
    """Add payload, and leave out reads without one of at least so many bases."""
    return reads.withColumn("payload", seq).where(F.length("payload") >= least)


def low_complexity(reads: DataFrame, cut: float) -> DataFrame:
    """Outcome low_complexity for reads whose first payload scores above ``cut`` (0: off).  It overrides failures."""
    if not cut:
        return reads
    score = S.dust_score(F.col("payloads")[0]["seq"])
    return reads.withColumn("outcome", F.when(score > cut, "low_complexity").otherwise(F.col("outcome")))


def _clean(seq: str) -> str:
    """As ``sequence.clean``: the letters that the alignment tells apart."""
    return _OTHER.sub("N", seq.upper().replace("U", "T"))


class _References:
    """One part of the references, ready to search: both strands in one row of codes, and where their pieces occur.

    A probe with at most k errors has, among k + 1 pieces, one that occurs exactly; it is aligned with the windows
    around those places only, and so is only one of windows that read alike."""

    #: Pieces of short probes have so many bases; probes with shorter pieces are aligned with whole references.
    SHORT = 5
    #: Windows that are aligned at once.
    MOST = 50_000
    _GAP = 9  # a code that fits no base

    def __init__(self, refs: list[tuple[int, str]], errors: int) -> None:
        self.errors, self.piece = errors, PROBE // (errors + 1)
        self.reach = PROBE + 2 * errors
        flip = str.maketrans("ACGT", "TGCA")
        self.texts = [(ix, kernel.encode([s])[0][0]) for ix, seq in refs for s in (_clean(seq), _clean(seq).translate(flip)[::-1])]
        gap = np.full(self.reach, self._GAP, np.uint8)
        self.flat = np.concatenate([gap, *(x for _, text in self.texts for x in (text, gap))])
        ends = np.cumsum([len(text) + self.reach for _, text in self.texts])
        self.starts, self.owner = np.concatenate(([0], ends[:-1])) if len(ends) else ends, np.array([ix for ix, _ in self.texts])
        self.places: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _hash(codes: np.ndarray, size: int) -> np.ndarray:
        """A number for each run of ``size`` codes along the last axis."""
        n = codes.shape[-1] - size + 1
        out = np.zeros((*codes.shape[:-1], max(n, 0)), np.uint64)
        for k in range(size if n > 0 else 0):
            out = out * np.uint64(0x9E3779B97F4A7C15) + codes[..., k : k + n].astype(np.uint64) + np.uint64(1)
        return out

    def _indexed(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces of a size, in order, and where each is."""
        if size not in self.places:
            number = self._hash(self.flat, size)
            gaps = np.concatenate(([0], np.cumsum(self.flat == self._GAP)))
            at = np.flatnonzero(gaps[size:] == gaps[: len(gaps) - size]).astype(np.int32)
            order = np.argsort(number[at], kind="stable")
            self.places[size] = number[at][order], at[order]
        return self.places[size]

    def _whole(self, probes: list[str]) -> np.ndarray:
        """For each probe, the best of errors and reference as one number, from alignments with whole references."""
        x, n = kernel.encode(probes)
        best = np.full(len(probes), _NONE)
        for ix, text in self.texts:
            d = kernel.search_many(x, n, text)
            best = np.where(d <= self.errors, np.minimum(best, d * _ERROR + ix), best)
        return best

    def _seeded(self, probes: list[str], size: int) -> np.ndarray:
        """The same, from the places of pieces of ``size`` bases."""
        number, place = self._indexed(size)
        x, n = kernel.encode(probes)
        best, rows = np.full(len(probes), _NONE), np.arange(len(probes))
        for k in range(self.errors + 1):
            first = k * (n // (self.errors + 1))
            piece = self._hash(x[rows[:, None], first[:, None] + np.arange(size)], size)[:, 0]
            lo, hi = np.searchsorted(number, piece, "left"), np.searchsorted(number, piece, "right")
            done = np.concatenate(([0], np.cumsum(hi - lo)))
            for at in range(0, int(done[-1]), self.MOST):
                which = np.arange(at, min(at + self.MOST, int(done[-1])))
                probe = np.searchsorted(done, which, "right") - 1
                start = place[lo[probe] + which - done[probe]] - first[probe] - self.errors
                ix = self.owner[np.searchsorted(self.starts, start + first[probe] + self.errors, "right") - 1]
                reach = np.clip(start[:, None] + np.arange(self.reach), 0, len(self.flat) - 1)
                alike = np.column_stack((probe, self._hash(self.flat[reach], self.reach)[:, 0].view(np.int64)))
                order = np.lexsort((ix, alike[:, 1], alike[:, 0]))  # of like windows, that of the first reference
                one = order[np.concatenate(([True], (alike[order][1:] != alike[order][:-1]).any(1)))]
                d = kernel.search_windows(x[probe[one]], n[probe[one]], self.flat[reach[one]])
                near = d <= self.errors
                np.minimum.at(best, probe[one][near], d[near] * _ERROR + ix[one][near])
        return best

    def best(self, probes: list[str]) -> list[tuple[int, int] | None]:
        """(errors, reference) of each probe's best match within the limit; the first reference wins ties."""
        distinct, back = np.unique(np.array([_clean(p)[:PROBE] for p in probes], object), return_inverse=True) if probes else (np.array([], object), [])
        size = np.array([len(p) // (self.errors + 1) for p in distinct], int)
        best = np.full(len(distinct), _NONE)
        for kind, which in ((self.piece, size >= self.piece), (min(self.SHORT, self.piece), (size < self.piece) & (size >= self.SHORT)), (0, (size < min(self.SHORT, self.piece)) & (distinct != ""))):
            if which.any():
                some = distinct[which].tolist()
                best[which] = self._seeded(some, kind) if kind else self._whole(some)
        return [None if b == _NONE else (int(b) // _ERROR, int(b) % _ERROR) for b in best[back]]


#: A match as one number: its errors times this, and its reference; and no match.
_ERROR, _NONE = 1 << 40, (1 << 62)
#: The last index of references that a worker made, which it keeps for its next tasks.
_INDEX: dict[str, _References] = {}


def match_references(probes: DataFrame, refs: list[tuple[int, str]], errors: int) -> DataFrame:
    """Add ``hit`` (errors, reference) to rows with a ``probe``; null where nothing is near enough."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in probes.schema)
    shared = probes.sparkSession.sparkContext.broadcast((refs, errors))
    kind = pa.struct([("errors", pa.int32()), ("reference", pa.int32())])
    at = probes.columns.index("probe")
    names, token = [*probes.columns, "hit"], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _INDEX:
            _INDEX.clear()
            _INDEX[token] = _References(*shared.value)
        index = _INDEX[token]
        for batch in batches:
            hits = index.best([p or "" for p in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h and {"errors": h[0], "reference": h[1]} for h in hits], kind)], names)

    return probes.mapInArrow(run, f"{fields}, hit struct<errors:int,reference:int>")


#: Bases of a reference in one row while its pieces are taken; a place costs as much as the row is long.
_CHUNK = 512


def _chunks(references: DataFrame, reach: int) -> DataFrame:
    """(reference, text, own): both strands of all references, in rows of bounded size.

    The text of a row begins ``reach`` bases before its own places, of which there are ``own``, and ends as far behind them; beyond a reference's
    ends it has bars, which fit no base."""
    clean = F.regexp_replace(F.translate(F.upper("seq"), "U", "T"), "[^ACGT.]", "N")
    both = references.where(F.col("seq").isNotNull()).select(F.col("ref_ix").alias("reference"), F.explode(F.array(clean, F.reverse(F.translate(clean, "ACGT", "TGCA")))).alias("s"))
    bars = F.lit("|" * reach)
    cut = both.where(F.length("s") > 0).select("reference", F.length("s").alias("n"), F.concat(bars, "s", bars).alias("s"), F.explode(F.sequence(F.lit(0), F.length("s") - 1, F.lit(_CHUNK))).alias("at"))
    return cut.select("reference", F.substring("s", F.col("at") + 1, F.lit(_CHUNK + 2 * reach)).alias("text"), F.least(F.lit(_CHUNK), F.col("n") - F.col("at")).alias("own"))


def _verified(errors: int):  # noqa: ANN202
    """Of each probe and window, the least edit distance of the probe to any part of the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probes, windows = (batch.column(k).to_pylist() for k in (0, 1))
            if not probes:
                continue
            x, n = kernel.encode(probes)
            codes, _ = kernel.encode(windows)
            wide = np.frombuffer("".join(windows).encode(), np.uint8).reshape(len(windows), -1)
            d = kernel.search_windows(x, n, np.where(wide == ord("|"), _References._GAP, codes))
            keep = d <= errors
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(2).filter(pa.array(keep)), pa.array(d[keep].astype(np.int32))], ["probe", "reference", "errors"])

    return run


def seeded_matches(probes: DataFrame, references: DataFrame, errors: int) -> DataFrame:
    """(probe, hit): the best match (errors, reference) of each distinct probe that has one, for references of any size.

    A probe with at most k errors has, among k + 1 pieces, one that occurs exactly.  So the pieces of all probes are joined
    with all places of the references, and the window around each place is aligned, once for each probe and text of a window.
    Pieces that are frequent on both sides are split by adaptive skew handling; places that read alike count once, which
    is what most of a frequent piece's places do.  Nothing passes the driver but the few lengths that pieces have."""
    reach = PROBE + 2 * errors
    parts = errors + 1
    known = cut(probes.select("probe").where(F.length("probe") > 0).distinct().withColumn("size", F.floor(F.length("probe") / parts).cast("int")))
    sizes = [r["size"] for r in known.select("size").distinct().collect()]  # at most PROBE
    long, found = [x for x in sizes if x >= min(_References.SHORT, PROBE // parts)], []
    if long:
        chunks = _chunks(references, reach)
        wanted = known.where(F.col("size").isin(long)).select("probe", "size", F.explode(F.sequence(F.lit(0), F.lit(errors))).alias("k"))
        wanted = wanted.withColumn("piece", F.substring("probe", F.col("k") * F.col("size") + 1, F.col("size")))
        # from some bases before where a probe with the piece would begin to as many behind its end, for each of its pieces
        def places(size: int) -> Column:
            window = lambda i, k: F.substring("text", i + reach - k * size - errors, F.lit(reach))
            return F.transform(F.sequence(F.lit(1), F.col("own")), lambda i: F.struct(F.substring("text", i + reach, F.lit(size)).alias("piece"), F.array(*[window(i, k) for k in range(parts)]).alias("windows")))

        each = [chunks.select("reference", F.inline(places(n))).withColumn("size", F.lit(n)) for n in long]
        placed = each[0]
        for more in each[1:]:
            placed = placed.unionByName(more)
        placed = placed.join(wanted.select("size", "piece", "k").distinct(), ["size", "piece"])
        windows = placed.groupBy("size", "piece", "k", F.element_at("windows", F.col("k") + 1).alias("window")).agg(F.min("reference").alias("reference"))
        pairs = wanted.join(windows, ["size", "piece", "k"]).groupBy("probe", "window").agg(F.min("reference").alias("reference"))
        found.append(pairs.select("probe", "window", "reference").mapInArrow(_verified(errors), f"probe string, reference {_kind(references)}, errors int"))
    short = [x for x in sizes if x not in long]
    if short:  # probes too short for pieces are aligned with whole rows of the references
        few = known.where(F.col("size").isin(short)).select("probe", F.explode(F.sequence(F.lit(0), F.lit(_SPREAD - 1))).alias("part"))
        rows = _chunks(references, reach).select("reference", "text", F.pmod(F.xxhash64("text"), F.lit(_SPREAD)).cast("int").alias("part"))
        found.append(few.groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(_aligned(errors), f"probe string, reference {_kind(references)}, errors int"))
    out = found[0] if found else known.select("probe", F.lit(0).cast(_kind(references)).alias("reference"), F.lit(0).alias("errors")).limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("probe").agg(F.min(F.struct("errors", "reference")).alias("hit"))


#: Parts of references that short probes are held against.
_SPREAD = 200


def _kind(references: DataFrame) -> str:
    return references.schema["ref_ix"].dataType.simpleString()


def _aligned(errors: int):  # noqa: ANN202
    """Each probe with every row of a part of the references."""

    def run(probes: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[tuple[str, int], int] = {}
        if probes.num_rows and rows.num_rows:
            names = probes["probe"].to_pylist()
            x, n = kernel.encode(names)
            for text, ix in zip(rows["text"].to_pylist(), rows["reference"].to_pylist(), strict=True):
                codes = kernel.encode([text])[0][0]
                codes[np.frombuffer(text.encode(), np.uint8) == ord("|")] = _References._GAP
                for k in np.flatnonzero((d := kernel.search_many(x, n, codes)) <= errors).tolist():
                    out[names[k], ix] = min(int(d[k]), out.get((names[k], ix), errors))
        kind = rows.schema.field("reference").type
        return pa.table([pa.array([p for p, _ in out], pa.string()), pa.array([ix for _, ix in out], kind), pa.array(list(out.values()), pa.int32())], names=["probe", "reference", "errors"])

    return run


def contaminants(reads: DataFrame, references: DataFrame, errors: int = 2) -> DataFrame:
    """Outcome artifact, and contaminant_ix, for successful reads whose first bases match a reference (ref_ix, seq).

    Only reads that are still successful are searched; a read keeps its best match, the first reference on ties.  References
    of a bounded size (``PART_BASES``) go to every executor, and reads stay where they are; larger ones are joined with the
    distinct probes (``seeded_matches``)."""
    total = references.agg(F.sum(F.length("seq"))).first()[0] or 0
    probe = F.when(F.col("outcome") == "success", F.upper(F.substring(F.col("payloads")[0]["seq"], 1, PROBE)))
    out = reads.withColumn("hit", F.lit(None).cast(f"struct<errors:int,reference:{_kind(references)}>"))
    if total > PART_BASES:
        probed = reads.withColumn("probe", F.regexp_replace(F.translate(probe, "U", "T"), "[^ACGT.]", "N"))
        out = probed.join(seeded_matches(probed, references, errors), "probe", "left").select(*reads.columns, "hit")
    elif total:
        part = [(r["ref_ix"], r["seq"]) for r in references.where(F.col("seq").isNotNull()).select("ref_ix", "seq").orderBy("ref_ix").collect()]
        out = match_references(reads.withColumn("probe", probe), part, errors).drop("probe")
    return out.withColumn("outcome", F.when(F.col("hit").isNotNull(), "artifact").otherwise(F.col("outcome"))).withColumn("contaminant_ix", F.col("hit.reference").cast("int")).drop("hit")


def flags_without(reads: DataFrame, mask: int = 768) -> DataFrame:
    """SAM records with none of the mask's flags."""
    return reads.where(F.col("flag").bitwiseAND(F.lit(mask)) == 0)


def summary(reads: DataFrame, count: Column | None = None) -> DataFrame:
    """(outcome, contaminant_ix, n, percent) over all reads, which are gone through once; or over counts of them."""
    counts = reads.groupBy("outcome", "contaminant_ix").agg((F.count("*") if count is None else count).alias("n"))
    # the window is over the few rows of the result
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("outcome", "contaminant_ix", "n", F.round(100.0 * F.col("n") / total, 4).alias("percent"))
