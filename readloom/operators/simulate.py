"""Simulated reads with their truth in the name.

Every read is drawn from a generator seeded by the run's seed and the read's number, so the reads do not
depend on partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Plan:
    """What to simulate: barcodes (the first ``barcode_count`` of them), linkers, payload length and errors."""

    reads: int = 1000
    random_fraction: float = 0.1
    barcodes: tuple[str, ...] = ()
    barcode_count: int = 0
    linker_5: str = ""
    linker_3: str = ""
    read_length: int = 20
    read_length_mod: int = 0
    error_rate: float = 0.02
    indel_fraction: float = 0.0
    end_loss: int = 0
    seed: int = 42

    @cached_property
    def used(self) -> tuple[str, ...]:
        return self.barcodes[: self.barcode_count or len(self.barcodes)]

    @cached_property
    def real(self) -> int:
        """Reads that are not random; the fraction is a number of single precision."""
        return int(self.reads * (1.0 - float(np.float32(self.random_fraction))))


_BASES = np.frombuffer(b"ACGT", np.uint8)


def mutate(seq: str, rate: float, indels: float, rng: np.random.Generator) -> str:
    """Each base fails with ``rate``: an insertion after it or its deletion (half each of ``indels``), else another base."""
    out = []
    for i, c in enumerate(seq):
        if rng.random() >= rate:
            out.append(c)
        elif rng.random() < indels:
            if i < len(seq) - 1 and rng.random() < 0.5:
                out += [c, "ACGT"[rng.integers(4)]]
        else:
            out.append("ACGT".replace(c, "")[rng.integers(3)] if c in "ACGT" else c)
    return "".join(out)


def one(p: Plan, i: int) -> tuple[str, str]:
    """Name and bases of read i; the first ``real`` reads are of the layout, the others random."""
    rng = np.random.default_rng((p.seed, i))
    draw = lambda n: _BASES[rng.integers(0, 4, n)].tobytes().decode()
    length = p.read_length + (int(rng.integers(-p.read_length_mod, p.read_length_mod + 1)) if p.read_length_mod else 0)
    if i < p.real:
        k = int(rng.integers(len(p.used))) if p.used else -1
        tag = p.used[k] if k >= 0 else ""
        payload = draw(max(length, 1))
        seq = mutate(p.linker_5 + tag, p.error_rate, p.indel_fraction, rng) + payload + mutate(p.linker_3, p.error_rate, p.indel_fraction, rng)
        truth = f"SEQ:{payload};" + (f"RBC:{tag};BARNUM:{k + 1}" if p.used else "BARNUM:1")
        name = f"READ{i + 1};{truth}"
    else:
        seq = draw(len(p.linker_5) + (len(p.used[0]) if p.used else 0) + max(length, 1) + len(p.linker_3))
        name = f"RAND{i + 1};SEQ:NONE;" + ("RBC:NONE;BARNUM:0" if p.used else "BARNUM:0")
    if p.end_loss:
        a, b = rng.integers(0, p.end_loss + 1, 2)
        seq = seq[a : max(len(seq) - b, a + 1)]
    return name, seq


def simulate(spark: SparkSession, p: Plan, file_ix: int = 0, keys: DataFrame | None = None) -> DataFrame:
    """(file_ix, ord, name, seq, qual); of the numbers below ``p.reads``, or of those that the first column of ``keys`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            got = [one(p, i) for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([file_ix] * len(got), pa.int32()), ids, pa.array([n for n, _ in got], pa.string()), pa.array([s for _, s in got], pa.string()), pa.array(["I" * len(s) for _, s in got], pa.string())],
                ["file_ix", "ord", "name", "seq", "qual"],
            )

    return (spark.range(p.reads) if keys is None else keys).mapInArrow(run, "file_ix int, ord bigint, name string, seq string, qual string")


def layout_words(p: Plan) -> str:
    """The layout that fits the simulated reads."""
    parts = [f"P:{p.linker_5}"] * bool(p.linker_5) + [f"B:{','.join(p.used)}"] * bool(p.used) + ["R:N"] + [f"P:{p.linker_3}"] * bool(p.linker_3)
    return " ".join(f"-{i} {w}" for i, w in enumerate(parts, 1))


def splitter_tags(p: Plan) -> list[str]:
    """Barcodes as lines ``BC{k}<tab>sequence``, with the 5' linker, for tools that split by exact prefixes."""
    return [f"BC{k}\t{p.linker_5}{t}" for k, t in enumerate(p.used, 1)]


def trimmer_tags(p: Plan) -> list[str]:
    """Barcodes as FASTA records."""
    return [line for k, t in enumerate(p.used, 1) for line in (f">BC{k}", f"{p.linker_5}{t}")]
