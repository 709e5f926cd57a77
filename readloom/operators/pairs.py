"""Pairs of reads: merging by overlap, joining into one record, and splitting by tags."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.sequence import name_tag, reverse_complement
from ..plans import kernel
from .mates import zipped

MERGED = "ord bigint, name string, seq string, qual string, identity double, shift int"


def merge_pairs(left: DataFrame, right: DataFrame, least: int = 16, identity: float = 0.0) -> DataFrame:
    """Merged pairs (ord, name, seq, qual, identity, shift); pairs without a long enough overlap give no row."""
    both = zipped(left, right).select("ord", "name", F.upper("seq").alias("seq"), "qual", reverse_complement(F.col("seq_2")).alias("seq_2"), F.reverse("qual_2").alias("qual_2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, names, a, qa, b, qb = (batch.column(i).to_pylist() for i in range(6))
            merged = kernel.overlaps([(x or "", q, y or "", p) for x, q, y, p in zip(a, qa, b, qb, strict=True)], least, identity)
            rows = [(o, name, *got) for o, name, got in zip(order, names, merged, strict=True) if got]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in MERGED.split(", ")])

    return both.select(F.col("ord").cast("bigint").alias("ord"), "name", "seq", "qual", "seq_2", "qual_2").mapInArrow(run, MERGED)


def join_pairs(left: DataFrame, right: DataFrame, spacer: str = "", barcode: str | None = None) -> DataFrame:
    """Both reads in one record, with a spacer between (whose quality is the lowest)."""
    both = zipped(left, right)
    low = F.lit("!" * len(spacer))
    first = F.concat(F.lit(barcode or ""), F.col("seq"))
    first_q = F.concat(F.lit("I" * len(barcode or "")), F.col("qual"))
    return both.select("ord", "name", F.concat(first, F.lit(spacer), F.col("seq_2")).alias("seq"), F.concat(first_q, low, F.col("qual_2")).alias("qual"))


def split_by_tag(reads: DataFrame, tag: str = "BC") -> DataFrame:
    """Add part: the tag's value in the name, for a partitioned write."""
    return reads.withColumn("part", F.coalesce(name_tag(F.col("name"), tag), F.lit("none")))


def trim_exact(reads: DataFrame, pattern: str, least: int = 16) -> DataFrame:
    """Reads from the end of the pattern's first occurrence (N fits any base); reads without it or left too short go."""
    end = F.regexp_instr("seq", F.lit("(?i)" + pattern.upper().replace("N", "[ACGTN]")))
    cut = reads.withColumn("at", end).where("at > 0")
    return cut.withColumns({"qual": F.expr(f"substring(qual, at + {len(pattern)})"), "seq": F.expr(f"substring(seq, at + {len(pattern)})")}).drop("at").where(F.length("seq") >= least)
