"""Files that belong together: record k of one file is the mate of record k of the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import sequence as S
from .filters import rank
from .label import OUTCOMES


class MateError(ValueError):
    """Files that do not go together."""


def counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy("file_ix").agg(F.count("*").alias("n"))


def check_counts(reads: DataFrame) -> None:
    """All files have one number of reads."""
    found = counts(reads).agg(F.min("n"), F.max("n")).first()
    if found[0] != found[1]:
        raise MateError(f"files have from {found[0]} to {found[1]} reads")


def unlike_names(reads: DataFrame) -> DataFrame:
    """(ord, names): records whose names do not go together.  One aggregate over all files and all reads."""
    part = S.comparable_name(F.col("name"))
    return reads.groupBy("ord").agg(F.sort_array(F.collect_set(part)).alias("names")).where(F.size("names") > 1)


def check_names(reads: DataFrame) -> None:
    row = unlike_names(reads).orderBy("ord").first()
    if row:
        raise MateError(f"record {row['ord']}: {' and '.join(row['names'])}")


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records of two files, side by side: columns of the right one end in ``_2``."""
    other = right.select(*[F.col(c).alias(c if c == "ord" else f"{c}_2") for c in right.columns])
    return left.join(other, "ord")


def combine(reads: DataFrame) -> DataFrame:
    """One outcome and one barcode per record: the worst of its mates, and the one that has a barcode."""
    worst = F.element_at(F.array(*map(F.lit, OUTCOMES)), F.max(rank(F.col("outcome"))).cast("int"))
    files = F.sort_array(F.collect_list(F.struct("file_ix", "name", "payloads", "fp", "fp_seq", "q")))
    return reads.groupBy("ord").agg(worst.alias("outcome"), F.max("barcode").alias("barcode"), F.max("contaminant_ix").alias("contaminant_ix"), files.alias("files"))


def alone(reads: DataFrame) -> DataFrame:
    """The rows of ``combine`` for a single file, without a shuffle."""
    return reads.select("ord", "outcome", "barcode", "contaminant_ix", F.array(F.struct("file_ix", "name", "payloads", "fp", "fp_seq", "q")).alias("files"))


def output_reads(combined: DataFrame) -> DataFrame:
    """(ord, sample, read_ix, name, seq, qual, outcome): the payloads of all mates, numbered through all files."""
    parts = F.flatten(F.transform("files", lambda f: F.transform(f["payloads"], lambda p: F.struct(f["name"].alias("name"), p["seq"].alias("seq"), p["qual"].alias("qual"), f["fp"].alias("fp"), f["fp_seq"].alias("fp_seq"), f["q"].alias("q")))))
    out = combined.select("ord", "outcome", "barcode", "contaminant_ix", F.posexplode(parts).alias("ix", "r"))
    return out.select("ord", "outcome", "barcode", "contaminant_ix", (F.col("ix") + 1).alias("read_ix"), "r.*")
