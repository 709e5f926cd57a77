"""Counting by unique molecular identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def molecules(reads: DataFrame) -> DataFrame:
    """(fp, chrom, pos, n): reads of each molecule."""
    return reads.groupBy("fp", "chrom", "pos").agg(F.count("*").alias("n"))


def per_chrom(molecules_: DataFrame, *by: str) -> DataFrame:
    """(by, chrom, with_umi, without_umi): molecules, and reads."""
    return molecules_.groupBy(*by, "chrom").agg(F.count("*").alias("with_umi"), F.sum("n").alias("without_umi"))


def side_by_side(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b): the values of both tables, 0 where one has none."""
    return a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full").na.fill(0, ["a", "b"])


def correlation(both: DataFrame) -> DataFrame:
    """One row: the Pearson correlation of columns a and b, over the rows that have both.

    It is not a number where a or b is the same in all of them (Spark's own ``corr`` divides by zero there), and null without such rows."""
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    a, b = (F.when(known, F.col(c).cast("double")) for c in "ab")
    r = F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    nan = F.lit(float("nan"))
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return both.agg(F.when(F.count(F.when(known, 1)) > 0, F.when(flat, nan).otherwise(F.coalesce(r, nan))).alias("r"))
