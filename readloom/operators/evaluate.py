"""Accuracy of extracted reads against the truth in their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.sequence import name_tag

COLUMNS = ("program", "sensitivity", "specificity", "precision", "kappa", "avg_error", "tp", "fp", "fn", "tn", "missed", "sensitivity_all")


def with_truth(reads: DataFrame) -> DataFrame:
    """Add payload_true and library (0: a random read) from the names of reads (file, name, seq)."""
    true = name_tag(F.col("name"), "SEQ")
    return reads.withColumns({"payload_true": F.when(true != "NONE", true), "library": name_tag(F.col("name"), "BARNUM").cast("int")})


def _homes(cells: DataFrame) -> DataFrame:
    """Add home to rows (library, file, n): whether this file holds most of its library, the first on ties."""
    able = F.coalesce((F.col("library") > 0) & (F.col("file") != "un"), F.lit(False))
    best = Window.partitionBy("library", able).orderBy(F.desc("n"), "file")
    return cells.withColumn("home", able & (F.row_number().over(best) == 1))


def evaluate(extracted: DataFrame, program: str = "readloom", expected_real: int | None = None, expected_random: int | None = None) -> DataFrame:
    """One row of COLUMNS over reads (file, name, seq); the file ``un`` holds what was not extracted.

    A read that was extracted into its library's file is a true positive; any other real read in a file, ``un``
    included, is a false one, and so is an extracted random read.  Random reads left out are true negatives.  Reads in
    no file are known only where the numbers of simulated reads are given: the real ones are false negatives, the random
    ones true negatives, so that all add up to the reads simulated.  ``missed`` are the real reads that were not
    extracted, in ``un`` or in no file, and ``sensitivity_all`` counts them as lost.

    The reads, which may cost much to label, are gone over once: everything follows from the figures of each library in each file."""
    real, out = F.col("library") > 0, F.col("file") != "un"
    longest = F.greatest(F.length("seq"), F.length("payload_true"))
    error = F.when(real & out, F.when(longest == 0, 0.0).otherwise(F.levenshtein("seq", "payload_true") / longest))
    cells = with_truth(extracted).groupBy("library", "file").agg(F.count("*").alias("n"), F.sum(error).alias("error"), F.count(error).alias("errors"))
    judged, hit = _homes(cells), F.col("home")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0)).cast("double")
    absent = lambda expected, seen: F.lit(0.0) if expected is None else F.greatest(F.lit(float(expected)) - n(seen), F.lit(0.0))
    lost = absent(expected_real, real)
    mean = F.sum(F.when(hit, F.col("error"))) / F.nullif(F.sum(F.when(hit, F.col("errors"))), F.lit(0))
    sums = judged.agg(n(hit).alias("tp"), n((out | real) & ~hit).alias("fp"), lost.alias("fn"), (n(~real & ~out) + absent(expected_random, ~real)).alias("tn"), mean.alias("avg_error"), (n(real & ~out) + lost).alias("missed"))
    whole = F.when(F.col("tp") + F.col("missed") > 0, F.col("tp") / (F.col("tp") + F.col("missed")))
    return sums.select(F.lit(program).alias("program"), *measures(), F.col("avg_error"), *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn", "missed")], whole.alias("sensitivity_all"))


def measures() -> list:
    """Sensitivity, specificity, precision and kappa of columns tp, fp, fn, tn (doubles)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    agree = (tp + tn) / total
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (total * total)
    safe = lambda a, b: F.when(b != 0, a / b)
    return [safe(tp, tp + fn).alias("sensitivity"), safe(tn, tn + fp).alias("specificity"), safe(tp, tp + fp).alias("precision"), safe(agree - chance, 1 - chance).alias("kappa")]
