"""Count molecules per sample and chromosome, and keep the counts up to date as reads of later days come in.

Reads are counted once per molecule (UMI, chromosome, place), since copies of one molecule are an artifact of
amplification.  Only rows dated after the mark are read; the mark is the last day that the increments hold.

    <output>/increments/upto=D/sample=S    fp, chrom, pos, n: the molecules of the days up to D that were new then
    <output>/counts/sample=S               chrom, with_umi, without_umi, duplication, upto

An increment is written under its last day, in one overwriting write, and then the counts of the samples whose counts are older
than their increments are made anew from their increments alone.  A run that fails in between leaves counts that
are older; the next run mends them.  So a rerun gives the same, and no read counts twice.  Days must be complete when
they are read.  Rows without a date are left out and their number is logged; so are reads whose UMI does not fit the pattern.

    python -m jobs.molecules --input TABLE --output FOLDER [--config FILE]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from readloom.functions import sequence as S
from readloom.operators import umi

from .common import existing, logger, read_config

NAME = "molecules"
INCREMENTS = "fp bigint, chrom string, pos bigint, n bigint, upto date, sample string"
COUNTS = "chrom string, with_umi bigint, without_umi bigint, duplication double, upto date, sample string"


def placed(rows: DataFrame, conf: dict) -> DataFrame:
    """(sample, fp, chrom, pos) of rows whose UMI fits the pattern."""
    reads = rows.selectExpr(f"{conf['sample']} AS sample", f"{conf['umi']} AS bases", f"{conf['chrom']} AS chrom", f"CAST({conf['pos']} AS bigint) AS pos")
    return reads.where(F.col("bases").rlike(conf["umi_pattern"])).select("sample", S.umi_key(F.col("bases")).alias("fp"), "chrom", "pos")


def take_in(spark: SparkSession, table: str, output: str, conf: dict) -> dict[str, object]:
    """Write the molecules of the days after the mark as one increment."""
    log, date = logger(NAME), F.col(conf["date"]).cast("date")
    mark = existing(spark, f"{output}/increments", INCREMENTS).agg(F.max("upto")).first()[0]
    rows = spark.read.parquet(table)
    # compared with the column as it is, so that the scan can skip what is older
    new = rows.where(F.col(conf["date"]).isNotNull()) if mark is None else rows.where(F.col(conf["date"]) >= F.date_add(F.lit(mark), 1).cast(rows.schema[conf["date"]].dataType))
    high, n = new.agg(F.max(date), F.count("*")).first()
    without = rows.where(F.col(conf["date"]).isNull()).count()
    log.info("%s: %d rows after %s, up to %s; %d rows without a date", table, n, mark, high, without)
    if not n:
        return {"rows": 0, "reads": 0, "upto": mark}
    some = placed(new.where(date <= F.lit(high)), conf)
    found = some.groupBy("sample", "fp", "chrom", "pos").agg(F.count("*").alias("n"))
    part = f"{output}/increments/upto={high}"
    found.hint("rebalance", "sample").select("fp", "chrom", "pos", "n", "sample").write.mode("overwrite").partitionBy("sample").parquet(part)
    kind = "fp bigint, chrom string, pos bigint, n bigint, sample string"
    reads = spark.read.schema(kind).parquet(part).agg(F.sum("n")).first()[0] or 0 if some.limit(1).count() else 0
    log.info("wrote the molecules of %d reads to %s", reads, part)
    return {"rows": n, "reads": reads, "upto": high}


def bring_up(spark: SparkSession, output: str) -> list[str]:
    """Make the counts of samples anew where increments are later than they are; return which."""
    log = logger(NAME)
    increments = existing(spark, f"{output}/increments", INCREMENTS)
    now = increments.groupBy("sample").agg(F.max("upto").alias("now"))
    had = existing(spark, f"{output}/counts", COUNTS).groupBy("sample").agg(F.max("upto").alias("had"))
    old = now.join(had, "sample", "left").where("had IS NULL OR had < now").select("sample", "now")
    late = {r["sample"]: r["now"] for r in old.collect()}  # one short row for each sample
    names = sorted(late)
    if names:
        molecules = increments.where(F.col("sample").isin(names)).groupBy("sample", "fp", "chrom", "pos").agg(F.sum("n").alias("n"))
        counts = umi.per_chrom(molecules, "sample").withColumn("duplication", F.round(1 - F.col("with_umi") / F.col("without_umi"), 9))
        marks = spark.createDataFrame(list(late.items()), "sample string, upto date")
        out = counts.join(F.broadcast(marks), "sample").select("chrom", "with_umi", "without_umi", "duplication", "upto", "sample")
        # only the partitions of these samples are replaced
        out.repartition("sample").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample").parquet(f"{output}/counts")
    log.info("counted anew: %s", ", ".join(names) or "nothing")
    return names


def run(spark: SparkSession, table: str, output: str, conf: dict) -> dict[str, object]:
    """Take in what is new and bring the counts up to it; return what was read and written this time."""
    done = take_in(spark, table, output, conf)
    return done | {"samples": bring_up(spark, output)}


def counts_of(spark: SparkSession, output: str) -> DataFrame:
    """The counts as they stand."""
    return existing(spark, f"{output}/counts", COUNTS).select("sample", "chrom", "with_umi", "without_umi", "duplication")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.molecules", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("input", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="a JSON file with the settings that differ from those beside the job")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("molecules").getOrCreate()
    try:
        run(spark, a.input, a.output, read_config(spark, a.config, NAME))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
