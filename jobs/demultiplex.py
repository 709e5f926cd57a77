"""Take in reads as files of them arrive, and deal them to samples.

A file stream takes what is new since its checkpoint.  Each row of the table gives one or more records (``records``),
each record a read (``seq``); a read goes to the sample whose barcode its first bases are nearest to, loses its barcode, and
gets an outcome: ``barcode_missing`` with too many differing bases or fewer bases than a barcode has, ``too_short``, ``low_complexity``, or ``success``.

    <output>/reads/batch=N/lane=L/sample=S    id, record, outcome, payload
    <output>/counts/batch=N                   lane, sample, outcome, reads

A micro-batch overwrites only its own partitions, so one that is repeated after a failure replaces what it left.  Nothing is
written when nothing is new.  Rows of one lane and sample are spread over tasks by their size (rebalanced), so that
a large lane is written by many and small ones make few files.

    python -m jobs.demultiplex --input TABLE --output FOLDER --checkpoint FOLDER [--config FILE]
"""

from __future__ import annotations

import argparse
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from readloom.functions import sequence as S
from readloom.operators.demux import nearest_barcode
from readloom.operators.filters import summary

from .common import existing, logger, read_config

NAME = "demultiplex"
READS = "id bigint, record int, outcome string, payload string, batch bigint, lane string, sample string"
COUNTS = "lane string, sample string, outcome string, n bigint, batch bigint"
#: Reads without a sample.
UNKNOWN = "undetermined"


def records(rows: DataFrame, conf: dict) -> DataFrame:
    """(id, record, lane, seq) of a table's rows."""
    lines = rows.where(conf["where"]).selectExpr(f"CAST({conf['id']} AS bigint) AS id", f"{conf['lane']} AS lane", conf["records"])
    return lines.where(conf["keep"]).selectExpr("id", "CAST(record AS int) AS record", "lane", f"{conf['seq']} AS seq")


def dealt(reads: DataFrame, conf: dict) -> DataFrame:
    """(id, record, lane, sample, outcome, payload); every read has one row."""
    codes = [(s, b) for s, b in conf["barcodes"].items()]
    sizes = {len(b) for _, b in codes}
    if len(sizes) != 1:
        raise ValueError("barcodes must be of one length")
    size = sizes.pop()
    found = nearest_barcode(reads, codes, F.substring("seq", 1, size), conf["most_errors"])
    payload = F.when(F.col("sample").isNull(), F.col("seq")).otherwise(F.substring("seq", size + 1, 1 << 30))
    found = found.withColumn("payload", payload)
    outcome = (
        F.when(F.col("sample").isNull(), "barcode_missing")
        .when(F.length("payload") < conf["min_length"], "too_short")
        .when(S.dust_score(F.col("payload")) > conf["dust"], "low_complexity")
        .otherwise("success")
    )
    return found.select("id", "record", outcome.alias("outcome"), "payload", "lane", F.coalesce("sample", F.lit(UNKNOWN)).alias("sample"))


def watched(spark: SparkSession, table: str) -> str:
    """What a file stream takes for a table: a folder as it is; a single file, which it refuses, as a pattern that only that file fits."""
    table = table.rstrip("/")
    files = spark.read.parquet(table).inputFiles()
    single = len(files) == 1 and unquote(files[0]).rsplit("/", 1)[-1] == table.rsplit("/", 1)[-1]
    return f"{table[:-1]}[{table[-1]}]" if single else table


def tally(spark: SparkSession, part: str, counts: str) -> int:
    """Count a batch's reads as they were written (only two partition columns and the outcome are read); return how many they are."""
    kind = ", ".join(c for c in READS.split(", ") if not c.startswith("batch"))
    some = existing(spark, part, kind).groupBy("lane", "sample", "outcome").agg(F.count("*").alias("n"))
    some.coalesce(1).write.mode("overwrite").parquet(counts)
    return spark.read.parquet(counts).agg(F.sum("n")).first()[0] or 0


def run(spark: SparkSession, table: str, output: str, checkpoint: str, conf: dict) -> dict[str, int]:
    """Take in all files that are new; return how many batches, rows read and reads written there were this time."""
    log, done = logger(NAME), {"batches": 0, "rows": 0, "reads": 0}
    schema = spark.read.parquet(table).schema
    incoming = spark.readStream.schema(schema).option("maxFilesPerTrigger", conf["files_per_batch"]).parquet(watched(spark, table))

    def store(batch: DataFrame, number: int) -> None:
        part = f"{output}/reads/batch={number}"
        dealt(records(batch, conf), conf).hint("rebalance", "lane", "sample").write.mode("overwrite").partitionBy("lane", "sample").parquet(part)
        n = tally(batch.sparkSession, part, f"{output}/counts/batch={number}")
        done["batches"] += 1
        done["reads"] += n
        log.info("batch %d: wrote %d reads to %s", number, n, part)

    log.info("reading %s from checkpoint %s", table, checkpoint)
    query = incoming.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done["rows"] = sum(p.numInputRows for p in query.recentProgress)
    log.info("read %d new rows in %d batches, wrote %d reads", done["rows"], done["batches"], done["reads"])
    for r in report(spark, output).orderBy("outcome").collect():
        log.info("%s: %d reads so far (%.1f%%)", r["outcome"], r["n"], r["percent"])
    return done


def reads_of(spark: SparkSession, output: str) -> DataFrame:
    """All reads that were written so far."""
    return existing(spark, f"{output}/reads", READS).select("id", "record", "lane", "sample", "outcome", "payload")


def report(spark: SparkSession, output: str) -> DataFrame:
    """(outcome, n, percent) over all batches, from their counts."""
    counts = existing(spark, f"{output}/counts", COUNTS)
    return summary(counts.withColumn("contaminant_ix", F.lit(None).cast("int")), F.sum("n")).select("outcome", "n", "percent")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.demultiplex", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("input", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="a JSON file with the settings that differ from those beside the job")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("demultiplex").getOrCreate()
    try:
        run(spark, a.input, a.output, a.checkpoint, read_config(spark, a.config, NAME))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
