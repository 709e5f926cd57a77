"""Reads and mates as streams, against the batch run."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.operators.simulate import Plan, simulate
from readloom.plans import layout as L
from readloom.plans.model import Options, Stats, build
from readloom.plans.run import Fitted, extract, totals
from readloom.streaming import label_stream as LS

STATS = Stats((0.25, 0.25, 0.25, 0.24, 0.01), 30)


def fitted(words: str, threshold: float) -> Fitted:
    layout = L.parse(words)
    return Fitted(layout, build(layout, STATS, Options()), threshold)


def rows(df) -> list:
    return sorted((r["ord"], r["outcome"], r["barcode"], [tuple(f) for f in r["files"]]) for r in df.collect())


def test_reads_and_counts_come_from_one_pass(spark, tmp_path):
    some = simulate(spark, Plan(reads=80, barcodes=("ACAGTG", "TTAGGC"), read_length=24))
    some.repartition(3).write.parquet(f"{tmp_path}/in")
    f, made = fitted("B:ACAGTG,TTAGGC R:N", 1.0), spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    labelled = LS.label_stream(LS.read_stream(spark, f"{tmp_path}/in", 1), f)
    for _ in range(2):  # the second time nothing is new
        LS.write_counted(labelled.mapInArrow(once, labelled.schema), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/reads")
    key = lambda df: sorted((r["ord"], r["outcome"], r["barcode"]) for r in df.collect())
    assert key(got) == key(LS.label_stream(some, f)) and made.value == 80
    counts = spark.read.parquet(f"{tmp_path}/out/counts")
    assert counts.select("batch").distinct().count() == 3
    want = totals(got).first().asDict()
    assert {k: counts.agg(F.sum(k)).first()[0] for k in want} == want


def test_mates_of_two_streams_equal_the_batch_run(spark, tmp_path):
    """Mates come in other orders, files and runs; the stream is started again from its checkpoint."""
    left = simulate(spark, Plan(reads=60, barcodes=("ACAGTG", "TTAGGC"), read_length=24, error_rate=0.05))
    right = simulate(spark, Plan(reads=60, read_length=30, seed=7)).withColumn("file_ix", F.lit(1))
    files = [fitted("B:ACAGTG,TTAGGC R:N", 1.0), fitted("R:N", 0.0)]
    want = extract(left.unionByName(right), files)

    def run() -> None:
        streams = [LS.label_stream(LS.read_stream(spark, f"{tmp_path}/{k}", 1), f) for k, f in enumerate(files)]
        LS.write_counted(LS.paired(streams[0].unionByName(streams[1]), 2), f"{tmp_path}/out", f"{tmp_path}/c", combine=True).awaitTermination()

    def done() -> list:
        return rows(spark.read.parquet(f"{tmp_path}/out/reads"))

    def add(part, k: int) -> None:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{k}")

    add(left.where("ord < 40"), 0)
    add(right.where("ord >= 50"), 1)
    run()
    assert done() == []
    add(right.where("ord < 20"), 1)
    run()
    assert done() == rows(want.where("ord < 20"))
    add(right.where("ord >= 20 AND ord < 50"), 1)
    add(left.where("ord >= 40"), 0)
    run()
    run()
    assert done() == rows(want)
    counts = spark.read.parquet(f"{tmp_path}/out/counts")
    total = totals(want).first().asDict()
    assert {k: counts.agg(F.sum(k)).first()[0] for k in total} == total
