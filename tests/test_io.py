"""Files in and out, the command lines, and the stream."""

from __future__ import annotations

import gzip
import os

import pytest
from pyspark.sql import functions as F

from readloom import cli
from readloom.operators.simulate import Plan, simulate
from readloom.plans import layout as L
from readloom.plans.model import Options, Stats, build
from readloom.plans.run import Fitted
from readloom.sources import reads as R, sinks
from readloom.streaming import label_stream as LS

FASTQ = "".join(f"@r{i} 1:N\nACGTN{'ACGT'[i % 4]}\n+\nIIIII{'I'}\n" for i in range(100))


def test_fastq(spark, tmp_path):
    plain, packed = tmp_path / "a.fq", tmp_path / "a.fastq.gz"
    plain.write_text(FASTQ)
    packed.write_bytes(gzip.compress(FASTQ.encode()))
    want = [(0, i, f"r{i};1:N", f"ACGTN{'ACGT'[i % 4]}", "IIIIII") for i in range(100)]
    for path in (plain, packed):
        assert [tuple(r) for r in R.read(spark, [str(path)]).orderBy("ord").collect()] == want


def test_fastq_in_many_splits(spark, tmp_path):
    path = tmp_path / "a.fq"
    path.write_text(FASTQ)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "257")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = R.read(spark, [str(path)]).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["name"] for r in got] == [f"r{i};1:N" for i in range(100)]


def test_broken_fastq(spark, tmp_path):
    path = tmp_path / "b.fq"
    path.write_text("@a\nACGT\n+\nIII\n@b\nAC\n+\nII\n")
    with pytest.raises(Exception, match="record 0"):
        R.read(spark, [str(path)]).collect()
    assert [r["name"] for r in R.read(spark, [str(path)], strict=False).collect()] == ["b"]
    (tmp_path / "c.fq").write_text("")
    assert R.read(spark, [str(tmp_path / "c.fq")]).count() == 0


def test_fasta_sam_and_lists(spark, tmp_path):
    (tmp_path / "r.fa").write_text("junk\n>a b\nACGT\nttt\n\n>c\n>d\nGG\n")
    assert [(r["ord"], r["name"], r["seq"], r["qual"]) for r in R.read(spark, [str(tmp_path / "r.fa")]).orderBy("ord").collect()] == [(0, "a;b", "ACGTTTT", None), (1, "c", "", None), (2, "d", "GG", None)]
    assert R.read_references(spark, str(tmp_path / "r.fa")).orderBy("ref_ix").first()["name"] == "a_b"
    (tmp_path / "a.sam").write_text("@HD\nr1\t16\tc\t1\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\nr2\t256\tc\t1\t60\t4M\t*\t0\t0\tACGT\tIIII\n")
    (row,) = R.read_sam(spark, str(tmp_path / "a.sam")).collect()
    assert (row["name"], row["seq"], row["flag"], row["mapq"], row["nm"]) == ("r1", "ACGT", 16, 60.0, 1)
    (tmp_path / "t.txt").write_text("[6nt]\nTag1:ACGT\n Tag2:TTGA\n")
    assert [tuple(r) for r in R.read_tags(spark, str(tmp_path / "t.txt")).collect()] == [(0, "Tag1", "ACGT"), (1, "Tag2", "TTGA")]
    (tmp_path / "m.txt").write_text("# s b\ns1 acgt x\n\n")
    assert [tuple(r) for r in R.read_sample_map(spark, str(tmp_path / "m.txt")).collect()] == [("s1", "ACGT")]
    for name in ("x.cram", "x.txt"):
        with pytest.raises(R.FormatError):
            R.kind_of(name)


def test_command_lines(spark, tmp_path):
    out = lambda x: str(tmp_path / x)
    (tmp_path / "tags.txt").write_text("T1:ACAGTG\nT2:TTAGGC\n")
    cli.main(["simulate", "-o", out("sim"), "--tags", out("tags.txt"), "--reads", "200", "--read-length", "24"])
    parts = sorted(f for f in os.listdir(out("sim.fq")) if f.startswith("part-"))
    (tmp_path / "all.fq").write_text("".join((tmp_path / "sim.fq" / f).read_text() for f in parts))
    cli.main(["extract", out("all.fq"), "-o", out("run"), "--layouts", out("sim_layout.txt"), "--threshold", "1.5"])
    files = sorted(f for f in os.listdir(out("run_files")) if f.endswith(".fq"))
    assert files == ["run_BC_ACAGTG.fq", "run_BC_TTAGGC.fq", "run_un.fq"]
    assert sum((tmp_path / "run_files" / f).read_text().count("\n") for f in files) == 800
    assert "200 input reads" in (tmp_path / "run_logfile.txt").read_text()
    cli.main(["evaluate", *[out(f"run_files/{f}") for f in files], "-o", out("ev")])
    assert any(f.startswith("part-") for f in os.listdir(out("ev")))
    with pytest.raises(Exception, match="(?i)exist"):
        cli.main(["extract", out("all.fq"), "-o", out("run"), "--layouts", out("sim_layout.txt"), "--threshold", "1.5"])
    cli.main(["merge", out("all.fq"), out("all.fq"), "-o", out("merged")])
    (tmp_path / "map.txt").write_text("s1 ACAGTG\ns2 TTAGGC\n")
    cli.main(["rename", out("all.fq"), "--map", out("map.txt"), "-o", out("renamed")])


def output(spark, n: int):
    """Output reads of two samples and of none, two reads each."""
    rows = spark.range(n, numPartitions=5).selectExpr("id AS ord", "CASE WHEN id % 5 = 4 THEN 'mismatch' ELSE 'success' END AS outcome", "CASE WHEN id % 5 < 4 THEN element_at(array('AC', 'GT'), int(id % 2 + 1)) END AS barcode")
    reads = rows.withColumn("read_ix", F.explode(F.array(F.lit(1), F.lit(2))))
    return reads.select("*", F.concat(F.lit("r"), "ord").alias("name"), F.repeat(F.lit("ACGT"), F.col("read_ix")).alias("seq"), F.lit(None).cast("string").alias("qual"), F.lit(None).cast("bigint").alias("fp"), F.lit(None).cast("string").alias("fp_seq"), F.lit(1.5).alias("q"))


def lines_of(path) -> list[str]:
    """A file, or the parts of a folder in the order of their names."""
    return [x for p in (sorted(path.glob("part-*")) if path.is_dir() else [path]) for x in p.read_text().splitlines()]


@pytest.mark.parametrize("part_records", [None, 30, 1000])
def test_samples_are_written_in_order_and_without_the_driver(spark, tmp_path, part_records, monkeypatch):
    monkeypatch.setattr(sinks, "write_lines", None)
    files = sinks.write_samples(output(spark, 200), str(tmp_path / "o"), "p=1", True, part_records=part_records)
    names = [f"p=1_{m}_READ{k}.fq" for m in ("BC_AC", "BC_GT", "un") for k in (1, 2)]
    assert [f.rsplit("/", 1)[-1] for f in files] == names and sorted(p.name for p in (tmp_path / "o").iterdir() if p.name[0] not in "._") == names
    for name in names:
        got = lines_of(tmp_path / "o" / name)
        want = [i for i in range(200) if (i % 5 == 4) == ("un" in name) and ("un" in name or i % 2 == ("GT" in name))]
        assert got[::4] == [f"@r{i};RQ:1.50" for i in want] and set(got[1::4]) == {"ACGT" * int(name[-4])}
        if part_records:
            assert len(list((tmp_path / "o" / name).glob("part-*"))) == -(-200 // part_records)
    if part_records:  # a folder reads as one file
        assert R.read(spark, [str(tmp_path / "o" / names[0])]).count() == len(lines_of(tmp_path / "o" / names[0])) // 4
    with pytest.raises(sinks.ExistsError):
        sinks.write_samples(output(spark, 20), str(tmp_path / "o"), "p=1", True)
    assert len(lines_of(tmp_path / "o" / names[0])) == 4 * 80


def test_a_failed_task_leaves_no_file_and_the_next_run_writes_all(spark, tmp_path):
    broken = output(spark, 200).withColumn("seq", F.when(F.col("ord") == 150, F.raise_error(F.lit("lost"))).otherwise(F.col("seq")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_samples(broken, str(tmp_path / "o"), "p", True)
    assert not list(tmp_path.glob("o/*.fq"))
    assert len(sinks.write_samples(output(spark, 200), str(tmp_path / "o"), "p", True)) == 6
    assert not list(tmp_path.glob("o/_parts"))
    assert sinks.write_samples(output(spark, 0), str(tmp_path / "none"), "p", True) == []


def test_figures_come_from_the_run_that_writes(spark, tmp_path):
    """The labels are made once, though they are both written and counted."""
    from readloom.plans.run import counted, totals

    made = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = output(spark, 300)
    labelled = rows.mapInArrow(once, rows.schema)
    done, seen = counted(labelled)
    sinks.write_samples(done, str(tmp_path / "o"), "p", True)
    assert made.value == 600 and seen.get == totals(rows).first().asDict() and seen.get["mismatch"] == 120


def test_lines_are_not_overwritten(spark, tmp_path):
    sinks.write_lines(spark, ["a"], str(tmp_path / "x"))
    with pytest.raises(sinks.ExistsError):
        sinks.write_lines(spark, ["b"], str(tmp_path / "x"))


def test_stream_equals_batch(spark, tmp_path):
    some = simulate(spark, Plan(reads=60, barcodes=("ACAGTG", "TTAGGC"), read_length=24)).repartition(3)
    some.write.parquet(str(tmp_path / "in"))
    layout = L.parse("B:ACAGTG,TTAGGC R:N")
    f = Fitted(layout, build(layout, Stats((0.25, 0.25, 0.25, 0.24, 0.01), 30), Options()), 1.0)
    labelled = LS.label_stream(LS.read_stream(spark, str(tmp_path / "in"), 1), f)
    LS.write_stream(labelled, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    LS.count_stream(labelled, str(tmp_path / "n"), str(tmp_path / "c2")).awaitTermination()
    key = lambda df: sorted((r["ord"], r["outcome"], r["barcode"]) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(LS.label_stream(some, f))
    assert sum(r["n"] for r in spark.read.parquet(str(tmp_path / "n")).collect()) == 60


@pytest.mark.parametrize("most", [R.MOST_BLOCKS, 0])
def test_a_folder_reads_as_one_file_in_the_order_of_its_files(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_BLOCKS", most)
    folder = tmp_path / "all.fastq"
    folder.mkdir()
    for k, name in enumerate(("b.fastq", "a.fastq", "c.fastq")):
        (folder / name).write_text("".join(f"@{name}{i}\nACGT{'ACG'[k] * (i % 5)}\n+\nIIII{'I' * (i % 5)}\n" for i in range(700 if k else 3)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = [(r["ord"], r["name"]) for r in R.read(spark, [str(folder)]).orderBy("ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate([f"a.fastq{i}" for i in range(700)] + [f"b.fastq{i}" for i in range(3)] + [f"c.fastq{i}" for i in range(700)]))
