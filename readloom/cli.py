"""Command lines: extract, simulate, evaluate, merge, rename."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from .operators import demux, evaluate, mates, pairs, simulate
from .plans import layout as L
from .plans.model import Options
from .plans.run import Run, counted, extract, fit, report
from .sources import reads as R, sinks


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="extract reads by a layout, per sample")
    e.add_argument("files", nargs="+")
    e.add_argument("-o", "--out", required=True)
    e.add_argument("--layout", action="append", default=[], help="words such as 'B:ACGT,TTGA R:N'; one for each file in turn")
    e.add_argument("--layouts", help="a file of candidate layouts")
    e.add_argument("--threshold", type=float)
    e.add_argument("-e", "--error-rate", type=float, default=0.05)
    e.add_argument("-i", "--indels", type=float, default=0.1)
    e.add_argument("--start", type=int)
    e.add_argument("--end", type=int)
    e.add_argument("--min-length", type=int, default=16)
    e.add_argument("--reference")
    e.add_argument("--reference-errors", type=int, default=2)
    e.add_argument("--dust", type=float, default=100.0)
    e.add_argument("--seed", type=int, default=42)
    e.add_argument("--show-umi-bases", action="store_true")
    e.add_argument("--calibration-reads", type=int, default=Options.calibration_reads, help="simulated reads that set the threshold where none is given")
    e.add_argument("--fit-on-first", action="store_true", help="take a file's figures and layout from its first reads, not from reads all over it")
    e.add_argument("--part-records", type=int, help="write each sample as a folder of parts of so many records, by many tasks; otherwise one task writes one file")
    s = sub.add_parser("simulate", help="simulate reads")
    s.add_argument("-o", "--out", required=True)
    s.add_argument("--tags")
    s.add_argument("--barcodes", type=int, default=0)
    s.add_argument("--reads", type=int, default=1000)
    s.add_argument("--random-fraction", type=float, default=0.1)
    s.add_argument("--linker-5", default="")
    s.add_argument("--linker-3", default="")
    s.add_argument("--read-length", type=int, default=20)
    s.add_argument("--read-length-mod", type=int, default=0)
    s.add_argument("--error-rate", type=float, default=0.02)
    s.add_argument("--indels", type=float, default=0.0)
    s.add_argument("--end-loss", type=int, default=0)
    s.add_argument("--seed", type=int, default=42)
    v = sub.add_parser("evaluate", help="hold extracted reads against their truth")
    v.add_argument("files", nargs="+")
    v.add_argument("-o", "--out", required=True)
    v.add_argument("--name", default="readloom")
    v.add_argument("--real-reads", type=int, help="real reads that were simulated; those in no file were missed")
    v.add_argument("--random-reads", type=int, help="random reads that were simulated; those in no file were left out rightly")
    m = sub.add_parser("merge", help="merge pairs by overlap")
    m.add_argument("files", nargs=2)
    m.add_argument("-o", "--out", required=True)
    m.add_argument("--min-length", type=int, default=16)
    m.add_argument("-Q", "--identity", type=float, default=0.0)
    r = sub.add_parser("rename", help="rename demultiplexed reads")
    r.add_argument("files", nargs="+")
    r.add_argument("-o", "--out", required=True)
    r.add_argument("--map", required=True)
    return top


def run_extract(spark: SparkSession, a: argparse.Namespace) -> None:
    o = Options(a.error_rate, a.indels, a.threshold, a.min_length, a.start, a.end, a.dust, a.reference_errors, a.seed, calibration_reads=a.calibration_reads, spread=not a.fit_on_first)
    log, all_reads = Run(), R.read(spark, a.files)
    known = R.read_layouts(spark, a.layouts) if a.layouts else []
    fitted = []
    for ix in range(len(a.files)):
        choices = [L.parse(a.layout[ix])] if ix < len(a.layout) else known or [L.parse("R:N")]
        fitted.append(fit(all_reads.where(F.col("file_ix") == ix), choices, o, log))
    mates.check_counts(all_reads)
    if len(a.files) > 1:
        mates.check_names(all_reads)
    references = R.read_references(spark, a.reference) if a.reference else None
    done, seen = counted(extract(all_reads, fitted, o, references))
    several = sum(f.layout.reads for f in fitted) > 1
    prefix = a.out.rsplit("/", 1)[-1]
    for file in sinks.write_samples(mates.output_reads(done), f"{a.out}_files", prefix, several, a.show_umi_bases, a.part_records):
        log.say(f"wrote {file}")
    report(seen.get, log)  # of the run that wrote the files
    sinks.write_lines(spark, log.messages, f"{a.out}_logfile.txt")


def run_simulate(spark: SparkSession, a: argparse.Namespace) -> None:
    tags = tuple(r["seq"] for r in R.read_tags(spark, a.tags).orderBy("tag_ix").collect()) if a.tags else ()
    p = simulate.Plan(a.reads, a.random_fraction, tags, a.barcodes, a.linker_5, a.linker_3, a.read_length, a.read_length_mod, a.error_rate, a.indels, a.end_loss, a.seed)
    reads = simulate.simulate(spark, p)
    reads.select(sinks.fastq(F.col("name"), F.col("seq"), F.col("qual")).alias("value")).write.mode("errorifexists").text(f"{a.out}.fq")
    for end, lines in (("layout.txt", [simulate.layout_words(p)]), ("splitter.txt", simulate.splitter_tags(p)), ("trimmer.fa", simulate.trimmer_tags(p))):
        sinks.write_lines(spark, lines, f"{a.out}_{end}")


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    reads = R.read(spark, a.files)
    names = F.element_at(F.array(*[F.lit("un" if f.rsplit("/", 1)[-1].rsplit(".", 1)[0].endswith("_un") else f) for f in a.files]), F.col("file_ix") + 1)
    sinks.write_table(evaluate.evaluate(reads.withColumn("file", names), a.name, a.real_reads, a.random_reads).coalesce(1), a.out)


def run_merge(spark: SparkSession, a: argparse.Namespace) -> None:
    both = R.read(spark, a.files)
    mates.check_counts(both)
    mates.check_names(both)
    done = pairs.merge_pairs(both.where("file_ix = 0").drop("file_ix"), both.where("file_ix = 1").drop("file_ix"), a.min_length, a.identity)
    done.select(sinks.fastq(F.col("name"), F.col("seq"), F.col("qual")).alias("value")).write.mode("errorifexists").text(a.out)


def run_rename(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_fasta(demux.rename(R.read(spark, a.files), R.read_sample_map(spark, a.map)), a.out)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"readloom {a.command}").getOrCreate()
    {"extract": run_extract, "simulate": run_simulate, "evaluate": run_evaluate, "merge": run_merge, "rename": run_rename}[a.command](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
