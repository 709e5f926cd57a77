"""Read files as DataFrames: (file_ix, ord, name, seq, qual), from FASTQ, FASTA, SAM and BAM.

The files are split by Spark's text reader, so any file system and any codec that Spark knows works, and
plain files are read in parallel.  Records have several lines: every line gets a number that follows the
file's order, from counts per block, and no task holds a whole file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.demux import numbered
from .bam import read_bam

#: Kinds by the end of the name; a compression suffix is taken off first.  Fixed values.
KINDS = {".fa": "fasta", ".fasta": "fasta", ".fq": "fastq", ".fastq": "fastq", ".fastaq": "fastq", ".sam": "sam", ".bam": "bam"}
CODECS = (".gz", ".bz2")
SCHEMA = "file_ix int, ord bigint, name string, seq string, qual string"


class FormatError(ValueError):
    """A file that is not what its name says."""


def kind_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    for codec in CODECS:
        name = name.removesuffix(codec)
    for end, kind in KINDS.items():
        if name.endswith(end):
            return kind
    raise FormatError(f"{path}: not a FASTQ, FASTA, SAM or BAM file by its name")


#: Blocks of files whose first numbers are sent to every task; beyond, lines are shuffled to them.
MOST_BLOCKS = 100_000


def _blocks(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(n, value, first, last): the lines of a file in order within each block, their numbers from 0, and the block's first and last number.

    A folder or pattern reads as one file: its files in the order of their paths.  And whether the lines come in order."""
    files = spark.read.text(path)
    few = files.rdd.getNumPartitions() + len(files.inputFiles()) <= MOST_BLOCKS  # no file has more blocks than that
    lines = files.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("c"), F.min("id").alias("low"))
    # one row per block within a file, and one per file
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.groupBy("file").agg(F.sum("c").alias("c")).select("file", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    begun = counts.withColumn("at", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(offsets, "file")
    start = begun.select("file", "block", "low", (F.col("before") + F.col("at")).alias("first"), (F.col("before") + F.col("at") + F.col("c") - 1).alias("last"))
    joined = lines.join(F.broadcast(start) if few else start.hint("merge"), ["file", "block"])
    return joined.select((F.col("first") + F.col("id") - F.col("low")).alias("n"), "value", "first", "last"), few


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of a file with their numbers from 0.

    Lines come in order within each block of the file; counting the blocks once gives each its first number."""
    return _blocks(spark, path)[0].select("n", "value")


def clean_name(name: Column) -> Column:
    """A record's name without its mark; blanks become semicolons."""
    return F.regexp_replace(F.regexp_replace(name, "^[@>]", ""), "[ \t]", ";")


_RECORD = "ord bigint, l0 string, l1 string, l2 string, l3 string"


def _fours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each four lines (n, value), which come in order, as one record."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        whole = len(rows) // 4 * 4
        rest = rows.slice(whole)
        if whole:
            value = rows.column("value").combine_chunks()
            at = [np.arange(k, whole, 4) for k in range(4)]
            number = rows.column("n").to_numpy()[at[0]] // 4
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), *(value.take(pa.array(a)).cast(pa.string()) for a in at)], ["ord", "l0", "l1", "l2", "l3"])


def fastq_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, l0, l1, l2, l3): the lines of each record.

    Records that lie within a block of the file are put together where they are read; only the lines of records
    across two blocks are shuffled."""
    lines, ordered = _blocks(spark, path)
    lines = lines.withColumn("ord", F.floor(F.col("n") / 4).cast("bigint"))
    inside = F.lit(ordered) & (F.col("ord") * 4 >= F.col("first")) & (F.col("ord") * 4 + 3 <= F.col("last"))
    whole = lines.where(inside).select("n", "value").mapInArrow(_fours, _RECORD)
    across = lines.where(~inside).groupBy("ord").agg(*[F.max(F.when(F.col("n") % 4 == k, F.col("value"))).alias(f"l{k}") for k in range(4)])
    return whole.unionAll(across)


def read_fastq(spark: SparkSession, path: str, file_ix: int = 0, strict: bool = True) -> DataFrame:
    """Records of four lines.  A record that is none raises in strict mode, and is left out otherwise."""
    record = fastq_lines(spark, path).select("ord", *[F.rtrim(f"l{k}").alias(f"l{k}") for k in range(4)])
    good = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3"))
    out = record.where(~((F.coalesce(F.col("l0"), F.lit("")) == "") & F.col("l1").isNull()))
    if strict:
        message = F.concat(F.lit(f"{path}: record "), F.col("ord"), F.lit(" is broken, or its quality is not as long as its sequence"))
        out = out.withColumn("l0", F.when(F.coalesce(good, F.lit(False)), F.col("l0")).otherwise(F.raise_error(message)))
    else:
        out = out.where(good)
    return out.select(F.lit(file_ix).alias("file_ix"), "ord", clean_name(F.col("l0")).alias("name"), F.upper("l1").alias("seq"), F.col("l3").alias("qual"))


def read_fasta(spark: SparkSession, path: str, file_ix: int = 0) -> DataFrame:
    """Records of a header and any number of sequence lines; no quality."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    heads = lines.withColumn("block", F.floor(F.col("n") / (1 << 16)).cast("bigint")).withColumn("head", F.when(F.col("value").startswith(">"), F.col("n")))
    # the last header before each line: within its block of lines, else that of the blocks before
    inside = Window.partitionBy("block").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = heads.groupBy("block").agg(F.max("head").alias("last"), F.count("head").alias("heads"))
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("block", F.max("last").over(over).alias("open"), F.coalesce(F.sum("heads").over(over), F.lit(0)).alias("before"))
    tagged = heads.withColumn("mine", F.max("head").over(inside)).withColumn("count", F.count("head").over(inside)).join(carried, "block")
    rows = tagged.select((F.col("before") + F.col("count") - 1).alias("ord"), "n", "value").where("ord >= 0")
    pieces = F.sort_array(F.collect_list(F.when(~F.col("value").startswith(">"), F.struct("n", F.trim("value").alias("s")))))
    record = rows.groupBy("ord").agg(F.max(F.when(F.col("value").startswith(">"), F.col("value"))).alias("head"), pieces.alias("lines"))
    return record.select(F.lit(file_ix).alias("file_ix"), "ord", clean_name(F.rtrim("head")).alias("name"), F.upper(F.array_join(F.transform("lines", lambda x: x["s"]), "")).alias("seq"), F.lit(None).cast("string").alias("qual"))


def read_sam(spark: SparkSession, path: str, file_ix: int = 0, without_flags: int = 768) -> DataFrame:
    """Alignment records with none of the flags; adds flag, mapq and nm.  Sequences stay as the file has them."""
    rows = numbered_lines(spark, path).where(~F.col("value").startswith("@") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    nm = F.nullif(F.regexp_extract("value", r"\tNM:i:(\d+)", 1), F.lit("")).cast("int")
    kept = rows.where(F.size(f) >= 11).where(f[1].cast("int").bitwiseAND(F.lit(without_flags)) == 0)
    kept = numbered(kept.withColumn("all", F.lit(0)), "all", "n")
    star = lambda c: F.when(c != "*", c)
    return kept.select(F.lit(file_ix).alias("file_ix"), (F.col("number") - 1).alias("ord"), F.regexp_replace(f[0], "[ ]", ";").alias("name"), F.upper(star(f[9])).alias("seq"), star(f[10]).alias("qual"), f[1].cast("int").alias("flag"), f[4].cast("double").alias("mapq"), nm.alias("nm"))


def read(spark: SparkSession, paths: list[str], strict: bool = True) -> DataFrame:
    """All files, numbered in the order given."""
    out = None
    for ix, path in enumerate(paths):
        kind = kind_of(path)
        part = read_fastq(spark, path, ix, strict) if kind == "fastq" else read_fasta(spark, path, ix) if kind == "fasta" else (read_bam if kind == "bam" else read_sam)(spark, path, ix).select("file_ix", "ord", "name", "seq", "qual")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FormatError("no files")
    return out


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(ref_ix, name, seq) of a contaminant FASTA; blanks in names become underscores."""
    return read_fasta(spark, path).select(F.col("ord").cast("int").alias("ref_ix"), F.translate("name", ";", "_").alias("name"), "seq")


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(tag_ix, name, seq) of lines ``name:SEQ``; other lines are headings."""
    rows = numbered_lines(spark, path).withColumn("m", F.regexp_extract("value", r"^\s*([^:\s]+):([ACGTUNacgtun]+)\s*$", 2)).where("m <> ''")
    # a tag list is a configuration file of a few hundred lines
    return rows.select((F.row_number().over(Window.orderBy("n")) - 1).alias("tag_ix"), F.regexp_extract("value", r"^\s*([^:\s]+):", 1).alias("name"), F.upper("m").alias("seq"))


def read_sample_map(spark: SparkSession, path: str) -> DataFrame:
    """(sample, barcode): the first two words of each line that is no comment."""
    words = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(~F.trim("value").startswith("#")).where(F.size(words) >= 2).select(words[0].alias("sample"), F.upper(words[1]).alias("barcode"))


def read_layouts(spark: SparkSession, path: str) -> list:
    """The layouts of a file, in its order."""
    from ..plans.layout import parse_file

    return parse_file([r["value"] for r in numbered_lines(spark, path).orderBy("n").collect()])
