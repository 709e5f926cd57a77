"""Write reads: FASTQ files per sample, FASTA, tables of figures, and the run's summary."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class ExistsError(ValueError):
    """An output that is there already."""


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def file_name(prefix: str, several_reads: bool) -> Column:
    """Name of an output read's file, from columns outcome, barcode and read_ix.

    ``{p}.fq`` and ``{p}_un.fq``; with barcodes ``{p}_BC_{seq}.fq``; with several reads ``_READ{n}`` before the suffix."""
    middle = F.when(F.col("outcome") != "success", "_un").when(F.col("barcode").isNotNull(), F.concat(F.lit("_BC_"), "barcode")).otherwise("")
    end = F.concat(F.lit("_READ"), F.col("read_ix").cast("string")) if several_reads else F.lit("")
    return F.concat(F.lit(prefix), middle, end, F.lit(".fq"))


def header(show_bases: bool = False) -> Column:
    """Name of an output read, with its UMI and its confidence."""
    umi = F.col("fp_seq") if show_bases else F.col("fp").cast("string")
    return F.concat(F.col("name"), F.when(umi.isNotNull(), F.concat(F.lit(";FP:"), umi)).otherwise(""), F.lit(";RQ:"), F.format_string("%.2f", "q"))


def fastq(name: Column, seq: Column, qual: Column) -> Column:
    """A record of four lines; a missing quality is written as a dot per base."""
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), F.coalesce(qual, F.repeat(F.lit("."), F.length(seq))))


#: Where the parts of files lie until all are written; readers skip such a folder.
_PARTS = "_parts"


def write_samples(output: DataFrame, directory: str, prefix: str, several_reads: bool, show_bases: bool = False, part_records: int | None = None) -> list[str]:
    """Write output reads (see mates.output_reads) to a file per sample and read, in the order of their records; return the files.

    A file is written by one task, or with ``part_records`` is a folder of parts of so many record numbers each, which as many
    tasks write; a folder reads as one file.  The plan is run once.  All parts are written by Spark's writer to a folder
    aside and moved to their names when every task is done, so no byte passes the driver, and a run that fails leaves
    no file.  A folder with files in it is refused."""
    spark = output.sparkSession
    fs, root = _fs(spark, directory)
    if fs.exists(root) and any(not x.getPath().getName().startswith((".", "_")) for x in fs.listStatus(root)):
        raise ExistsError(f"there are files in {directory}, which exists already")
    part = F.lit(0).cast("bigint") if part_records is None else F.floor(F.col("ord") / part_records).cast("bigint")
    rows = output.select(file_name(prefix, several_reads).alias("file"), part.alias("part"), "ord", "read_ix", fastq(header(show_bases), F.col("seq"), F.col("qual")).alias("value"))
    # parts are dealt by name and number: no sampling run of the plan, as ranges would need
    dealt = rows.repartition("file", "part").sortWithinPartitions("file", "part", "ord", "read_ix").select("file", "part", "value")
    dealt.write.mode("overwrite").partitionBy("file", "part").text(f"{directory}/{_PARTS}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    moves, staged = [], path(root, _PARTS)
    for folder in _folders(fs, staged, "file="):
        target = path(root, unquote(folder.getName().removeprefix("file=")))
        for one in _folders(fs, folder, "part="):
            (source,) = [x.getPath() for x in fs.listStatus(one) if x.getPath().getName().startswith("part-")]
            moves.append((source, target if part_records is None else path(target, f"part-{int(one.getName().removeprefix('part=')):010d}{_suffix(source.getName())}"), target))
    for source, to, target in moves:
        if part_records is not None:
            fs.mkdirs(target)
        fs.rename(source, to)
    fs.delete(staged, True)
    return sorted({str(target) for *_, target in moves})


def _folders(fs, folder, start: str) -> list:  # noqa: ANN001
    return sorted((x.getPath() for x in fs.listStatus(folder) if x.isDirectory() and x.getPath().getName().startswith(start)), key=lambda p: p.getName()) if fs.exists(folder) else []


def _suffix(name: str) -> str:
    """The end of a part's name, which tells how it is compressed."""
    return "." + name.split(".", 1)[1] if "." in name else ""


def write_fasta(reads: DataFrame, directory: str, name: str = "header") -> None:
    reads.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), "seq").alias("value")).write.mode("errorifexists").text(directory)


def write_table(df: DataFrame, directory: str) -> None:
    df.write.mode("errorifexists").option("sep", "\t").option("header", True).csv(directory)


def write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    """A small text file, such as a log or a layout."""
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise ExistsError(path)
    sink = fs.create(target, False)
    sink.write(bytearray(("\n".join(lines) + "\n").encode()))
    sink.close()


def write_artifacts(output: DataFrame, directory: str) -> None:
    """Output reads that match a contaminant, with its number in the name."""
    name = F.concat(F.col("name"), F.lit(";ART:"), F.col("contaminant_ix").cast("string"))
    output.where("outcome = 'artifact'").select(fastq(name, F.col("seq"), F.col("qual")).alias("value")).write.mode("errorifexists").text(directory)
