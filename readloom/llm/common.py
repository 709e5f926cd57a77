"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: The characters that separate words in every operator of this package.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def give_back() -> None:
    """Return a worker's unused memory to the system.  Workers outlive their tasks, and count while they idle."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def checkpoint_ready(spark: SparkSession) -> None:
    """Use the folder that the cluster names; only a session in one process (tests, local runs) may get its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="readloom-checkpoint-"))


#: Rows of a batch that goes to Python: at Spark's default of 10,000, batches of texts fill an executor's memory.
BATCH_ROWS = 1000


def to_python(df: DataFrame) -> DataFrame:
    """The same rows; where the session has Spark's default, batches that go to Python get fewer rows.

    Spark has this setting for a whole session only and reads it when a plan runs, so it stays; a session that sets
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` itself keeps its own value."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors.

    Spark drops the shuffle files of plans that are over when the driver's JVM collects garbage, which it may
    not do for long; the disk of a long plan would grow with its number of steps."""
    spark = df.sparkSession
    checkpoint_ready(spark)
    out = df.checkpoint()
    gc.collect()
    spark._jvm.System.gc()
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample(df: DataFrame, n: int, *cols: str, id_col: str = "doc_id") -> list[tuple]:
    """At most ``n`` rows (id, *cols), in a fixed order: those of the smallest id hashes, one row per id."""
    return [row[1:] for row in sample_each(df.withColumn("\x00all", F.lit("")), "\x00all", n, *cols, id_col=id_col)]


def sample_each(df: DataFrame, group: str, n: int, *cols: str, id_col: str = "doc_id") -> list[tuple]:
    """At most ``n`` rows (group, id, *cols) of each group, by group, then in a fixed order: those of the smallest id hashes, one row per id.

    The ids are chosen first, so that no partition sends whole texts that are not wanted to the driver; of each
    group, a partition passes on no more than ``n`` ids."""
    ids = df.where(F.col(id_col).isNotNull()).select(group, id_col).distinct()
    by = [F.xxhash64(id_col), F.col(id_col)]
    slices = ids.withColumn("\x00part", F.pmod(by[0], F.lit(64)))
    # a large group is thinned in slices first
    some = slices.withColumn("\x00k", F.row_number().over(Window.partitionBy(group, "\x00part").orderBy(*by))).where(F.col("\x00k") <= n).select(group, id_col)
    chosen = [r[:2] for r in some.withColumn("\x00k", F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col("\x00k") <= n).orderBy(group, "\x00k").collect()]
    if not chosen:
        return []
    # n is a documented parameter, so the ids are few enough for a broadcast
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (group, id_col))
    small = df.sparkSession.createDataFrame(chosen, kinds)
    rows = df.select(group, id_col, *cols).join(F.broadcast(small), [group, id_col]).groupBy(group, id_col).agg(F.min(F.struct(*cols)).alias("r")).collect()
    place = {x: i for i, x in enumerate(chosen)}
    return [(r[0], r[1], *r["r"]) for r in sorted(rows, key=lambda r: place[r[0], r[1]])]
