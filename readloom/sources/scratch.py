"""A place for intermediate tables that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that the session names; only a session in one process (tests, local runs) may get its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="readloom-")


def scratch(spark: SparkSession) -> str:
    """A new folder."""
    return f"{shared(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once (a reliable checkpoint, which outlives lost executors)."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()
