"""What the jobs share: their configuration, log and the reading of what may not be there yet."""

from __future__ import annotations

import json
import logging
import sys
import time
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def logger(name: str) -> logging.Logger:
    """A log that says when; it goes to standard error where nothing else is set up."""
    out = logging.getLogger(f"jobs.{name}")
    if not out.handlers and not logging.getLogger().handlers:
        handler, style = logging.StreamHandler(sys.stderr), logging.Formatter("[%(asctime)s] %(name)s: %(message)s", "%Y-%m-%d %H:%M:%S")
        style.converter = time.gmtime
        handler.setFormatter(style)
        out.addHandler(handler)
        out.setLevel(logging.INFO)
    return out


def default_config(name: str) -> dict:
    """The configuration that lies beside the job."""
    return json.loads((Path(__file__).parent / f"{name}.json").read_text())


def read_config(spark: SparkSession, path: str | None, name: str) -> dict:
    """A configuration from any path that Spark reads; without one, that beside the job.  What it leaves out stays as there."""
    return default_config(name) | (json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {})


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a Parquet folder, or none if there is no such folder yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
