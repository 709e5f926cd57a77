"""Functions that need a kernel, callable from SQL: vectorised, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession, functions as F

from ..plans import kernel
from ..plans.model import Model

LABEL = "q double, log_model double, log_random double, labels array<int>"


def register_edit_search(spark: SparkSession) -> None:
    """``edit_search(pattern, text)``: least edit distance of the pattern to any part of the text;
    ``edit_search_end``: to a part that ends with it."""

    def make(to_end: bool):  # noqa: ANN202
        @F.pandas_udf("int")
        def search(pattern: pd.Series, text: pd.Series) -> pd.Series:
            known = pattern.notna() & text.notna()
            out = pd.Series(pd.NA, index=pattern.index, dtype="Int32")
            out[known] = kernel.search_pairs(pattern[known].tolist(), text[known].tolist(), to_end)
            return out

        return search

    spark.udf.register("edit_search", make(False))
    spark.udf.register("edit_search_end", make(True))


def register_label(spark: SparkSession, m: Model, name: str = "label_read") -> None:
    """``label_read(seq)``: confidence, log-likelihoods and labels under one model."""
    shared = spark.sparkContext.broadcast(m)

    @F.pandas_udf(LABEL)
    def label(seq: pd.Series) -> pd.DataFrame:
        got = kernel.label(shared.value, [s or "" for s in seq])
        return pd.DataFrame({"q": got.q, "log_model": got.log_model, "log_random": got.log_random, "labels": [x.tolist() for x in got.labels]})

    spark.udf.register(name, label)
