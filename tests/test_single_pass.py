"""Figures that follow from few rows: the correlation without spread, and the evaluation from one pass over the reads."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from readloom.operators import evaluate, umi


@pytest.mark.parametrize("rows", [[(1, 1), (1, 2)], [(3, 7)], [(0.1, 1)] * 7, [(None, 1), (2, 3)], [(1, 1), (2, 5), (2, None), (4, 6)], [(None, 1)], []])
def test_correlation_equals_sql(spark, rows):
    got = umi.correlation(spark.createDataFrame([tuple(None if x is None else float(x) for x in r) for r in rows], "a double, b double")).first()["r"]
    values = ", ".join(f"({'NULL' if a is None else a}::DOUBLE, {'NULL' if b is None else b}::DOUBLE)" for a, b in rows) or "(NULL::DOUBLE, NULL::DOUBLE)"
    want = duckdb.sql(f"SELECT corr(a, b) FROM (VALUES {values}) AS t(a, b)").fetchall()[0][0]
    assert (got is None) == (want is None) and (got is None or math.isnan(got) == math.isnan(want) and (math.isnan(got) or got == pytest.approx(want)))


def test_evaluation_goes_over_the_reads_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(x):
        seen.add(1)
        return x

    names = ["x;SEQ:ACGT;RBC:z;BARNUM:1", "x;SEQ:ACGT;RBC:z;BARNUM:1", "x;SEQ:;RBC:z;BARNUM:2", "x;SEQ:NONE;RBC:NONE;BARNUM:0"]
    rows = spark.createDataFrame([(f, n, s) for f, n, s in zip(["f1", "f1", "un", "un"], names, ["ACGT", "ACG", "", "A"], strict=True)], "file string, name string, seq string")
    got = evaluate.evaluate(rows.withColumn("name", noted("name"))).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"], got["missed"], got["avg_error"]) == (2, 1, 0, 1, 1, 0.125)
    assert seen.value == 4
