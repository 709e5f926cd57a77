"""Joins of the many rows that come of a small file do not go through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom import queries as Q
from readloom.operators import demux


def test_no_table_is_sent_to_all(spark, data, monkeypatch):
    plans, plain = [], demux.cut
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(demux, "cut", lambda df: plain(seen(df)))
    r = Q.reads(spark, data)
    codes = spark.read.parquet(f"{data}/customer.parquet").selectExpr("cast(c_custkey as string) AS sample", "translate(substr(md5(cast(c_custkey as string)), 1, 8), '0123456789abcdef', 'ACGTACGTACGTACGT') AS barcode")
    seen(demux.least_distances(r, "o_custkey", F.substring("seq", 1, 6)))
    seen(demux.nearest_of_table(r, codes, F.substring("seq", 1, 8), 1))
    assert len(plans) > 6 and not [p for p in plans if "Broadcast" in p]


def test_the_nearest_barcode_is_found_once_for_all_fields(spark, data):
    found = demux.nearest_barcode(Q.reads(spark, data), Q.BARCODES, F.substring("seq", 1, 6)).where("sample is not null and distance < 4")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min") == 1
