"""Barcode tables of any size, by joins."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import demux


def by_hand(tag: str | None, codes: list[tuple[str, str]], most: int | None) -> tuple:
    same = [(sum(map(str.__ne__, tag, b)), b, s) for s, b in codes if tag is not None and len(b) == len(tag)]
    d, b, s = min(same, default=(None, None, None))
    return (s, b, d) if d is not None and (most is None or d <= most) else (None, None, None)


@pytest.mark.parametrize("most", [None, 0, 1, 2, 3])
def test_joins_equal_a_search(spark, monkeypatch, most):
    monkeypatch.setattr(demux, "_TAG_BLOCK", 7)
    monkeypatch.setattr(demux, "_CODE_BLOCK", 11)
    r = random.Random(5)
    make = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    codes = [(f"s{i}", make(8)) for i in range(60)] + [("dup", "ACGTACGT"), ("also", "ACGTACGT")] + [(f"t{i}", make(3)) for i in range(5)] + [("one", "A"), ("none", "")]
    tags = [make(8) for _ in range(120)] + [c for _, c in codes[:9]] + [c[:3] + "N" + c[4:] for _, c in codes[:9]] + ["ACGTACGT", "ACGTACGA", "NNNNNNNN", "AC", "T", "", None, "CCC"] + ["ACGTACGT"] * 50
    reads = spark.createDataFrame(list(enumerate(tags)), "ord long, observed string").withColumn("n", F.lit(1)).withColumn("size", F.lit(2))
    got = demux.nearest_of_table(reads, spark.createDataFrame([*codes, ("x", None)], "sample string, barcode string"), F.col("observed"), most)
    assert got.columns == ["ord", "observed", "n", "size", "sample", "barcode", "distance"]
    assert {x["ord"]: (x["sample"], x["barcode"], x["distance"]) for x in got.collect()} == {i: by_hand(t, codes, most) for i, t in enumerate(tags)}


def test_a_table_of_a_million_barcodes(spark):
    """Every text of ten bases, of which a read's first ten have one error or none: all are found without a search."""
    letters = F.concat(*[F.substring(F.lit("ACGT"), (F.floor(F.col("id") / 4**k) % 4 + 1).cast("int"), F.lit(1)) for k in range(10)])
    table = spark.range(4**10).select(F.concat(F.lit("s"), "id").alias("sample"), letters.alias("barcode"))
    reads = spark.range(3000).select(F.col("id").alias("ord"), F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 10), "0123456789abcdef", "ACGTACGTACGTACGN").alias("tag"))
    got = demux.nearest_of_table(reads, table, F.col("tag"), 1).collect()
    assert len(got) == 3000 and all(x["distance"] == x["tag"].count("N") for x in got if x["tag"].count("N") <= 1)
    assert all(x["barcode"] == x["tag"].replace("N", "A") for x in got if x["tag"].count("N") <= 1)


def test_large_lists_and_maps_are_not_refused(spark, monkeypatch):
    monkeypatch.setattr(demux, "MOST_BARCODES", 80)
    codes = [(f"s{k:03}", "".join(t)) for k, t in enumerate(itertools.product("ACGT", repeat=4))]
    reads = spark.createDataFrame([(0, "x_ACGT", "ACGT"), (1, "x_ACGA;y", "ACNT"), (2, "zz", "A")], "ord long, name string, seq string")
    got = {r["ord"]: (r["barcode"], r["distance"]) for r in demux.nearest_barcode(reads, codes, F.col("seq")).collect()}
    assert got == {0: ("ACGT", 0), 1: ("ACAT", 1), 2: (None, None)}
    assert {r["ord"]: r["sample"] for r in demux.exact_prefix(reads, codes).collect()}[0] == next(s for s, b in codes if b == "ACGT")
    named = demux.rename(reads, spark.createDataFrame(codes, "sample string, barcode string")).orderBy("ord").collect()
    assert [r["header"].split(" ", 1)[1] for r in named] == ["x_ACGT orig_bc=ACGT new_bc=ACGT bc_diffs=0", "x_ACGA;y orig_bc=ACGA new_bc=ACGA bc_diffs=0"]
