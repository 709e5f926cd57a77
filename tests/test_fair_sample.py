"""Figures of a file from reads all over it, or from its first ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from readloom.operators import choose, stats
from readloom.plans import layout as L
from readloom.plans.model import Options


@pytest.fixture(scope="module")
def by_tile(spark):
    """Reads of a file whose first half has A and C, and whose second half G and T behind a tag."""
    early = F.translate(F.lpad(F.bin(F.xxhash64("id")), 24, "0"), "01", "AC")
    late = F.concat(F.lit("GGTT"), F.translate(F.lpad(F.bin(F.xxhash64("id")), 24, "0"), "01", "GT"))
    return spark.range(20_000).select(F.lit(0).alias("file_ix"), F.col("id").alias("ord"), F.format_string("r%d", "id").alias("name"), F.when(F.col("id") < 8_000, early).otherwise(late).alias("seq"), F.lit(None).cast("string").alias("qual"))


def test_background_is_of_the_whole_file(by_tile):
    whole = stats.sequence_stats(by_tile, None, Options(stats_reads=None))
    fair = stats.sequence_stats(by_tile, None, Options(stats_reads=2_000))
    first = stats.sequence_stats(by_tile, None, Options(stats_reads=2_000, spread=False))
    assert fair.background == pytest.approx(whole.background, abs=0.02) and fair.average_length == pytest.approx(whole.average_length, abs=1)
    assert first.background[2] < 0.001 < 0.2 < whole.background[2]


def test_size_and_nesting(by_tile):
    o = Options()
    big, small = ({r["ord"] for r in stats.sample(by_tile, n, o).collect()} for n in (5_000, 500))
    assert 4_700 < len(big) < 5_300 and 420 < len(small) < 580 and small < big
    assert {r["ord"] for r in stats.sample(by_tile.repartition(7), 500, o, 20_000).collect()} == small
    assert stats.sample(by_tile, 20_000, o).count() == stats.sample(by_tile, None, o).count() == 20_000
    assert stats.sample(by_tile.limit(0), 10, o).count() == 0
    assert [r["ord"] for r in stats.sample(by_tile, 3, Options(spread=False)).orderBy("ord").collect()] == [0, 1, 2]


def test_layout_is_that_of_most_reads(by_tile):
    layouts = [L.parse("R:N"), L.parse("S:GGTT R:N")]
    assert choose.choose(by_tile, layouts, Options(search_reads=1_000, stats_reads=1_000, spread=False))[0] == layouts[0]
    late = by_tile.where("ord >= 500")  # so few of the others that most reads decide
    got, p = choose.choose(late.where("ord < 600 or ord >= 8000"), layouts, Options(search_reads=1_000))
    assert got == layouts[1] and p > 0.99
