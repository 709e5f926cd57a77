"""Operators over all rows, not a part of them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from readloom.operators import choose, demux


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_barcode_distance_by_brute_force(spark):
    r = random.Random(4)
    rows = [(r.choice((1, 2, 3, 4, 5, 6)), i, "".join(r.choice("ACGT") for _ in range(8))) for i in range(24)]
    rows += [(7, 100, "ACGTACGG"), (8, 101, "ACGTACGG"), (8, 102, "ACGTACTT"), (None, 103, "ACGTAC"), (None, 104, "ACGTAC")]
    rows += [(9, 1000 + i, "".join(r.choice("ACGT") for _ in range(8))) for i in range(5000)]
    want = {}
    for n, (c, _, s) in enumerate(rows):
        for d, _, t in rows[:n] if c != 9 else ():
            if c is not None and c == d:
                want[c] = min(want.get(c, 99), levenshtein(s[:6], t[:6]))
    want[9] = 0  # more reads than barcodes
    got = demux.least_distances(spark.createDataFrame(rows, "o_custkey long, ord long, seq string"), "o_custkey", F.substring("seq", 1, 6))
    assert {x["o_custkey"]: x["least"] for x in got.collect()} == want and got.count() == len(want)


def test_tags_of_all_distances(spark):
    r = random.Random(11)
    rows, n = [], 0
    for c in range(60):  # groups whose tags are far apart, with a pair at a known number of edits in most
        tags = ["".join(r.choice("ACGTN") for _ in range(r.choice((0, 1, 9, 14)))) for _ in range(r.randint(1, 6))]
        near = list(tags[-1])
        for _ in range(c % 5):
            i = r.randrange(len(near) + 1)
            near[i : i + r.randint(0, 1)] = r.choice(("", "A", "C", "GT"))
        for t in [*tags, "".join(near)]:
            rows.append((c, n := n + 1, t))
    want = {}
    for k, (c, _, s) in enumerate(rows):
        for d, _, t in rows[:k]:
            if c == d:
                want[c] = min(want.get(c, 99), levenshtein(s, t))
    got = demux.least_distances(spark.createDataFrame(rows, "g long, ord long, seq string"), "g", F.col("seq"))
    assert {x["g"]: x["least"] for x in got.collect()} == want and len(set(want.values())) > 3


def test_concatenated_layouts(spark):
    lists = [spark.createDataFrame(x, "value string") for x in ([("B:ACG R:N",), ("  R:N ",), ("",), (None,)], [("R:N # all of it",), ("# none",), ("B:ACG\tR:N",)])]
    assert sorted(r["layout"] for r in choose.concatenate(*lists).collect()) == ["B:ACG R:N", "R:N"]
    assert choose.concatenate(lists[0].limit(0)).count() == 0
