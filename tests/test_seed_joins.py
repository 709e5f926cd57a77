"""Contaminants by joins of pieces, for references of any size, against the index that is sent to executors."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import filters

FLIP = str.maketrans("ACGT", "TGCA")


def made(errors: int) -> tuple[list[tuple[int, str]], list[str]]:
    r = random.Random(errors + 20)
    make = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    refs = [(k, make(n)) for k, n in enumerate((3, 20, 300, 1500, 512, 1024))] + [(6, "A" * 200), (7, "ACGT" * 60), (8, "GATTACA" * 100), (9, "NNNNACGTNNNN"), (10, ""), (11, "acguacguuugacca" * 4)]
    both = [s for _, t in refs for s in (filters._clean(t), filters._clean(t).translate(FLIP)[::-1]) if s]
    probes = ["", "A", "ACGTN", "A" * 32, "T" * 17, "ACGT" * 8, "CGTA" * 4]
    for _ in range(150):
        text = r.choice(both)
        at, n = r.randrange(len(text)), r.randint(1, 36)
        p = list(text[at : at + n])
        for _ in range(r.randint(0, errors + 1)):
            i = r.randrange(len(p) + 1)
            p[i : i + r.randint(0, 1)] = r.choice(("", "A", "C", "GT"))
        probes.append("".join(p))
    # around the ends of the rows that references are cut into
    text = refs[3][1]
    probes += [text[a : a + 15] + ("" if errors else text[a + 15]) + text[a + 16 : a + 32] for a in range(470, 530, 3)] + [text[:32], text[-32:], text[-20:]]
    return refs, probes


@pytest.mark.parametrize("errors", [0, 1, 2, 3])
def test_joins_find_what_the_index_finds(spark, errors, monkeypatch):
    refs, probes = made(errors)
    reads = spark.createDataFrame([(i, "mismatch" if i % 17 == 3 else "success", [(p, None)]) for i, p in enumerate(probes)], "ord long, outcome string, payloads array<struct<seq:string,qual:string>>").withColumn("size", F.lit(1))
    table = spark.createDataFrame([*refs, (12, None)], "ref_ix int, seq string")
    want = filters.contaminants(reads, table, errors)
    monkeypatch.setattr(filters, "PART_BASES", 0)
    monkeypatch.setattr(filters, "_SPREAD", 5)
    got = filters.contaminants(reads, table, errors)
    assert got.columns == want.columns == [*reads.columns, "contaminant_ix"]
    rows = lambda df: {r["ord"]: (r["outcome"], r["contaminant_ix"]) for r in df.collect()}
    assert rows(got) == rows(want) and sum(x is not None for _, x in rows(got).values()) > 60


def test_plan_goes_once_over_the_reads_however_large_the_references(spark, monkeypatch, capsys):
    monkeypatch.setattr(filters, "PART_BASES", 0)
    reads = spark.range(100).selectExpr("id AS ord", "'success' AS outcome", "array(named_struct('seq', translate(md5(concat('p', id)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 'qual', cast(null as string))) AS payloads")
    table = spark.range(40).selectExpr("cast(id as int) AS ref_ix", "repeat(translate(md5(cast(id as string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 200) AS seq")
    filters.contaminants(reads, table).explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_references(spark):
    reads = spark.createDataFrame([(0, "success", [("ACGT" * 8, None)])], "ord long, outcome string, payloads array<struct<seq:string,qual:string>>")
    assert [(r["outcome"], r["contaminant_ix"]) for r in filters.contaminants(reads, spark.createDataFrame([], "ref_ix int, seq string")).collect()] == [("success", None)]
