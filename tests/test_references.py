"""Contaminant references against full alignments: RNA letters, short probes, repeats, and large references."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.operators import filters


def test_references_of_rna_letters(spark):
    r = random.Random(7)
    ref = "".join(r.choice("ACGU") for _ in range(400))
    dna = ref.replace("U", "T")
    probes = []
    for _ in range(60):
        at = r.randrange(len(ref) - 32)
        p = list(dna[at : at + 32])
        for _ in range(r.randint(0, 3)):
            p[r.randrange(32)] = r.choice("ACGTN")
        probes.append("".join(p))
    probes += [ref[50:82], "".join(r.choice("ACGT") for _ in range(32))]

    def least(p):
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in dna:
            new = [0]
            for j, y in enumerate(p.replace("U", "T"), 1):
                new.append(min(row[j - 1] + (c != y), row[j] + 1, new[-1] + 1))
            row, best = new, min(best, new[-1])
        return best

    got = filters.match_references(spark.createDataFrame([(i, p) for i, p in enumerate(probes)], "i long, probe string"), [(0, ref)], 2)
    got = {x["i"]: x["e"] for x in got.select("i", F.col("hit.errors").alias("e")).collect()}
    assert got == {i: e if (e := least(p)) <= 2 else None for i, p in enumerate(probes)}
    assert sum(e is not None for e in got.values()) > 30


def least_errors(probe, text):
    """By full alignment, the least edit distance of a probe to any part of a text."""
    row = list(range(len(probe) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, y in enumerate(probe, 1):
            new.append(min(row[j - 1] + (c != y), row[j] + 1, new[-1] + 1))
        row, best = new, min(best, new[-1])
    return best


@pytest.mark.parametrize("errors", [0, 1, 2, 3])
def test_windows_find_what_full_alignments_find(errors):
    r = random.Random(errors)
    flip = str.maketrans("ACGT", "TGCA")
    refs = [(k, "".join(r.choice("ACGT") for _ in range(r.choice((3, 20, 300))))) for k in range(6)] + [(6, "A" * 200), (7, "ACGT" * 60), (8, "GATTACA" * 30), (9, "NNNNACGTNNNN")]
    both = [(k, s) for k, t in refs for s in (t, t.translate(flip)[::-1])]
    probes = ["", "A", "ACGTN", "A" * 32, "T" * 17, "ACGT" * 8, "CGTA" * 4]
    for _ in range(150):
        k, text = r.choice(both)
        at, n = r.randrange(len(text)), r.randint(1, 36)
        p = list(text[at : at + n])
        for _ in range(r.randint(0, errors + 1)):
            i = r.randrange(len(p) + 1)
            p[i : i + r.randint(0, 1)] = r.choice(("", "A", "C", "GT"))
        probes.append("".join(p))
    got = filters._References(refs, errors).best(probes)
    for p, hit in zip(probes, got, strict=True):
        p = p[: filters.PROBE]
        want = min(((e, k) for k, s in both if (e := least_errors(p, s)) <= errors), default=None) if p else None
        assert hit == want, p


def test_a_reference_of_two_million_bases_takes_seconds():
    r = np.random.default_rng(1)
    text = np.frombuffer(b"ACGT", np.uint8)[r.integers(0, 4, 2_000_000)].tobytes().decode()
    probes = [text[a : a + 15] + "A" + text[a + 16 : a + 32] for a in r.integers(0, len(text) - 40, 500).tolist()] + ["".join("ACGT"[x] for x in r.integers(0, 4, 32)) for _ in range(500)]
    began = time.process_time()
    got = filters._References([(0, text)], 2).best(probes)
    assert time.process_time() - began < 30 and all(got[:500]) and sum(map(bool, got[500:])) < 50
