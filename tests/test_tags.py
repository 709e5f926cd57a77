"""Plates of barcodes are scored without steps back, and repeated reads once."""

from __future__ import annotations

import numpy as np
import pytest

from readloom.operators import label
from readloom.plans import kernel as K, layout as L
from readloom.plans.model import Options, Stats, build
from readloom.queries import PLATE

STATS = Stats((0.25, 0.25, 0.25, 0.24, 0.01), 32.0, 32)
PLATE_WORDS = "B:" + ",".join(PLATE[:24]) + " R:N"


def some_reads(tags, n=300):
    rng = np.random.default_rng(8)
    letters = lambda k: "".join(rng.choice(list("ACGTN."), k, p=[0.3, 0.3, 0.2, 0.1, 0.05, 0.05]))
    out = ["", "A", "N" * 40, "." * 9]
    for _ in range(n):
        tag = list(tags[rng.integers(len(tags))])
        for _ in range(rng.integers(0, 4)):
            i = rng.integers(len(tag) + 1)
            tag[i : i + rng.integers(0, 2)] = letters(rng.integers(0, 2))
        out.append("".join(tag) + letters(rng.integers(0, 60)))
    return out


@pytest.mark.parametrize("words", [PLATE_WORDS, "B:ACAGTG,ACTTGA,TTAGGC R:N", "B:A,C R:N", "S:ACGTAC R:N", "F:NNNN R:N"])
def test_tags_are_scored_as_by_the_general_way(words):
    m = build(L.parse(words), STATS, Options())
    assert K._TagThenRead.fits(m)
    reads = some_reads([s for s in m.layout.segments[0].seqs])
    got, want = K.label(m, reads), K._label_any(m, reads, True)
    for i, (labels, q, log, _) in enumerate(want):
        assert np.array_equal(got.labels[i], labels), reads[i]
        assert got.q[i] == pytest.approx(q, abs=1e-8)
        assert got.log_model[i] == log or got.log_model[i] == pytest.approx(log)


@pytest.mark.parametrize("words", ["B:ACGT R:N P:ACAC", "P:ACGT B:ACAG R:N", "R:N", "B:ACAG,TTGA F:NN R:N", "G:GG R:N"])
def test_other_layouts_go_the_general_way(words):
    assert not K._TagThenRead.fits(build(L.parse(words), STATS, Options()))


def test_steps_are_few(monkeypatch):
    """Of a plate no states are held against all reads for steps back."""
    monkeypatch.setattr(K, "_betas", lambda *a: pytest.fail("steps back"))
    m = build(L.parse(PLATE_WORDS), STATS, Options())
    assert K.label(m, [t + "ACGTTGCA" * 4 for t in PLATE[:24]]).labels[5].tolist() == [5] * 8 + [25] * 32


def test_repeated_reads_are_scored_once(monkeypatch):
    m, scored = build(L.parse("B:ACAGTG,ACTTGA S:GGG R:N"), STATS, Options()), []
    plain = K.label
    monkeypatch.setattr(label.kernel, "label", lambda m, seqs, *a: scored.extend(seqs) or plain(m, seqs, *a))
    reads = some_reads(["ACAGTGGGG", "ACTTGAGGG"], 40)
    memory = label._Memory(m)
    for part in (reads + reads, reads[::-1]):
        for s, (labels, q) in zip(part, memory.label(part), strict=True):
            assert len(labels) == len(s) and q >= 0
    assert sorted(scored) == sorted(set(reads))
    monkeypatch.setattr(label, "_MEMORY", 3000)
    memory = label._Memory(m)
    for at in range(0, len(reads), 5):
        assert len(memory.label(reads[at : at + 5])) == len(reads[at : at + 5]) and memory.held <= 3000


def test_what_follows_from_labels_is_remembered():
    m, o, known = build(L.parse("B:ACAGTG,ACTTGA F:NNN R:N"), STATS, Options(min_length=4)), Options(min_length=4), {}
    for s in some_reads(["ACAGTGTTT", "ACTTGACCC"], 60):
        got = K.label(m, [s])
        rest = (m, o, s, "I" * len(s), got.labels[0], 3.0, 0.0, 0)
        assert label.take_apart(*rest) == label.take_apart(*rest, known) == label.take_apart(*rest, known)
    assert known


def test_simulated_reads_are_the_same_as_ever():
    from readloom.operators import simulate

    p = simulate.Plan(reads=100, barcodes=("ACAGTG", "TTAGGC"), read_length_mod=3, end_loss=2)
    assert [simulate.one(p, i) for i in (0, 50, 99)] == [("READ1;SEQ:GCCTAGAAGTGTGTGAT;RBC:TTAGGC;BARNUM:2", "TAGGCGCCTAGAAGTGTGTGAT"), ("READ51;SEQ:TGCCACATCGGCGGTACGAGCT;RBC:TTAGGC;BARNUM:2", "TTAGGCTGCCACATCGGCGGTACGAG"), ("RAND100;SEQ:NONE;RBC:NONE;BARNUM:0", "GAACCTGTCTGCTCACATCAAATG")]
    assert {"used", "real"} <= p.__dict__.keys()  # worked out once, not for each read
