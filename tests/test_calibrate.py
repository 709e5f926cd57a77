"""Drawing reads of a least length from a model."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from readloom.operators.calibrate import Sampler, calibrate
from readloom.plans import layout as L
from readloom.plans.model import Model, Options, Stats, build

BACKGROUND = (0.27, 0.24, 0.22, 0.26, 0.01)


def model(words: str, average: float = 30) -> Model:
    return build(L.parse(words), Stats(BACKGROUND, average, int(average), 5, 2, 4, 2), Options())


def by_rejection(m: Model, rng: np.random.Generator, n: int, least: int) -> list[str]:
    """The plain way: whole reads, those that are too short thrown away."""
    allowed = ~m.null[m.profile]
    choices = np.column_stack((m.step * allowed, m.end))
    choices /= np.maximum(choices.sum(1, keepdims=True), 1e-300)
    start, bases = m.start * allowed / (m.start * allowed).sum(), m.emit[:5] / m.emit[:5].sum(0)
    out = []
    while len(out) < n:
        state, read = rng.choice(len(start), p=start), ""
        while state < len(start):
            read += "ACGTN"[rng.choice(5, p=bases[:, state])]
            state = rng.choice(len(start) + 1, p=choices[state])
        if len(read) >= least:
            out.append(read)
    return out


@pytest.mark.parametrize(("words", "least"), [("B:ACAG,TTGA O:N R:N", 24), ("F:NNN S:GATT G:GGG", 9), ("P:ACGTAC R:N", 1), ("B:AC,GT S:TTT", 5)])
def test_same_distribution_as_rejection(words, least):
    m, n = model(words), 3000
    got, want = Sampler(m, least).draw(np.random.default_rng(1), n), by_rejection(m, np.random.default_rng(2), n, least)
    assert min(map(len, got)) >= least
    for what in (len, lambda s: s[:2], lambda s: s[-2:], lambda s: s[least // 2]):
        a, b = Counter(map(what, got)), Counter(map(what, want))
        # every share within five standard errors
        assert all(abs(a[k] - b[k]) <= 5 * np.sqrt(a[k] + b[k] + 1) for k in {*a, *b})


def test_no_null_alternative_is_drawn():
    got = Sampler(model("B:AAAA,CCCC R:N"), 20).draw(np.random.default_rng(3), 500)
    near = Counter(max("AC", key=s[:4].count) for s in got)
    assert set(near) == {"A", "C"} and min(near.values()) > 150


def test_layouts_without_a_read_end(spark):
    """Reads of the average length are rarer than one in 10^100 here, or there are none."""
    m = model("B:ACAGTG,ACTTGA S:GATTCA F:NNNN", 60)
    drawn = Sampler(m, 60).draw(np.random.default_rng(4), 300)
    assert min(map(len, drawn)) >= 60
    one = Sampler(model("O:T B:A,C", 40), 40).draw(np.random.default_rng(4), 50)
    assert min(map(len, one)) >= 40
    fixed = Sampler(model("B:A,C S:G", 40), 40).draw(np.random.default_rng(4), 50)
    assert set(map(len, fixed)) == {2}
    o = Options(calibration_reads=2000)
    for words in ("B:ACAGTG,ACTTGA S:GATTCA F:NNNN", "B:A,C S:G"):
        assert 0 <= calibrate(spark, model(words, 60), o) <= 20
