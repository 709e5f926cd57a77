from __future__ import annotations

import pytest

from readloom.plans import layout as L


def test_grammar():
    a = L.parse("-1 B:ACGT,TTGA -2 S:GG -3 F:NNNN -4 R:anything")
    assert str(a) == "B:ACGT,TTGA S:GG F:NNNN R:N"
    assert a.segments[0].alternatives == ("ACGT", "TTGA", "NNNN")
    assert a.segments[2].alternatives == ("NNNN",)
    assert (a.reads, a.umi_length, a.plain, L.parse("R:N").plain) == (1, 4, False, True)
    assert L.parse("-2 R:N -1 B:AC") == L.parse("program B:AC R:N")


@pytest.mark.parametrize("words", ["", "X:AC", "B:", "B:ACG,AC", "B:AXG", "-1 B:AC -3 R:N", "-1", "B:AC junk"])
def test_refused(words):
    with pytest.raises(L.LayoutError):
        L.parse(words)


def test_files():
    assert [str(a) for a in L.parse_file(["tool -1 B:ACAGTG,ACTTGA", "", "# note", "tool -1 R:N -seed 3"])] == ["B:ACAGTG,ACTTGA", "R:N"]
    with pytest.raises(L.LayoutError):
        L.parse_file(["-1 R:N", "-1 R:N"])


def test_distance():
    assert L.edit_distance("ACGT", "AGT") == 1
    assert L.least_distance(("ACGT", "ACGA", "TTTT")) == 1
    assert L.least_distance(("A",)) is None
    assert L.warnings(L.parse("B:ACGT,ACGT R:N"))
