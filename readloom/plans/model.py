"""From a layout to a hidden Markov model with emitting states only.

Every alternative of a segment is a profile: match, insert and delete states per column.  States without an
emission form a graph without cycles and are summed out exactly, deletions and the places between segments apart:
from one base to the next a path either stays within its profile (a small dense block for each), or leaves its segment
for a place between two and enters a profile from there (an outer product for each place).  So a base costs as many steps as
there are states times the width of a profile, not the square of the states, however many barcodes there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from .layout import Layout, Segment

#: Probability that an insertion or deletion goes on.  A fixed value of the model.
GAP = 0.001
#: Segments of type G: entered with this probability, each further base with the second.  Fixed values of the model.
G_ENTER, G_MORE = 0.8935878, 0.195
#: The expected payload is never shorter.
LEAST_READ = 20
CODES = 6  # A C G T N and the dot


@dataclass(frozen=True)
class Options:
    """Everything a run may set."""

    error_rate: float = 0.05
    indel_fraction: float = 0.1
    threshold: float | None = None
    min_length: int = 16
    start: int | None = None  # 1-based window that the model sees
    end: int | None = None
    dust: float = 100.0
    contaminant_errors: int = 2
    seed: int = 42
    stats_reads: int | None = 1_000_001  # of a file, for its figures; None: all
    search_reads: int | None = 100_000  # of a file, for the choice of its layout; None: all
    spread: bool = True  # these reads are from all over the file, by a hash of their numbers; else its first ones
    calibration_reads: int = 400_000


@dataclass(frozen=True)
class Stats:
    """What is known of the reads of one file."""

    background: tuple[float, ...]  # A C G T N, adding up to 1
    average_length: float
    max_length: int = 0
    mean_5: float = 0.0
    sd_5: float = 1.0
    mean_3: float = 0.0
    sd_3: float = 1.0


@dataclass
class Model:
    """Emitting states, those of a profile side by side; start, steps and ends; and which profile each state belongs to."""

    layout: Layout
    emit: np.ndarray  # CODES, states
    start: np.ndarray
    blocks: list[tuple[int, np.ndarray]]  # of neighbouring profiles of one width: the first state, and their steps (profiles, width, width)
    out: np.ndarray  # states, places between segments
    into: np.ndarray  # places, states
    end: np.ndarray
    profile: np.ndarray  # of each state
    entry: np.ndarray  # whether a state is the first of its profile on any path
    segment: np.ndarray  # of each profile
    alternative: np.ndarray  # of each profile
    null: np.ndarray  # whether a profile is a null alternative
    skips: np.ndarray  # whether a segment may be left out
    average_length: float
    background: np.ndarray
    advantage: float  # by how much all segments together can favour a read over random bases

    @property
    def step(self) -> np.ndarray:
        """All steps between states as one matrix; the kernel does without it."""
        full = self.out @ self.into
        for lo, block in self.blocks:
            for k, one in enumerate(block):
                at = slice(lo + k * len(one), lo + (k + 1) * len(one))
                full[at, at] += one
        return full

    @property
    def firsts(self) -> np.ndarray:
        """The first state of each profile."""
        return np.flatnonzero(np.diff(self.profile, prepend=-1))


def gaussian(x: float, mean: float, sd: float) -> float:
    return math.exp(-0.5 * ((x - mean) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))


def expected_read(layout: Layout, average: float) -> int:
    """Payload length: the average without the other segments."""
    length = {"R": lambda s: 0, "G": lambda s: 2, "P": lambda s: s.length // 2}
    return max(LEAST_READ, round(average) - sum(length.get(s.kind, lambda s: s.length)(s) for s in layout.segments))


@dataclass
class _Graph:
    """States are added one by one; weights are kept until the silent ones are summed out."""

    emit: list[np.ndarray | None] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)
    first: list[bool] = field(default_factory=list)
    weights: list[tuple[int, int, float]] = field(default_factory=list)

    def add(self, emit: np.ndarray | None = None, owner: int = -1, first: bool = False) -> int:
        self.emit.append(emit)
        self.owner.append(owner)
        self.first.append(first)
        return len(self.emit) - 1

    def join(self, a: int, b: int, w: float) -> None:
        if w > 0:
            self.weights.append((a, b, w))


def _match(base: str, bg: np.ndarray, o: Options) -> np.ndarray:
    """Emissions of a match column."""
    if base == "N":
        return np.append(bg, bg[4])
    if base == ".":
        return np.array([0, 0, 0, 0, 1.0, 1.0])
    miss = o.error_rate * (1 - o.indel_fraction)
    out = np.full(CODES, miss / 3)
    out["ACGT".index(base)] = 1 - bg[4] - miss
    out[4:] = bg[4]
    return out


def _leaving(n: int, mode: tuple[str, float, float]) -> list[float]:
    """Of each column of a profile, the probability to leave the segment after its match."""
    kind, a, b = mode
    if kind == "gaussian":
        total = sum(gaussian(i, a, b) for i in range(n + 1))
        out = [gaussian(i, a, b) / total for i in range(n)]
        if n > 2:
            out[n - 2] = gaussian(n - 1, a, b) / total
    else:
        out = [a / (n - 1) if kind == "constant" and n > 1 else 0.0] * n
    out[-1] = 1.0
    return out


def _profile(g: _Graph, seq: str, owner: int, enter: int, leave: int, enters: dict[int, float], leaves: list[float], bg: np.ndarray, o: Options) -> None:
    """One alternative: ``enters`` gives the weight of beginning at a column."""
    n, gap = len(seq), o.error_rate * o.indel_fraction
    emits = [_match(c, bg, o) for c in seq]
    only_first = set(enters) == {0}
    match = [g.add(emits[j], owner, only_first and j == 0) for j in range(n)]
    insert = [g.add(np.append(bg, bg[4]), owner) for _ in range(n - 1)]
    delete = {j: g.add() for j in range(1, n - 1)}

    def out(state: int, j: int) -> None:
        stay = 1 - leaves[j]
        g.join(state, leave, leaves[j])
        if j == n - 1:
            return
        deletes = j + 1 in delete
        g.join(state, match[j + 1], (1 - gap) * stay)
        g.join(state, insert[j], gap * (0.5 if deletes else 1.0) * stay)
        if deletes:
            g.join(state, delete[j + 1], gap * 0.5 * stay)

    for j in range(n):
        out(match[j], j)
        if j < n - 1:
            g.join(insert[j], insert[j], GAP)
            g.join(insert[j], match[j + 1], 1 - GAP)
        if j in delete:
            last = j + 1 not in delete
            g.join(delete[j], match[j + 1], 1.0 if last else 1 - GAP)
            if not last:
                g.join(delete[j], delete[j + 1], GAP)
    for j, w in enters.items():
        if only_first:
            g.join(enter, match[0], w)
        else:  # a copy that is reached from outside only tells where paths begin
            copy = g.add(emits[j], owner, True)
            out(copy, j)
            g.join(enter, copy, w)


def _loop(g: _Graph, emit: np.ndarray, owner: int, enter: int, leave: int, weight: float, more: float) -> None:
    """A state that repeats: its first visit is a copy of its own."""
    first, again = g.add(emit, owner, True), g.add(emit, owner)
    g.join(enter, first, weight)
    for s in (first, again):
        g.join(s, again, more)
        g.join(s, leave, 1 - more)


def _adapter(s: Segment, place: str, stats: Stats) -> tuple[dict[int, float], list[float], float]:
    """Where an adapter that may be cut is entered (per alternative) and left, and how likely it is missing."""
    n, k = s.length, len(s.seqs)
    if place == "first":
        enters = {j: gaussian(j, n - stats.mean_5, stats.sd_5) for j in range(n)}
        skip = gaussian(n, n - stats.mean_5, stats.sd_5)
        total = sum(enters.values()) + skip
        return {j: w / total / k for j, w in enters.items()}, _leaving(n, ("none", 0, 0)), skip / total
    if place == "last":
        missing = gaussian(0, stats.mean_3, stats.sd_3) / sum(gaussian(i, stats.mean_3, stats.sd_3) for i in range(n))
        return {0: (1 - missing) / k}, _leaving(n, ("gaussian", stats.mean_3, stats.sd_3)), missing
    return {0: 0.99 / k}, _leaving(n, ("constant", 0.1, 0)), 0.01


def build(layout: Layout, stats: Stats, o: Options) -> Model:
    bg = np.array(stats.background, float)
    g = _Graph()
    edges = [g.add() for _ in range(len(layout.segments) + 1)]  # between segments
    segment, alternative, null, skips = [], [], [], []
    read = expected_read(layout, stats.average_length)
    for s, seg in enumerate(layout.segments):
        seqs = seg.alternatives
        skip = 0.0
        for k, seq in enumerate(seqs):
            owner = len(segment)
            segment.append(s)
            alternative.append(k)
            null.append(seg.kind in "BS" and k == len(seqs) - 1)
            here = (g, seq, owner, edges[s], edges[s + 1])
            if seg.kind == "R":
                _loop(g, np.append(bg, bg[4]), owner, *here[3:], 1.0, 1 - 1 / read)
            elif seg.kind == "O":
                skip = 0.5
                _loop(g, _match(seq[0], bg, o), owner, *here[3:], 0.5 / len(seqs), 1 - 1 / (seg.length + 1))
            elif seg.kind == "G":
                skip = 1 - G_ENTER
                _loop(g, _match(seq[0], bg, o), owner, *here[3:], G_ENTER / len(seqs), G_MORE)
            elif seg.kind == "P":
                place = "first" if s == 0 else "last" if s == len(layout.segments) - 1 else "inner"
                enters, leaves, skip = _adapter(seg, place, stats)
                _profile(*here, enters, leaves, bg, o)
            else:
                _profile(*here, {0: 1 / len(seqs)}, _leaving(len(seq), ("none", 0, 0)), bg, o)
        g.join(edges[s], edges[s + 1], skip)
        skips.append(skip > 0)
    n = len(g.emit)
    t = np.zeros((n, n))
    for a, b, w in g.weights:
        t[a, b] += w
    loud = np.array([e is not None for e in g.emit])
    place = np.isin(np.arange(n), edges)
    gone = ~loud & ~place
    keep = np.flatnonzero(loud)
    # deletions are passed within a profile, left-out segments between places
    through = t[np.ix_(loud, gone)] @ np.linalg.inv(np.eye(int(gone.sum())) - t[np.ix_(gone, gone)])
    within = t[np.ix_(loud, loud)] + through @ t[np.ix_(gone, loud)]
    out = t[np.ix_(loud, place)] + through @ t[np.ix_(gone, place)]
    onward = np.linalg.inv(np.eye(int(place.sum())) - t[np.ix_(place, place)])
    into = onward @ t[np.ix_(place, loud)]
    owner = np.array([g.owner[i] for i in keep])
    return Model(
        layout, np.stack([g.emit[i] for i in keep], 1), into[0], _blocks(within, owner), out, into, out @ onward[:, -1],
        owner, np.array([g.first[i] for i in keep]), np.array(segment), np.array(alternative), np.array(null), np.array(skips), float(stats.average_length), bg, _advantage(layout, bg, o),
    )


def _advantage(layout: Layout, bg: np.ndarray, o: Options) -> float:
    out, random = 1.0, np.append(bg, bg[4])
    with np.errstate(divide="ignore", over="ignore"):
        for seg in layout.segments:
            each = [np.prod([np.max(np.where(e > 0, e / random, 0)) for e in (_match(c, bg, o) for c in seq)]) for seq in seg.alternatives]
            out *= max(1.0, *each)
    return float(out)


def _blocks(within: np.ndarray, owner: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each profile's own steps; those of neighbours of one width together."""
    sizes = np.bincount(owner)
    out, lo, p = [], 0, 0
    while p < len(sizes):
        many = next((k for k in range(p, len(sizes)) if sizes[k] != sizes[p]), len(sizes)) - p
        w = int(sizes[p])
        at = lo + np.arange(many * w).reshape(many, w)
        out.append((lo, within[at[:, :, None], at[:, None, :]]))
        lo, p = lo + many * w, p + many
    return out
