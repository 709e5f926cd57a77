"""Scoring and labelling of reads: arrays in, arrays out, many reads at once.

Probabilities are scaled at every base, so the forward and backward sums are plain products: of small blocks, one for
each profile, and of what leaves and enters segments (see ``model``).  Within, arrays have a row for each state and a
column for each read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from .model import CODES, Model

_LUT = np.full(256, 4, np.uint8)
for _i, _c in enumerate(("Aa", "Cc", "Gg", "TtUu")):
    for _x in _c:
        _LUT[ord(_x)] = _i
_LUT[ord(".")] = 5
#: Best confidence there is.
TOP_Q = 40.0


def encode(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the reads in rows, filled up with N, and their lengths."""
    lengths = np.fromiter(map(len, seqs), np.int64, len(seqs))
    flat = _LUT[np.frombuffer("".join(seqs).encode("latin-1", "replace"), np.uint8)]
    out = np.full((len(seqs), int(lengths.max(initial=0))), 4, np.uint8)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


#: States before a read segment are given up where, of every read, they hold less than this part of what the segment
#: holds, over the model's advantage: later bases cannot make up for it.
_NEGLIGIBLE = 1e-20
#: Bases between two looks for such states.
_LOOK = 3


class _Steps:
    """A model's steps from the states of one base to those of the next, for states from ``lo`` on only."""

    def __init__(self, m: Model) -> None:
        self.m, self.emit = m, np.ascontiguousarray(m.emit.T)
        self.blocks = [(lo, block, np.ascontiguousarray(block.transpose(0, 2, 1))) for lo, block in m.blocks]
        self.leave, self.enter = np.flatnonzero(m.out.any(1)), np.flatnonzero(m.into.any(0))
        bounds = [int(np.flatnonzero(m.segment[m.profile] == s)[0]) for s in range(len(m.skips))] + [len(m.start)]
        read = next((s for s, seg in enumerate(m.layout.segments) if seg.kind == "R"), 0)
        #: The states of each segment before the first read segment, and those of that one.
        self.early, self.read = list(zip(bounds[:read], bounds[1:], strict=False)), slice(bounds[read], bounds[read + 1])
        self.least = _NEGLIGIBLE / m.advantage if m.advantage < 1e250 else 0.0

    def emission(self, lo: int, codes: np.ndarray) -> np.ndarray:
        return np.take(self.emit[lo:], codes, axis=1)

    def _within(self, lo: int, now: np.ndarray, which: int) -> np.ndarray:
        new = np.empty_like(now)
        for at, *blocks in self.blocks:
            block = blocks[which]
            h, w, _ = block.shape
            skip = max(0, lo - at) // w
            if skip < h:
                part = slice(at + skip * w - lo, at + h * w - lo)
                np.matmul(block[skip:], now[part].reshape(h - skip, w, -1), out=new[part].reshape(h - skip, w, -1))
        return new

    def _across(self, lo: int, new: np.ndarray, now: np.ndarray, a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> np.ndarray:
        a, b = a[a >= lo], b[b >= lo]
        new[b - lo] += wb[:, b].T @ (wa[a].T @ now[a - lo])
        return new

    def onward(self, lo: int, now: np.ndarray) -> np.ndarray:
        return self._across(lo, self._within(lo, now, 1), now, self.leave, self.m.out, self.enter, self.m.into)

    def back(self, lo: int, now: np.ndarray) -> np.ndarray:
        return self._across(lo, self._within(lo, now, 0), now, self.enter, self.m.into.T, self.leave, self.m.out.T)

    def given_up(self, lo: int, now: np.ndarray) -> int:
        """The first state that still counts; the others come before it, and nothing leads back to them."""
        read = now[self.read.start - lo : self.read.stop - lo].sum(0) * self.least if self.early else None
        for a, b in self.early:
            if a == lo:
                if not (now[: b - a].sum(0) <= read).all():
                    break
                lo, now = b, now[b - a :]
        return lo

    def by_profile(self, lo: int, now: np.ndarray) -> tuple[int, np.ndarray]:
        """The first profile whose states count, and the sums of it and the others."""
        parts = []
        for at, block, _ in self.blocks:
            h, w, _ = block.shape
            skip = max(0, lo - at) // w
            if skip < h:
                parts.append(now[at + skip * w - lo : at + h * w - lo].reshape(h - skip, w, -1).sum(1))
        out = np.concatenate(parts)
        return len(self.m.segment) - len(out), out


Alpha = list[tuple[int, np.ndarray]]


def _forward(steps: _Steps, x: np.ndarray, n: np.ndarray, keep: bool = True) -> tuple[Alpha, np.ndarray, np.ndarray, np.ndarray]:
    """Of each base the first state that counts and the scaled values (states, reads) from there on (none unless they are kept); the scales; what may end; and log P(x | M)."""
    m, (b, width) = steps.m, x.shape
    alpha, scale, last = [], np.ones((width, b)), np.zeros(b)
    now, lo = np.zeros((len(m.start), b)), 0
    for t in range(width):
        new = steps.onward(lo, now) if t else np.repeat(m.start[:, None], b, 1)
        new *= steps.emission(lo, x[:, t])
        c, live = new.sum(0), t < n
        c[c <= 0] = 1.0
        scale[t, live] = c[live]
        new /= c
        if not live.all():
            new[:, ~live] = 0.0
        now = new
        ends = t == n - 1
        if ends.any():
            last[ends] = m.end[lo:] @ now[:, ends]
        if keep:
            alpha.append((lo, now))
        if t % _LOOK == _LOOK - 1 and (up := steps.given_up(lo, now)) > lo:
            # what is given up counts no more from the next base on
            now, lo = now[up - lo :], up
    with np.errstate(divide="ignore"):
        return alpha, scale, last, np.where(n > 0, np.log(scale).sum(0) + np.log(last), -np.inf)


def _betas(steps: _Steps, x: np.ndarray, n: np.ndarray, los: list[int], scale: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(t, scaled backward values (states that count, reads)), from the last base to the first."""
    m, (b, width) = steps.m, x.shape
    ends = m.end[:, None] / np.where(last > 0, last, 1.0)
    now = ends[los[-1] :] if width else ends
    for t in range(width - 1, -1, -1):
        if t < width - 1:
            g = steps.emission(los[t + 1], x[:, t + 1])
            g *= now
            g /= scale[t + 1]
            if los[t] < los[t + 1]:
                g = np.concatenate((np.zeros((los[t + 1] - los[t], b)), g))
            on = t + 1 < n
            now = steps.back(los[t], g)
            if not on.all():
                now = np.where(on, now, ends[los[t] :])
        yield t, now


def forward(m: Model, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward values (length, reads, states), the scales (length, reads), and log P(x | M)."""
    alpha, scale, _, log = _forward(_Steps(m), x, n)
    out = np.zeros((x.shape[1], len(x), len(m.start)))
    for t, (lo, now) in enumerate(alpha):
        out[t, :, lo:] = now.T
    return out, scale, log


def backward(m: Model, x: np.ndarray, n: np.ndarray, alpha: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Scaled backward values: alpha * beta is the posterior of each state."""
    beta, width = np.zeros_like(alpha), x.shape[1]
    last = alpha[np.maximum(n - 1, 0), np.arange(len(x))] @ m.end if width else np.zeros(len(x))
    for t, now in _betas(_Steps(m), x, n, [0] * width, scale, last):
        beta[t] = now.T
    return beta


def posterior(m: Model, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The posterior of each profile at each base (length, reads, profiles), that of entering each profile anywhere (reads, profiles), and log P(x | M)."""
    steps = _Steps(m)
    alpha, scale, last, log = _forward(steps, x, n)
    profiles, b = len(m.segment), len(x)
    share, entered = np.zeros((x.shape[1], profiles, b)), np.zeros((profiles, b))
    entries = np.flatnonzero(m.entry)
    for t, beta in _betas(steps, x, n, [lo for lo, _ in alpha], scale, last):
        lo, post = alpha.pop()
        post *= beta
        inside = t < n
        if not inside.all():
            post[:, ~inside] = 0.0
        first, sums = steps.by_profile(lo, post)
        share[t, first:] = sums
        some = entries[entries >= lo]
        if len(some):
            of = m.profile[some]
            at = np.flatnonzero(np.diff(of, prepend=-1))
            entered[of[at]] += np.add.reduceat(post[some - lo], at, axis=0)
    return share.transpose(0, 2, 1), entered.T, log


def log_likelihood(m: Model, seqs: list[str]) -> np.ndarray:
    """log P(x | M) of each read."""
    return _by_length(seqs, lambda part: _forward(_Steps(m), *encode(part), keep=False)[3], float, len(m.start))


def random_log_likelihood(m: Model, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    bg = np.log(np.append(m.background, m.background[4]))
    inside = np.arange(x.shape[1]) < n[:, None]
    a = max(m.average_length, 1.0 + 1e-9)
    return (bg[x] * inside).sum(1) + n * np.log(1 - 1 / a) + np.log(1 / a)


#: Numbers in one array of a batch; the batches of long reads are small.
_CELLS = 8_000_000


def _by_length(seqs: list[str], f: Callable[[list[str]], Sequence], kind: type, states: int, most: int = 512) -> np.ndarray:
    """Apply f to reads of like length together; results in the order of the reads."""
    order = np.argsort([len(s) for s in seqs], kind="stable")[::-1]
    out = np.empty(len(seqs), kind)
    at = 0
    while at < len(order):
        width = max(1, len(seqs[order[at]]))
        part = order[at : at + min(most, max(1, _CELLS // (width * states)))]
        got = f([seqs[i] for i in part])
        for k, i in enumerate(part):
            out[i] = got[k]
        at += len(part)
    return out


def best_path(m: Model, share: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(reads, length): the profile of every base, by the greatest sum of posteriors over allowed orders.

    From one profile the next base may stay, or go on to a later segment if all between may be left out."""
    width, b, h = share.shape
    share = np.ascontiguousarray(share.transpose(0, 2, 1))
    seg, k = m.segment, len(m.skips)
    starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    bounds = list(zip(starts.tolist(), [*starts[1:].tolist(), h], strict=True))
    may_open = np.array([all(m.skips[:s]) for s in range(k)])
    may_close = np.array([all(m.skips[s + 1 :]) for s in range(k)])
    before = [[q for q in range(s) if all(m.skips[q + 1 : s])] for s in range(k)]
    neg = -1e9
    score = np.where(may_open[seg][:, None], share[0], neg) if width else np.zeros((h, b))
    stay = np.arange(h, dtype=np.int32)[:, None]
    back, rows = np.empty((width, h, b), np.int32), np.arange(b)
    for t in range(1, width):
        top = [score[lo] if hi == lo + 1 else score[lo:hi].max(0) for lo, hi in bounds]
        who = [np.int32(lo) if hi == lo + 1 else score[lo:hi].argmax(0).astype(np.int32) + np.int32(lo) for lo, hi in bounds]
        best, source = score.copy(), back[t]
        source[:] = stay
        for s in range(k):
            if not before[s]:
                continue
            value, origin = top[before[s][0]], who[before[s][0]]
            for q in before[s][1:]:
                later = top[q] > value
                value, origin = np.where(later, top[q], value), np.where(later, who[q], origin)
            lo, hi = bounds[s]
            better = value > best[lo:hi]
            np.copyto(best[lo:hi], value, where=better)
            np.copyto(source[lo:hi], origin, where=better)
        best += share[t]
        live = t < n
        if not live.all():
            best, source[:, ~live] = np.where(live, best, score), stay
        score = best
    labels = np.zeros((b, width), np.int32)
    if width:
        labels[:, -1] = np.where(may_close[seg][:, None], score, score + neg).argmax(0)
    for t in range(width - 1, 0, -1):
        labels[:, t - 1] = back[t][labels[:, t], rows]
    return labels


@dataclass
class Labelled:
    """Of each read: the profile of every base, the confidence, and the log-likelihoods of model and random reads."""

    labels: list[np.ndarray]
    q: np.ndarray
    log_model: np.ndarray
    log_random: np.ndarray


def confidence(v: np.ndarray, log_model: np.ndarray, log_random: np.ndarray) -> np.ndarray:
    """-10 log10 of the probability that the labels are wrong."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        right = np.where(np.isneginf(log_model), 0.0, v / (1 + np.exp(np.minimum(log_random - log_model, 700))))
        return np.minimum(TOP_Q, np.where(right >= 1, TOP_Q, np.maximum(0.0, -10 * np.log10(np.maximum(1 - right, 1e-300)))))


#: Paths within a profile are given up where all that may still come of them is less than this part of what has left it by then.
_ROUNDING = 1e-16
#: Reads that are held against all profiles together.
_TAGGED = 256


class _TagThenRead:
    """Scores of layouts of one segment of alternatives and a read behind it: plates of barcodes.

    All paths begin with the first base and leave their profile once, and what follows is random bases.  So the posterior of
    a profile at a base is what leaves it there or later, times what that leaves for the read, over the total; steps back are not needed.
    Emissions are held against random ones.  Reads with a common beginning share its steps, and behind the
    length of a tag only those paths of each read and profile go on that can still count."""

    def __init__(self, m: Model) -> None:
        self.m, (_, block), self.null = m, m.blocks[0], m.null[:-1]
        self.k, self.w, _ = block.shape
        here = slice(0, self.k * self.w)
        random = np.append(m.background, m.background[4])
        self.step = block[0]
        self.start = m.start[here].reshape(self.k, self.w)
        self.emit = (m.emit[:, here] / random[:, None]).reshape(len(m.emit), self.k, self.w)
        self.flat = np.ascontiguousarray(self.emit.transpose(1, 0, 2)).reshape(-1, self.w)
        self.out = np.ascontiguousarray(m.out[: self.w, 1])
        self.more, self.size = float(m.blocks[1][1][0, 0, 1]), len(m.layout.segments[0].alternatives[0])
        #: An upper bound of what still leaves from each state.
        self.most = np.linalg.solve(np.eye(self.w) - self.step * self.emit.max((0, 1)), self.out)

    @staticmethod
    def fits(m: Model) -> bool:
        kinds = [seg.kind for seg in m.layout.segments]
        if len(kinds) != 2 or kinds[0] not in "BSF" or kinds[1] != "R" or len(m.blocks) != 2 or m.skips.any() or not (m.background > 0).all():
            return False
        (_, block), (lo, read) = m.blocks
        out = m.out[:lo].reshape(len(block), -1, m.out.shape[1])
        alike = (block == block[0]).all() and (out == out[0]).all() and not out[:, :, [0, 2]].any() and not m.into[1, :lo].any() and not m.end[:lo].any()
        return bool(alike) and read.shape == (1, 2, 2) and m.into[1, lo] == 1.0 and not m.start[lo:].any()

    def _leaving(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(bases, reads, profiles): what leaves each profile behind each base."""
        b, width = x.shape
        parts, group = [], np.zeros(b, np.int64)
        now = None
        for t in range(min(width, self.size + 1)):
            first, group = np.unique(group * CODES + x[:, t], return_index=True, return_inverse=True)[1:]
            if now is None:
                now = np.repeat(self.start[None], len(first), 0)
            else:
                now = (now[before[first]].reshape(-1, self.w) @ self.step).reshape(len(first), self.k, self.w)
            now *= self.emit[x[first, t]]
            parts.append((now @ self.out)[group])
            before = group
        if width <= self.size + 1:
            return np.stack(parts) if parts else np.zeros((0, b, self.k))
        left = np.sum(parts, axis=(0, 2)) * _ROUNDING
        bound = (now @ self.most)[group]
        t = self.size
        on = (bound > left[:, None]) & (t + 2 < n)[:, None]
        read, profile = np.nonzero(on)
        some = now[group[read], profile]
        both = np.stack([self.out, self.most], 1)
        while len(read):
            t += 1
            some = some @ self.step
            some *= self.flat[profile * CODES + x[read, t]]
            figures = some @ both
            gone = np.zeros((b, self.k))
            gone[read, profile] = figures[:, 0]
            parts.append(gone)
            on = np.flatnonzero((figures[:, 1] > left[read]) & (t + 2 < n[read]))
            read, profile, some = read[on], profile[on], some[on]
        return np.stack(parts)

    def score(self, seqs: list[str], decode: bool) -> list[tuple | None]:
        """Of each read: profiles, confidence and log-likelihoods; nothing where the layout cannot show the read."""
        m, (x, n) = self.m, encode(seqs)
        mass = self._leaving(x, n)
        rest = n - 2 - np.arange(len(mass))[:, None]  # bases of the read behind its first one
        mass *= np.where(rest >= 0, self.more ** np.maximum(rest, 0) * (1 - self.more), 0.0)[:, :, None]
        share = mass
        for t in range(len(share) - 2, -1, -1):
            share[t] += share[t + 1]
        total = share[0].sum(1) if len(share) else np.zeros(len(n))
        able = total > 0
        sure = np.where(able, total, 1.0)
        random = random_log_likelihood(m, x, n)
        a = max(m.average_length, 1.0 + 1e-9)
        with np.errstate(divide="ignore"):
            log = random - n * np.log(1 - 1 / a) - np.log(1 / a) + np.log(total)
        v = np.ones(len(n))
        if self.k > 1 and able.any():
            v = share[0][:, ~self.null].max(1) / sure
        q = confidence(np.minimum(v, 1), log, random)
        out: list[tuple | None] = [None] * len(n)
        if decode and able.any():
            share /= sure[:, None]
            read, so_far = 1 - share.sum(2), share
            for t in range(1, len(share)):
                so_far[t] += so_far[t - 1]
            # the read begins behind base c; later bases count for it, as do all that no profile has
            value = so_far.max(2) + (read.sum(0) - np.cumsum(read, axis=0))
            value[np.arange(len(share))[:, None] > n - 2] = -np.inf
            c = value.argmax(0)
            best = so_far[c, np.arange(len(n))].argmax(1)
        for i in np.flatnonzero(able).tolist():
            labels = np.zeros(n[i], np.int32)
            if decode:
                labels[: c[i] + 1], labels[c[i] + 1 :] = best[i], self.k
            out[i] = labels, q[i], log[i], random[i]
        return out


def _label_tags(m: Model, seqs: list[str], decode: bool) -> list[tuple]:
    tags, out = _TagThenRead(m), [None] * len(seqs)
    order = sorted(range(len(seqs)), key=seqs.__getitem__)  # neighbours begin alike
    longest = max(map(len, seqs), default=0)
    many = min(_TAGGED, max(1, 4 * _CELLS // max(1, longest * tags.k)))
    for at in range(0, len(order), many):
        some = order[at : at + many]
        for i, got in zip(some, tags.score([seqs[i] for i in some], decode), strict=True):
            out[i] = got
    odd = [i for i, got in enumerate(out) if got is None]
    for i, got in zip(odd, _label_any(m, [seqs[i] for i in odd], decode), strict=True):
        out[i] = got
    return out


def _label_any(m: Model, seqs: list[str], decode: bool) -> Sequence[tuple]:
    def run(part: list[str]) -> list[tuple]:
        x, n = encode(part)
        share, entered, log = posterior(m, x, n)
        v = np.ones(len(part))
        for s in range(len(m.skips)):
            mine = m.segment == s
            if mine.sum() > 1:
                total = entered[:, mine].sum(1)
                top = entered[:, mine & ~m.null].max(1)
                v *= np.where(total > 0, top / np.where(total > 0, total, 1), 0)
        random = random_log_likelihood(m, x, n)
        q = confidence(np.minimum(v, 1), log, random)
        labels = best_path(m, share, n) if decode else np.zeros(x.shape, np.int32)
        return [(labels[i, : n[i]], q[i], log[i], random[i]) for i in range(len(part))]

    return _by_length(seqs, run, object, len(m.start))


def label(m: Model, seqs: list[str], decode: bool = True) -> Labelled:
    """Score all reads, and label their bases unless only confidences are wanted."""
    out = (_label_tags if _TagThenRead.fits(m) else _label_any)(m, seqs, decode)
    return Labelled([o[0] for o in out], *(np.array([o[k] for o in out], float) for k in (1, 2, 3)))


# -- approximate search and overlap -----------------------------------------------------------------


def _codes(seq: str) -> np.ndarray:
    return _LUT[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def search_distance(pattern: str, text: str, to_end: bool = False) -> int:
    """Least edit distance of the pattern to any part of the text, or to one that ends with it.

    A column of the alignment is two numbers with a bit for each base of the pattern: where the distance grows by one from
    the base before, and where it shrinks."""
    places = [0] * (_NO_CODE + 1)
    for k, c in enumerate(_codes(pattern).tolist()):
        places[c] |= 1 << k
    n = len(pattern)
    every, last = (1 << n) - 1, 1 << n >> 1
    up, down, now, best = every, 0, n, n
    for c in _codes(text).tolist():
        same = places[c]
        level = (((same & up) + up) ^ up) | same
        more, less = down | (every & ~(level | up)), up & level
        now += bool(more & last) - bool(less & last)
        best = min(best, now)
        more, less, same = more << 1 & every, less << 1 & every, same | down
        up, down = less | (every & ~(same | more)), more & same
    return now if to_end else best


#: Stands for every code that fits no base; its bits are never set.
_NO_CODE = 6
#: Bases of a read that fit the bits of one number.
_WORD = 64


def _bits(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(codes, reads): a bit for each place where the read has the code."""
    bit = np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64)
    out = np.zeros((_NO_CODE + 1, len(x)), np.uint64)
    live = np.arange(x.shape[1]) < n[:, None]
    for c in range(_NO_CODE):
        out[c] = np.where((x == c) & live, bit, np.uint64(0)).sum(1, dtype=np.uint64)
    return out


def _search_bits(columns: Iterable[np.ndarray], n: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """As ``search_distance`` for many reads of at most 64 bases: of each base of the texts, the places with it in every read.

    With ``ends``, the lengths of the texts, to a part that ends with the text."""
    up, down = np.full(len(n), ~np.uint64(0)), np.zeros(len(n), np.uint64)
    last = np.where(n > 0, np.uint64(1) << np.maximum(n - 1, 0).astype(np.uint64), np.uint64(0))
    now, best = n.astype(np.int64), n.astype(np.int64)
    one, at_end = np.uint64(1), best.copy()
    for done, same in enumerate(columns, 1):
        level = same & up
        level += up
        level ^= up
        level |= same
        more = level | up
        np.invert(more, out=more)
        more |= down
        level &= up  # where the row shrinks
        now += (more & last).astype(bool)
        now -= (level & last).astype(bool)
        np.minimum(best, now, out=best)
        if ends is not None:
            np.copyto(at_end, now, where=ends == done)
        more <<= one
        level <<= one
        down |= same
        up = down | more
        np.invert(up, out=up)
        up |= level
        down &= more
    return best if ends is None else at_end


def _search_rows(x: np.ndarray, n: np.ndarray, columns: Iterable[np.ndarray]) -> np.ndarray:
    """The same for reads of any length, from whole columns of distances."""
    b, width = x.shape
    steps = np.arange(width + 1)
    row = np.broadcast_to(steps, (b, width + 1)).copy()
    best, rows = n.astype(np.int64), np.arange(b)
    for c in columns:
        new = np.empty_like(row)
        new[:, 0] = 0
        new[:, 1:] = np.minimum(row[:, :-1] + (x != c), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        best = np.minimum(best, row[rows, n])
    return best


def search_many(x: np.ndarray, n: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edit distance of each read (rows of codes, with lengths) to any part of one text."""
    if x.shape[1] > _WORD:
        return _search_rows(x, n, text)
    bits = _bits(x, n)
    return _search_bits((bits[c] for c in np.minimum(text, _NO_CODE)), n)


def search_windows(x: np.ndarray, n: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Least edit distance of each read (rows of codes, with lengths) to any part of its own window (rows of codes)."""
    if x.shape[1] > _WORD:
        return _search_rows(x, n, (windows[:, k : k + 1] for k in range(windows.shape[1])))
    bits, rows = _bits(x, n).ravel(), np.arange(len(x))
    codes = np.minimum(windows, _NO_CODE).T
    return _search_bits((bits[c * len(x) + rows] for c in codes.astype(np.int64)), n)


#: Bases of texts that are searched together.
_TEXT_CELLS = 4_000_000


def search_pairs(patterns: list[str], texts: list[str], to_end: bool = False) -> np.ndarray:
    """``search_distance`` of each pattern and its own text; texts of like lengths are searched together."""
    out, size = np.zeros(len(patterns), np.int64), np.fromiter(map(len, texts), np.int64, len(texts))
    short = np.fromiter((len(p) <= _WORD for p in patterns), bool, len(patterns))
    for k in np.flatnonzero(~short).tolist():
        out[k] = search_distance(patterns[k], texts[k], to_end)
    left = np.flatnonzero(short)
    left = left[np.argsort(size[left], kind="stable")]
    while len(left):
        fit = np.arange(1, len(left) + 1) * size[left] <= _TEXT_CELLS
        some, left = np.split(left, [max(int(fit.sum()), 1)])
        x, n = encode([patterns[k] for k in some])
        codes, width = encode([texts[k] for k in some])
        codes[np.arange(codes.shape[1]) >= width[:, None]] = _NO_CODE  # behind the text nothing comes nearer
        bits, rows = _bits(x, n).ravel(), np.arange(len(some))
        out[some] = _search_bits((bits[c * len(some) + rows] for c in codes.T.astype(np.int64)), n, width if to_end else None)
    return out


def right_probability(qual: str | None, n: int) -> np.ndarray:
    """Of every base: the probability that it is right."""
    if not qual:
        return np.full(n, 0.999)
    return 1 - 10.0 ** (-(np.frombuffer(qual.encode("latin-1"), np.uint8).astype(float) - 33) / 10)


def _spread(codes: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(length, 4): the probability of each base; even for those that are none."""
    out = np.repeat(((1 - right) / 3)[:, None], 4, 1)
    known = codes < 4
    out[known, codes[known]] = right[known]
    out[~known] = 0.25
    return np.maximum(out, 1e-12)


Merged = tuple[str, str, float, int]


def overlap(seq_a: str, qual_a: str | None, seq_b: str, qual_b: str | None, least: int = 16, identity: float = 0.0) -> Merged | None:
    """Merge one read with its mate; see ``overlaps``."""
    return overlaps([(seq_a, qual_a, seq_b, qual_b)], least, identity)[0]


#: Numbers in one array of pairs that are merged together.
_PAIR_CELLS = 1_000_000


def overlaps(pairs: list[tuple[str, str | None, str, str | None]], least: int = 16, identity: float = 0.0) -> list[Merged | None]:
    """Merge reads with their mates (already reverse-complemented): (bases, qualities, identity, offset) each, or nothing.

    Every offset without gaps whose overlap is longer than ``least`` is scored by the likelihood that both
    reads show the same bases; the first best one wins.  Tails that do not overlap are kept.  Pairs of like lengths are
    scored together."""
    out: list[Merged | None] = [None] * len(pairs)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (a, _, b, _) in enumerate(pairs):
        if min(len(a), len(b)) > least:
            groups.setdefault((len(a), len(b)), []).append(k)
    for (la, lb), members in groups.items():
        many = max(1, _PAIR_CELLS // (la * lb))
        for at in range(0, len(members), many):
            some = members[at : at + many]
            for k, got in zip(some, _overlaps([pairs[k] for k in some], la, lb, least), strict=True):
                out[k] = got if got and got[2] >= identity else None
    return out


def _overlaps(pairs: list[tuple[str, str | None, str, str | None]], la: int, lb: int, least: int) -> list[Merged | None]:
    raw = [np.frombuffer("".join(p[k] for p in pairs).encode("latin-1", "replace"), np.uint8).reshape(len(pairs), -1) for k in (0, 2)]
    qual = [np.frombuffer("".join(p[k] or "I" * n for p in pairs).encode("latin-1", "replace"), np.uint8).reshape(len(pairs), -1) for k, n in ((1, la), (3, lb))]
    code = [_LUT[x] for x in raw]
    odds = [_spread(c.ravel(), np.concatenate([right_probability(p[k], n) for p in pairs])).reshape(len(pairs), n, 4) for c, k, n in ((code[0], 1, la), (code[1], 3, lb))]
    both = np.log(odds[0] @ odds[1].transpose(0, 2, 1))
    best, shift = np.full(len(pairs), -np.inf), np.zeros(len(pairs), int)
    for d in range(-(lb - 1), la):
        size = min(la - d, lb) if d >= 0 else min(lb + d, la)
        if size > least:
            score = np.diagonal(both, -d, 1, 2)[:, :size].sum(1)
            better = score > best + 1e-12
            best, shift = np.where(better, score, best), np.where(better, d, shift)
    out: list[Merged | None] = [None] * len(pairs)
    for d in np.unique(shift[best > -np.inf]).tolist():
        who = np.flatnonzero((shift == d) & (best > -np.inf))
        lo, hi = min(0, d), max(la, d + lb)
        bases, quals = np.zeros((len(who), hi - lo), np.uint8), np.zeros((len(who), hi - lo), np.uint8)
        for whole, sides in ((bases, raw), (quals, qual)):
            whole[:, d - lo : d - lo + lb] = sides[1][who]
            whole[:, -lo : la - lo] = sides[0][who]
        i, j = max(0, d), min(la, d + lb)  # what both have, by the first read's places
        a, b = slice(i, j), slice(i - d, j - d)
        differ = code[0][who, a] != code[1][who, b]
        take = differ & (odds[1].max(2)[who, b] > odds[0].max(2)[who, a])
        bases[:, i - lo : j - lo] = np.where(take, raw[1][who, b], raw[0][who, a])
        quals[:, i - lo : j - lo] = np.maximum(qual[0][who, a], qual[1][who, b])
        share = 1 - differ.sum(1) / (j - i)
        for k, x, q, same in zip(who.tolist(), bases, quals, share.tolist(), strict=True):
            out[k] = x.tobytes().decode("latin-1"), q.tobytes().decode("latin-1"), same, d
    return out
