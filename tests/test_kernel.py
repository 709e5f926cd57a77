"""The kernel against enumeration, closed forms and itself."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from readloom.plans import kernel as K, layout as L
from readloom.plans.model import Options, Stats, build, expected_read

STATS = Stats((0.27, 0.24, 0.22, 0.26, 0.01), 38, 40, mean_5=5, sd_5=2, mean_3=4, sd_3=2)
LAYOUTS = ["B:ACAGTG,ACTTGA,TTAGGC R:N", "R:N", "P:ACGTAC B:ACAG,TTGA S:GGG F:NNN O:T R:N P:TTGACA", "G:GGG R:N", "B:ACGT R:N P:ACAC R:N"]


def enumerate_paths(m, codes):
    """P(x | M) and the posterior of every state, over all paths of emitting states."""
    states, total = range(len(m.start)), 0.0
    post = np.zeros((len(codes), len(m.start)))
    for path in itertools.product(states, repeat=len(codes)):
        p = m.start[path[0]] * m.emit[codes[0], path[0]]
        for a, b, c in zip(path, path[1:], codes[1:], strict=False):
            p *= m.step[a, b] * m.emit[c, b]
            if not p:
                break
        p *= m.end[path[-1]]
        total += p
        for t, s in enumerate(path):
            post[t, s] += p
    return total, post / total


@pytest.mark.parametrize("words", LAYOUTS)
def test_weights_add_up(words):
    m = build(L.parse(words), STATS, Options())
    assert np.allclose(m.step.sum(1) + m.end, 1)
    assert m.start.sum() == pytest.approx(1, abs=0.3)


@pytest.mark.parametrize("seq", ["AC", "ACT", "GATN"])
def test_forward_and_backward_equal_enumeration(seq):
    m = build(L.parse("F:AC O:T"), STATS, Options())
    x, n = K.encode([seq])
    alpha, scale, log = K.forward(m, x, n)
    total, post = enumerate_paths(m, x[0])
    assert math.exp(log[0]) == pytest.approx(total)
    assert np.allclose((alpha * K.backward(m, x, n, alpha, scale))[:, 0], post)


def test_mass_of_all_short_reads_is_below_one():
    m = build(L.parse("F:AC O:T"), STATS, Options())
    seqs = ["".join(s) for n in range(1, 5) for s in itertools.product("ACGTN", repeat=n)]
    assert 0.8 < np.exp(K.log_likelihood(m, seqs)).sum() <= 1


def test_closed_form_of_a_plain_read():
    m, seq = build(L.parse("R:N"), STATS, Options()), "ACGTTNA"
    length = expected_read(m.layout, STATS.average_length)
    want = sum(math.log(STATS.background["ACGTN".index(c)]) for c in seq) + 6 * math.log(1 - 1 / length) + math.log(1 / length)
    assert K.log_likelihood(m, [seq])[0] == pytest.approx(want)


def test_result_does_not_depend_on_the_batch():
    m = build(L.parse(LAYOUTS[0]), STATS, Options())
    rng = np.random.default_rng(1)
    seqs = ["".join(rng.choice(list("ACGTN"), n)) for n in rng.integers(0, 60, 40)]
    together = K.label(m, seqs)
    for i, s in enumerate(seqs):
        alone = K.label(m, [s])
        assert np.array_equal(alone.labels[0], together.labels[i])
        assert alone.q[0] == pytest.approx(together.q[i], abs=1e-9)


def test_permuted_barcodes_permute_assignments():
    seqs = ["ACAGTGGATTACAGATTACAGATTACA", "TTAGGCGATTACAGATTACAGATTACA", "ACTTGCGATTACAGATTACAGATTACA"]
    a = build(L.parse("B:ACAGTG,ACTTGA,TTAGGC R:N"), STATS, Options())
    b = build(L.parse("B:TTAGGC,ACAGTG,ACTTGA R:N"), STATS, Options())
    code = lambda m: [m.layout.segments[0].alternatives[m.alternative[x[0]]] for x in K.label(m, seqs).labels]
    assert code(a) == code(b) == ["ACAGTG", "TTAGGC", "ACTTGA"]


def test_empty_and_odd_reads():
    m = build(L.parse(LAYOUTS[0]), STATS, Options())
    got = K.label(m, ["", "N" * 30, "acagtg" + "x" * 20, "..."])
    assert [len(x) for x in got.labels] == [0, 30, 26, 3]
    assert got.q[0] == 0 and (got.q >= 0).all() and (got.q <= K.TOP_Q).all()


def slow_distance(p, t, to_end):
    best = len(p)
    for i in range(len(t) + 1):
        for j in range(i, len(t) + 1):
            if not to_end or j == len(t):
                best = min(best, L.edit_distance(p, t[i:j]))
    return best


@pytest.mark.parametrize("to_end", [False, True])
def test_search_distance(to_end):
    rng = np.random.default_rng(2)
    for _ in range(40):
        p, t = ("".join(rng.choice(list("ACGT"), n)) for n in (rng.integers(1, 6), rng.integers(0, 9)))
        assert K.search_distance(p, t, to_end) == slow_distance(p, t, to_end)


def test_search_many_equals_one_by_one():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("ACGT"), 50))
    seqs = ["".join(rng.choice(list("ACGT"), n)) for n in rng.integers(1, 20, 30)]
    x, n = K.encode(seqs)
    assert K.search_many(x, n, K.encode([text])[0][0]).tolist() == [K.search_distance(s, text) for s in seqs]


@pytest.mark.parametrize("longest", [1, 20, 63, 64, 65, 150])
def test_bits_equal_whole_columns(longest):
    rng = np.random.default_rng(longest)
    make = lambda n: "".join(rng.choice(list("ACGTN."), n, p=[0.3, 0.3, 0.2, 0.1, 0.05, 0.05]))
    seqs = ["", "A" * longest, *[make(n) for n in rng.integers(0, longest + 1, 60)]]
    windows = K.encode([make(100) for _ in seqs])[0]
    for k in range(0, len(seqs), 2):  # most windows hold the read, with few errors
        part = K.encode([seqs[k]])[0][0].copy()
        part[rng.integers(0, max(len(part), 1), 2)[: len(part)]] = 0
        windows[k, 5 : 5 + len(part)] = part[:95]
    windows[:, 0] = 9  # fits nothing
    x, n = K.encode(seqs)
    want = K._search_rows(x, n, (windows[:, k : k + 1] for k in range(100)))
    assert K.search_windows(x, n, windows).tolist() == want.tolist()
    assert K.search_many(x, n, windows[1]).tolist() == K._search_rows(x, n, windows[1]).tolist()
    letters = np.array(list("ACGTN.    x"))
    assert [K.search_distance(s, "".join(letters[w[1:]])) for s, w in zip(seqs, windows, strict=True)] == want.tolist()
    assert K.search_windows(x, n, windows[:, :0]).tolist() == n.tolist()
    assert len(K.search_windows(x[:0], n[:0], windows[:0])) == 0


@pytest.mark.parametrize("to_end", [False, True])
def test_search_distance_of_long_and_odd_texts(to_end):
    rng = np.random.default_rng(9)
    for n, size in ((70, 90), (130, 40), (0, 5), (5, 0)):
        p, t = ("".join(rng.choice(list("ACGT"), k)) for k in (n, size))
        assert K.search_distance(p, t, to_end) == slow_distance(p, t, to_end)
    assert K.search_distance("\ud800\u00e9", "NN", to_end) == 0  # letters that are no bases are alike


@pytest.mark.parametrize("to_end", [False, True])
def test_pairs_equal_one_by_one(to_end, monkeypatch):
    rng = np.random.default_rng(12)
    make = lambda n: "".join(rng.choice(list("ACGTN"), n))
    patterns = ["", "ACGT", "\u00e9\ud800", *[make(n) for n in rng.integers(0, 70, 200)]]
    texts = ["ACGT", "", "NN", *[make(n) for n in rng.integers(0, 120, 200)]]
    want = [K.search_distance(p, t, to_end) for p, t in zip(patterns, texts, strict=True)]
    assert K.search_pairs(patterns, texts, to_end).tolist() == want
    monkeypatch.setattr(K, "_TEXT_CELLS", 300)
    assert K.search_pairs(patterns, texts, to_end).tolist() == want
    assert K.search_pairs([], [], to_end).tolist() == []


def test_overlap():
    a, b = "ACGTACGTTTGACCATTGACAGG", "TTTGACCATTGACAGGCCCTTA"
    seq, qual, share, at = K.overlap(a, None, b, None, 10)
    assert (seq, share, at) == ("ACGTACGTTTGACCATTGACAGGCCCTTA", 1.0, 7) and len(qual) == len(seq)
    assert K.overlap("ACGT", None, "ACGT", None, 16) is None
    assert K.overlap("ACGTACGT", "IIIIIII!", "ACGTACGA", "IIIIIIII", 4)[0] == "ACGTACGA"


def test_long_reads_go_in_small_batches(monkeypatch):
    m = build(L.parse(LAYOUTS[0]), STATS, Options())
    seqs = ["ACAGTG" + "GATTACA" * k for k in (1, 30, 3, 200)]
    want = K.label(m, seqs)
    monkeypatch.setattr(K, "_CELLS", 1000)
    got = K.label(m, seqs)
    assert all(np.array_equal(a, b) for a, b in zip(want.labels, got.labels, strict=True)) and np.allclose(want.q, got.q)


def test_pairs_merge_alike_together_and_alone():
    import random

    r = random.Random(5)
    pairs = []
    for _ in range(120):
        whole = "".join(r.choice("ACGT") for _ in range(r.choice((40, 60))))
        a, b = whole[: r.choice((30, 36))], whole[-r.choice((30, 36)) :]
        b = "".join(r.choice("ACGTN") if r.random() < 0.05 else c for c in b)
        q = lambda s: None if r.random() < 0.2 else "".join(chr(33 + r.randint(2, 40)) for _ in s)
        pairs.append((a, q(a), b, q(b)))
    pairs += [("", None, "ACGT", None), ("ACGT", "IIII", "", None), ("ACGTACGTACGTACGTACGT", None, "ACGTACGTACGTACGTACGT", None)]
    got = K.overlaps(pairs, 10)
    assert got == [K.overlap(*p, 10) for p in pairs] and sum(x is not None for x in got) > 100
    for (a, qa, b, qb), found in zip(pairs, got, strict=True):
        best = None
        spread = lambda s, q: K._spread(K._LUT[np.frombuffer(s.encode(), np.uint8)], K.right_probability(q, len(s)))
        pa, pb = (spread(s, q) if s else np.zeros((0, 4)) for s, q in ((a, qa), (b, qb)))
        for d in range(-len(b) + 1, len(a)):
            both = [(i, i - d) for i in range(len(a)) if 0 <= i - d < len(b)]
            if len(both) > 10:
                score = sum(np.log(pa[i] @ pb[j]) for i, j in both)
                if best is None or score > best[0] + 1e-9:
                    best = score, d, sum(a[i] == b[j] for i, j in both) / len(both)
        assert (found is None) == (best is None)
        if best:
            assert found[3] == best[1] and len(found[0]) == len(found[1]) == max(len(a), best[1] + len(b)) - min(0, best[1])
            if "N" not in b:
                assert abs(found[2] - best[2]) < 1e-9


def dense(m, x):
    """Posteriors (length, states) and log P(x | M) of one read, by products with the whole step matrix."""
    step, alpha, beta, log = m.step, [], [m.end], 0.0
    for t, c in enumerate(x):
        now = (alpha[-1] @ step if t else m.start) * m.emit[c]
        log += math.log(now.sum())
        alpha.append(now / now.sum())
    for c in x[:0:-1]:
        now = step @ (beta[0] * m.emit[c])
        beta.insert(0, now / now.max())
    if not alpha[-1] @ m.end > 0:
        return np.zeros((len(x), len(m.start))), -math.inf
    post = np.array(alpha) * np.array(beta)
    return post / post.sum(1, keepdims=True), log + math.log(alpha[-1] @ m.end)


MANY = ["".join("ACGT"[(i >> k & 3) ^ (k > 6 and i & 3)] for k in (0, 2, 4, 6, 8, 6, 4, 2)) for i in range(0, 960, 10)]
SHAPES = [
    "P:ACGTAC B:ACAG,TTGA S:GGG F:NNN O:T R:N P:TTGACA", "G:GGG R:N", "O:N B:ACAGTG,ACTTGA S:GGG R:N", "B:" + ",".join(MANY) + " R:N",
    "R:N S:GATT R:N", "F:AC O:T", "S:ACGTACGT,ACGTTTTT B:AC,GT R:N P:ACGTACGTACGT", "B:ACAGTG,ACTTGA S:GATTCA F:NNNN",
]


@pytest.mark.parametrize("words", SHAPES)
def test_blocks_equal_the_dense_product(words):
    m = build(L.parse(words), STATS, Options())
    rng = np.random.default_rng(8)
    heads = ["", "ACAG", "ACAGTG", MANY[17], "TTGAGGGACG", "GGG"]
    seqs = [heads[k % len(heads)] + "".join(rng.choice(list("ACGTN"), k)) for k in (1, 4, 9, 15, 30, 30, 90)]
    x, n = K.encode(seqs)
    share, entered, log = K.posterior(m, x, n)
    alpha, scale, log_2 = K.forward(m, x, n)
    for i, k in enumerate(n.tolist()):
        post, want = dense(m, x[i, :k])
        groups = (m.profile[:, None] == np.arange(len(m.segment))).astype(float)
        if math.isinf(want):
            assert log[i] == want and log_2[i] == want
            continue
        assert log[i] == pytest.approx(want, abs=1e-9) and log_2[i] == pytest.approx(want, abs=1e-9) and K.log_likelihood(m, [seqs[i]])[0] == pytest.approx(want, abs=1e-9)
        assert np.allclose(share[:k, i], post @ groups, atol=1e-9) and not share[k:, i].any()
        assert np.allclose(entered[i], post[:, m.entry].sum(0) @ groups[m.entry], atol=1e-9)
    known = (np.arange(x.shape[1])[:, None] < n) & np.isfinite(log)
    assert known.any() and np.allclose((alpha * K.backward(m, x, n, alpha, scale)).sum(2)[known], 1)


def test_barcodes_are_given_up_in_long_reads_only_behind_their_place():
    m = build(L.parse(SHAPES[3]), STATS, Options())
    seqs = [MANY[k] + "GATTACA" * 12 for k in range(0, 96, 7)]
    steps = K._Steps(m)
    alpha, *_ = K._forward(steps, *K.encode(seqs))
    firsts = [lo for lo, _ in alpha]
    assert firsts[:8] == [0] * 8 and 0 < firsts[-1] == steps.read.start and firsts == sorted(firsts)
    assert [m.alternative[x[0]] for x in K.label(m, seqs).labels] == list(range(0, 96, 7))
