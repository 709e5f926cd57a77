"""Re-estimate a model from reads (Baum-Welch).

Executors add up expected counts per partition; counts of one name and place are summed by Spark, so what
comes to the driver has the size of the model (states times the width of a profile), whatever the number of reads.  Likelihoods never fall from
one round to the next, which also makes this a check of the forward and backward sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans import kernel
from ..plans.model import Model


def weights(m: Model) -> list[np.ndarray]:
    """All that is estimated: starts, ends, emissions, steps from states to places and from places to states, and those within profiles."""
    return [m.start, m.end, m.emit, m.out, m.into, *(block for _, block in m.blocks)]


def expected(m: Model, seqs: list[str]) -> tuple[list[np.ndarray], float]:
    """Expected uses of each weight over reads, and their log-likelihood."""
    counts = [np.zeros_like(a) for a in weights(m)]
    start, end, emit, out, into, *within = counts
    total = 0.0
    for at in range(0, len(seqs), 256):
        x, n = kernel.encode(seqs[at : at + 256])
        alpha, scale, log = kernel.forward(m, x, n)
        good = np.isfinite(log)
        if not good.any():
            continue
        beta = kernel.backward(m, x, n, alpha, scale)
        total += log[good].sum()
        post = alpha * beta
        rows = np.arange(len(n))
        start += post[0, good].sum(0)
        end += post[np.maximum(n - 1, 0), rows][good].sum(0)
        for t in range(x.shape[1]):
            live = good & (t < n)
            np.add.at(emit, x[live, t], post[t, live])
            on = good & (t + 1 < n)
            if t + 1 < x.shape[1] and on.any():
                now, ahead = alpha[t, on], m.emit[x[on, t + 1]] * beta[t + 1, on] / scale[t + 1, on][:, None]
                out += m.out * (now.T @ (ahead @ m.into.T))
                into += m.into * ((now @ m.out).T @ ahead)
                for (lo, block), count in zip(m.blocks, within, strict=True):
                    h, w, _ = block.shape
                    part = lambda a: a[:, lo : lo + h * w].reshape(-1, h, w)  # noqa: B023, E731
                    count += block * (part(now).transpose(1, 2, 0) @ part(ahead).transpose(1, 0, 2))
    return counts, total


def _share(a: np.ndarray, old: np.ndarray, axis: int) -> np.ndarray:
    total = a.sum(axis, keepdims=True)
    return np.where(total > 0, a / np.where(total > 0, total, 1), old)


def updated(m: Model, counts: list[np.ndarray], pseudo: float = 1e-3) -> Model:
    """The model with the most likely weights given expected counts; what was impossible stays so."""
    start, end, emit, out, into, *within = counts
    # what a place leads to adds up to 1; what it lacked there is less likely to be left for
    reach = m.into.sum(1)
    old_into = m.into / np.where(reach > 0, reach, 1)[:, None]
    old = [m.out * reach, m.end[:, None], *(block.reshape(-1, block.shape[2]) for _, block in m.blocks)]
    new = [out + pseudo * old[0], end[:, None] + pseudo * old[1], *(c.reshape(-1, c.shape[2]) + pseudo * o for c, o in zip(within, old[2:], strict=True))]
    blocks, total, before = [], new[0].sum(1) + new[1][:, 0], old[0].sum(1) + old[1][:, 0]
    for (lo, _), a, o in zip(m.blocks, new[2:], old[2:], strict=True):
        total[lo : lo + len(a)] += a.sum(1)
        before[lo : lo + len(a)] += o.sum(1)
    factor = np.where(total > 0, before / np.where(total > 0, total, 1), 0)[:, None]
    kept = lambda a, o, f: np.where(f > 0, a * f, o)
    for (lo, block), a, o in zip(m.blocks, new[2:], old[2:], strict=True):
        blocks.append((lo, kept(a, o, factor[lo : lo + len(a)]).reshape(block.shape)))
    codes = emit[:5] + emit[5:] * np.eye(5)[4][:, None]  # the dot counts as N
    emitted = _share(codes + pseudo * m.emit[:5], m.emit[:5], 0)
    return replace(
        m, start=_share(start + pseudo * m.start, m.start, 0) * m.start.sum(), blocks=blocks, out=kept(new[0], old[0], factor), into=_share(into + pseudo * old_into, old_into, 1),
        end=kept(new[1], old[1], factor)[:, 0], emit=np.concatenate((emitted, emitted[4:])), advantage=np.inf,
    )


def train(reads: DataFrame, m: Model, rounds: int = 5) -> tuple[Model, list[float]]:
    """The model after some rounds over all reads, and the log-likelihood before each."""
    shapes = [a.shape for a in weights(m)]
    sizes = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
    likelihoods = []
    for _ in range(rounds):
        shared = reads.sparkSession.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            flat = np.zeros(int(sizes[-1]) + 1)
            for batch in batches:
                parts, log = expected(shared.value, [s for s in batch.column(0).to_pylist() if s])
                flat += np.concatenate([*(p.ravel() for p in parts), [log]])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at], pa.float64())], ["at", "n"])

        rows = reads.select("seq").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
        flat = np.zeros(int(sizes[-1]) + 1)
        for r in rows:
            flat[r["at"]] = r["n"]
        likelihoods.append(float(flat[-1]))
        m = updated(m, [flat[a:b].reshape(s) for a, b, s in zip(sizes, sizes[1:], shapes, strict=False)])
    return m, likelihoods
