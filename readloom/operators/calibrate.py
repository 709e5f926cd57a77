"""Find the confidence threshold that separates reads of the layout from random ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans import kernel
from ..plans.model import Model, Options

#: The threshold is never higher.
MOST = 20.0


class Sampler:
    """Draws reads from a model without its null alternatives, each with at least so many bases.

    A table says how likely at least k more bases follow each state; every step is drawn by its weight times what that table
    says of where it leads, so reads come from the right distribution and none is drawn again.  Where the layout has no
    read so long at all, its longest are drawn."""

    def __init__(self, m: Model, least: int) -> None:
        self.m, states = m, len(m.start)
        allowed = ~m.null[m.profile]
        width = max(block.shape[1] for _, block in m.blocks)
        self.next, inner = np.zeros((states, width), np.int64), np.zeros((states, width))
        for lo, block in m.blocks:
            h, w, _ = block.shape
            at = lo + np.arange(h * w)
            self.next[at, :w] = np.repeat(lo + np.arange(h * w).reshape(h, w), w, 0)
            inner[at, :w] = block.reshape(h * w, w)
        self.into = m.into * allowed
        total = np.maximum(inner.sum(1) + m.out @ self.into.sum(1) + m.end, 1e-300)[:, None]
        self.inner, self.out, self.end = inner / total, m.out / total, m.end / total[:, 0]
        self.alive = [np.ones(states)]
        while len(self.alive) < least:
            now = self.alive[-1]
            new = (self.inner * now[self.next]).sum(1) + self.out @ (self.into @ now)
            if not (self.into[0] * new).sum() > 0:
                break
            self.alive.append(new / new.max())
        self.bases = np.cumsum(m.emit[:5].T, axis=1)
        self.bases /= self.bases[:, -1:]

    def _table(self, more: int) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of each state's choices (a state within, a place to leave for, the end), and of the states that each place leads to, where so many bases have to follow."""
        after = self.alive[more - 1] if more else np.ones(len(self.next))
        into = self.into * after
        choices = (self.inner * after[self.next], self.out * into.sum(1), self.end[:, None] * (more == 0))
        return np.cumsum(np.concatenate(choices, 1), axis=1), np.cumsum(into, axis=1)

    def draw(self, rng: np.random.Generator, n: int) -> list[str]:
        """n reads; all of them a base at a time."""
        letters, width, more = np.frombuffer(b"ACGTN", np.uint8), self.next.shape[1], len(self.alive) - 1
        start = np.cumsum(self.into[0] * self.alive[more])
        state = np.searchsorted(start, rng.random(n) * start[-1], side="right")
        live, columns, length = np.arange(n), [], np.zeros(n, np.int64)
        free = self._table(0)
        while len(live):
            column = np.zeros(n, np.uint8)
            column[live] = letters[np.minimum((self.bases[state] <= rng.random((len(live), 1))).sum(1), 4)]
            columns.append(column)
            length[live] += 1
            choices, places = self._table(more) if more else free
            mine = choices[state]
            pick = (mine <= rng.random((len(live), 1)) * mine[:, -1:]).sum(1)
            new = self.next[state, np.minimum(pick, width - 1)]
            for p in range(len(places)):
                leaving = np.flatnonzero(pick == width + p)
                new[leaving] = np.searchsorted(places[p], rng.random(len(leaving)) * places[p, -1], side="right")
            on = pick < width + len(places)
            live, state, more = live[on], new[on], max(0, more - 1)
        rows = np.stack(columns, 1)
        return [rows[k, :x].tobytes().decode() for k, x in enumerate(length.tolist())]


def emit_random_many(m: Model, rng: np.random.Generator, n: int, least: int) -> list[str]:
    """n reads of independent bases and geometric length, each at least so long."""
    length = least + rng.geometric(1 / max(m.average_length, 2), n) - 1
    flat = np.frombuffer(b"ACGTN", np.uint8)[rng.choice(5, int(length.sum()), p=m.background / m.background.sum())].tobytes().decode()
    ends = np.cumsum(length).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def sweep(scored: DataFrame) -> DataFrame:
    """(q, sensitivity, specificity) of every threshold over scored reads (q, is_real).

    Confidences lie between 0 and 40 and are rounded to two places, so the running sums have a few thousand rows at most."""
    by_q = scored.groupBy(F.round("q", 2).alias("q")).agg(F.sum(F.col("is_real").cast("int")).alias("real"), F.sum((~F.col("is_real")).cast("int")).alias("random"))
    down = Window.orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tp, fp = F.sum("real").over(down), F.sum("random").over(down)
    return by_q.select("q", (tp / F.sum("real").over(every)).alias("sensitivity"), (1 - fp / F.sum("random").over(every)).alias("specificity"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """One row (q, sensitivity, specificity): the greatest threshold at which both add up to most; none above ``MOST``."""
    value = F.round(F.col("sensitivity") + F.col("specificity"), 12)
    return sweep(scored).orderBy(F.desc(value), F.desc("q")).limit(1).select(F.least("q", F.lit(MOST)).alias("q"), "sensitivity", "specificity")


#: Simulated reads of one kind that are drawn together.
_BLOCK = 1000


def simulated(spark: SparkSession, m: Model, o: Options = Options()) -> DataFrame:
    """(q, is_real): confidences of reads drawn from the model and of as many random ones, none shorter than the average read.

    Every block of reads has a generator of its own, so they do not depend on partitions."""
    half, least = max(1, o.calibration_reads // 2), int(m.average_length)
    blocks = -(-half // _BLOCK)
    shared = spark.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(shared.value, least)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rng, real = np.random.default_rng((o.seed, k)), k < blocks
                n = min(_BLOCK, half - k % blocks * _BLOCK)
                drawn = sampler.draw(rng, n) if real else emit_random_many(shared.value, rng, n, least)
                yield pa.RecordBatch.from_arrays([pa.array(kernel.label(shared.value, drawn, decode=False).q, pa.float64()), pa.array([real] * n, pa.bool_())], ["q", "is_real"])

    return spark.range(0, 2 * blocks, 1, min(2 * blocks, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "q double, is_real boolean")


def calibrate(spark: SparkSession, m: Model, o: Options = Options()) -> float:
    """A threshold from ``o.calibration_reads`` reads simulated with the model, which are drawn and scored on the executors."""
    return float(best_threshold(simulated(spark, m, o)).first()["q"])
