"""Choose the layout that explains a file's reads best."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..plans.layout import Layout
from ..plans.model import Options, build
from .label import log_likelihoods
from .stats import known_size, sample, stats_of_all


def concatenate(*lists: DataFrame) -> DataFrame:
    """(layout): the layouts of several lists, each once and without blanks around it; empty lines and comments are none.

    Every list is reduced to its distinct layouts where it is read."""
    out = None
    for one in lists:
        line = one.select(F.regexp_replace(F.trim(F.regexp_replace(one.columns[0], r"\s+", " ")), " *#.*$", "").alias("layout"))
        part = line.where("layout <> ''")
        out = part if out is None else out.union(part)
    if out is None:
        raise ValueError("no lists of layouts")
    return out.distinct()


def posterior(log_likelihoods_: list[float]) -> np.ndarray:
    """Of layouts that are equally likely before: their probabilities given the reads."""
    x = np.array(log_likelihoods_, float)
    x = np.exp(x - x.max())
    return x / x.sum()


def choose(reads: DataFrame, layouts: list[Layout], o: Options = Options(), size: int | None = None) -> tuple[Layout, float]:
    """The best of the layouts and its probability.  All are scored in one pass over some of the file's reads, of which there are ``size``."""
    if len(layouts) == 1:
        return layouts[0], 1.0
    size = known_size(reads, o) if size is None else size
    models = [build(a, s, o) for a, s in zip(layouts, stats_of_all(reads, layouts, o, size), strict=True)]
    # one row per layout comes back
    rows = {r["layout_id"]: r["log_likelihood"] for r in log_likelihoods(sample(reads, o.search_reads, o, size), models).collect()}
    p = posterior([rows.get(i, 0.0) for i in range(len(layouts))])
    best = int(p.argmax())
    return layouts[best], float(p[best])
