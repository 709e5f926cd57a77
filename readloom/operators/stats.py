"""Figures of a file's reads: one aggregate, whatever the number of reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import sequence as S
from ..plans.layout import Layout
from ..plans.model import Options, Stats


def prefix(reads: DataFrame, n: int | None) -> DataFrame:
    """The first n reads by their order in the file."""
    return reads if n is None else reads.where(F.col("ord") < n)


#: Hashes of reads are below this.
_HASHES = 1 << 62


def known_size(reads: DataFrame, o: Options) -> int | None:
    """How many reads there are, where a sample of them needs it."""
    return reads.count() if o.spread and not (o.stats_reads is None and o.search_reads is None) else None


def sample(reads: DataFrame, n: int | None, o: Options = Options(), size: int | None = None) -> DataFrame:
    """About n of the reads (all, if there are no more), of which there are ``size``: those with the least hashes of file and number.

    A read is taken or not by itself, so nothing is sorted or shuffled; a smaller sample lies within a greater one, and reruns
    agree.  Without ``o.spread`` the first n."""
    if n is None or not o.spread:
        return prefix(reads, n)
    size = reads.count() if size is None else size
    if size <= n:
        return reads
    key = [c for c in ("file_ix", "ord") if c in reads.columns]
    return reads.where(F.pmod(F.xxhash64(*[F.col(c).cast("bigint") for c in key]), F.lit(_HASHES)) < F.lit(n * _HASHES // size))


def stats_columns(adapters_5: Sequence[str] = (), adapters_3: Sequence[str] = ()) -> dict[str, Column]:
    """Aggregates over ``seq``: base counts (each one more than found), lengths, and cut adapters."""
    out = {f"n_{b.lower()}": F.coalesce(F.sum(n), F.lit(0)) + 1 for b, n in S.base_counts(F.col("seq")).items()}
    out |= {"reads": F.count("seq"), "avg_len": F.avg(F.length("seq")), "max_len": F.max(F.length("seq"))}
    for side, adapters, length in (("5", adapters_5, S.partial_prefix), ("3", adapters_3, S.partial_suffix)):
        for a in adapters:
            hit = F.nullif(length(F.col("seq"), a), F.lit(0)).cast("double")
            out |= {f"hits_{side}_{a}": F.count(hit), f"mean_{side}_{a}": F.avg(hit), f"sd_{side}_{a}": F.stddev_samp(hit)}
    return out


def _adapter(layout: Layout | None, place: int) -> str | None:
    return layout.segments[place].seqs[0] if layout and layout.segments[place].kind == "P" else None


def stats_of_all(reads: DataFrame, layouts: list[Layout | None], options: Options = Options(), size: int | None = None) -> list[Stats]:
    """The figures for every layout, from one pass: layouts differ only in their outer adapters."""
    sides = {"5": [_adapter(a, 0) for a in layouts], "3": [_adapter(a, -1) for a in layouts]}
    distinct = [list(dict.fromkeys(filter(None, sides[s]))) for s in "53"]
    row = sample(reads, options.stats_reads, options, size).agg(*[c.alias(k) for k, c in stats_columns(*distinct).items()]).first()
    counts = [row[f"n_{b}"] for b in "acgtn"]
    out = []
    for k in range(len(layouts)):
        cut = {}
        for side, adapters in sides.items():
            if a := adapters[k]:
                few = row[f"hits_{side}_{a}"] <= 1
                cut[f"mean_{side}"] = float(len(a)) if few else row[f"mean_{side}_{a}"]
                cut[f"sd_{side}"] = 1.0 if few else row[f"sd_{side}_{a}"] or 10_000.0
        out.append(Stats(tuple(c / sum(counts) for c in counts), float(max(1, round(row["avg_len"] or 1))), row["max_len"] or 0, **cut))
    return out


def sequence_stats(reads: DataFrame, layout: Layout | None = None, options: Options = Options(), size: int | None = None) -> Stats:
    """Background, lengths, and how much of the outer adapters the reads show."""
    return stats_of_all(reads, [layout], options, size)[0]


def information(reads: DataFrame, places: int, even: float = 0.25) -> DataFrame:
    """(place, bits) of the first places of all reads: their information content against a background of even bases."""
    one = reads.select(F.posexplode(F.split(F.substring("seq", 1, places), "")).alias("place", "base"))
    n = one.groupBy("place", "base").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("place"))
    return n.withColumn("p", p).groupBy(F.col("place").cast("bigint").alias("place")).agg(F.sum(F.col("p") * F.log2(F.col("p") / even)).alias("bits"))
