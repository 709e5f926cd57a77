"""The extraction run: fit once per file, then one lazy plan from reads to outcomes."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..operators import calibrate, choose, filters, label, mates, stats
from .layout import Layout, LayoutError, warnings
from .model import Model, Options, build


@dataclass
class Fitted:
    """What was found out about one file: its layout, model and threshold."""

    layout: Layout
    model: Model
    threshold: float
    certainty: float = 1.0


@dataclass
class Run:
    """Messages of a run, in order."""

    messages: list[str] = field(default_factory=list)

    def say(self, text: str) -> None:
        self.messages.append(f"[{datetime.now(timezone.utc):%Y-%m-%d %H:%M:%S}] {text}")


def fit(reads: DataFrame, layouts: list[Layout], o: Options = Options(), log: Run | None = None) -> Fitted:
    """Choose a layout for one file, build its model and find its threshold (unless the options set one)."""
    size = stats.known_size(reads, o)
    layout, p = choose.choose(reads, layouts, o, size)
    model = build(layout, stats.sequence_stats(reads, layout, o, size), o)
    threshold = o.threshold if o.threshold is not None else 0.0 if layout.plain else calibrate.calibrate(reads.sparkSession, model, o)
    if log:
        log.say(f"layout {layout} (probability {p:.2f}), threshold {threshold:.2f}")
        for w in warnings(layout, bool(o.dust)):
            log.say(f"warning: {w}")
    return Fitted(layout, model, threshold, p)


def check(files: list[Fitted]) -> None:
    """At most one file has barcodes."""
    if sum(any(s.kind == "B" for s in f.layout.segments) for f in files) > 1:
        raise LayoutError("barcodes in more than one file")


def extract_file(reads: DataFrame, fitted: Fitted, o: Options = Options(), references: DataFrame | None = None) -> DataFrame:
    """Labelled and filtered reads of one file.  With several reads in one sequence, the filters are off."""
    out = label.label(reads, fitted.model, fitted.threshold, o)
    if fitted.layout.reads > 1:
        return out.withColumn("contaminant_ix", F.lit(None).cast("int"))
    out = filters.contaminants(out, references, o.contaminant_errors) if references is not None else out.withColumn("contaminant_ix", F.lit(None).cast("int"))
    return filters.low_complexity(out, o.dust) if fitted.layout.reads else out


def extract(reads: DataFrame, fitted: list[Fitted], o: Options = Options(), references: DataFrame | None = None) -> DataFrame:
    """(ord, outcome, barcode, contaminant_ix, files) over all files; one shuffle brings mates together, and a single file needs none."""
    check(fitted)
    parts = [extract_file(reads.where(F.col("file_ix") == ix), f, o, references) for ix, f in enumerate(fitted)]
    if len(parts) == 1:
        return mates.alone(parts[0])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return mates.combine(out)


def _figures() -> list[Column]:
    return [F.count("*").alias("total"), *[F.sum((F.col("outcome") == x).cast("bigint")).alias(x) for x in label.OUTCOMES]]


def totals(combined: DataFrame) -> DataFrame:
    """One row: reads, and how many of each outcome."""
    return combined.agg(*_figures())


def counted(combined: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows; and their totals, which are there once something has been done with all of them."""
    seen = Observation()
    first, *more = _figures()
    return combined.observe(seen, first, *more), seen


def report(row: dict, log: Run) -> None:
    total = row["total"] or 1
    log.say(f"{row['total']} input reads")
    log.say(f"{row['success']} extracted ({100 * (row['success'] or 0) / total:.1f}%)")
    for x in label.OUTCOMES[1:]:
        log.say(f"{row[x] or 0} {x.replace('_', ' ')}")
