"""Mixing sources to target weights.

Each source gets a target number of words: the total (a share of all words) is dealt by weight, targets
stop at a multiple of the source's size, and what is over is dealt again by weight until none is above.
A source's repetition rate is its target over its size; every document is emitted floor(rate) times and
once more if a uniform number, hashed from its id (from its text where it has none), falls below the fraction.

Only DataFrame operations are used.  The work per source happens on one row per source; ranks come from
a distributed sort, and the level at which targets stop from a few one-row aggregates, so no task and
no driver holds all sources.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents
of size 0 are taken 0 times; rows of one id share their draw, and each goes by the rate of its own source; an
empty table gives an empty result; other columns stay as they are in ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"


def size_of(text: Column) -> Column:
    """Number of words of a text.  A run of words and spaces becomes one letter each; that is much less than an array."""
    trimmed = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.coalesce(F.length(F.regexp_replace(trimmed, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Add rank, from 0, by code point, null last; from a range-partitioned sort, not from one task."""
    sort = cut(sources.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    # one row per partition of the sort
    before = sort.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    at = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return sort.withColumn("part", part).join(before.select("part", "before"), "part").select("source", "source_size", (F.col("before") + at).alias("rank"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size)."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    dealt = cut(ranked(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * cap))
    level = None  # words per unit of weight
    while True:
        over = F.lit(False) if level is None else F.col("most") <= F.col("weight") * F.lit(level)
        held, rest, total = dealt.agg(F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight"))), F.sum("source_size")).first()
        new = (share * (total or 0) - (held or 0)) / rest if rest else level
        if new == level or new is None:
            break
        level = new
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(level or 0)))
    return dealt.select("source", "source_size", target.alias("target"))


def _planned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, source, version, size, source_size, target, copies) for every document; version is a hash of its text."""
    own = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), "source", F.xxhash64("text").alias("version"), size_of(F.col("text")).alias("size"), draw.alias("draw")))
    to = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = F.when(F.col("size") > 0, whole + F.when(F.col("draw") < rate - whole, 1).otherwise(0)).otherwise(0).cast("long")
    s, t = sized.alias("s"), to.alias("t")
    out = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source")))
    return out.select("doc_id", "s.source", "version", "size", "source_size", "target", copies.alias("copies"))


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every document."""
    return _planned(docs, weights, share, cap, seed, id_col).select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    planned = _planned(docs, weights, share, cap, seed, id_col).where("copies > 0")
    # rows of one id, source and text are taken alike
    plan = planned.groupBy(F.col("doc_id").alias("\x00id"), F.col("source").alias("\x00source"), F.col("version").alias("\x00version")).agg(F.max("copies").alias("\x00copies"))
    d = docs.alias("d")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("`\x00id`")) & F.col("d.source").eqNullSafe(F.col("`\x00source`")) & (F.xxhash64("d.text") == F.col("`\x00version`"))
    joined = d.join(plan, same)
    return joined.withColumn("\x00copy", F.explode(F.sequence(F.lit(1), F.col("`\x00copies`").cast("int")))).select("d.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)) AS BIGINT) AS weight FROM src),
stops AS (  -- sources reach their stop in the order of stop over weight
  SELECT *, source_size * 2 AS most, row_number() OVER w AS k,
    COALESCE(SUM(source_size * 2) OVER w - source_size * 2, 0) AS held,
    SUM(weight) OVER () - SUM(weight) OVER w + weight AS rest,
    SUM(source_size) OVER () AS total
  FROM weighed
  WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
levels AS (
  SELECT *, (1.5::DOUBLE * CAST(total AS DOUBLE) - CAST(held AS DOUBLE)) / CAST(rest AS DOUBLE) AS v FROM stops),
lvl AS (
  SELECT arg_min(v, k) AS v FROM levels WHERE CAST(most AS DOUBLE) > weight * v),
rated AS (
  SELECT source, source_size, LEAST(CAST(most AS DOUBLE), weight * COALESCE((SELECT v FROM lvl), 0)) AS target FROM stops),
drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target,
    CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix-1:' || COALESCE(CAST(s.doc_id AS VARCHAR), md5(COALESCE(text, '')))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS draw
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size > 0 THEN size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM drawn
"""
