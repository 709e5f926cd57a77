"""Column functions over reads: all of them built-in expressions, so they stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

#: A quality character c stands for the error probability 10 ** -((c - PHRED) / 10).
PHRED = 33
#: Bases of a read that the low-complexity score looks at.
DUST_WINDOW = 64


def reverse_complement(seq: Column) -> Column:
    """Upper-case reverse complement; U reads as T, anything that is no base stays."""
    return F.translate(F.reverse(F.upper(seq)), "ACGTU", "TGCAA")


def clean(seq: Column) -> Column:
    """Upper case, with U as T and everything that is none of A C G T . as N."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT.]", "N")


def base_code(base: Column) -> Column:
    """0 to 3 for A C G T (or U), 4 for anything else, 5 for a dot."""
    b = F.upper(base)
    return F.when(b == "A", 0).when(b == "C", 1).when(b == "G", 2).when(b.isin("T", "U"), 3).when(b == ".", 5).otherwise(4)


def base_counts(seq: Column) -> dict[str, Column]:
    """Number of A, C, G, T (with U) and of all other characters."""
    s = F.upper(seq)
    n = {b: F.length(s) - F.length(F.translate(s, b, "")) for b in "ACG"}
    n["T"] = F.length(s) - F.length(F.translate(s, "TU", ""))
    return n | {"N": F.length(s) - n["A"] - n["C"] - n["G"] - n["T"]}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it (within another lambda it would be computed for every element)."""
    return F.transform(F.array(value), f)[0]


def count_overlapping(seq: Column, pattern: str) -> Column:
    """Occurrences of a pattern, overlaps included, in any case."""
    if not pattern:
        return F.lit(0)
    places = F.sequence(F.lit(1), F.greatest(F.length(seq) - len(pattern) + 1, F.lit(1)))
    return let(F.upper(seq), lambda s: F.size(F.filter(places, lambda i: F.substring(s, i, F.lit(len(pattern))) == pattern.upper())))


def find_end(seq: Column, pattern: str) -> Column:
    """1-based end of a pattern's first occurrence, or 0."""
    at = F.instr(seq, pattern)
    return F.when(at > 0, at + len(pattern) - 1).otherwise(0)


def hamming(a: Column, b: Column) -> Column:
    """Differing places of strings of one length; null for others."""
    return F.when(F.length(a) == F.length(b), F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda z: z["x"] != z["y"])))


def dust_score(seq: Column, window: int = DUST_WINDOW) -> Column:
    """Low-complexity score: 10 * sum over triplets of n(n-1)/2, over the number of triplets less one.

    Letters that are no bases count as A.  Null where fewer than two triplets fit."""
    plain = F.translate(F.regexp_replace(F.substring(F.upper(seq), 1, window), "[^CGTU]", "A"), "U", "T")

    def step(a: Column, t: Column) -> Column:
        """Over sorted triplets, each adds the number of like ones before it."""
        run = F.when(a["last"] == t, a["run"] + 1).otherwise(0)
        return F.struct(t.alias("last"), run.alias("run"), (a["pairs"] + run).alias("pairs"))

    def score(s: Column) -> Column:
        n = F.length(s) - 2
        triplets = F.sort_array(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, F.lit(3))))
        start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("pairs"))
        pairs = F.aggregate(triplets, start, step)["pairs"]
        return F.when(n >= 2, F.lit(10.0) * pairs / (n - 1).cast("double"))

    return let(plain, score)


def umi_key(seq: Column) -> Column:
    """The bases as digits to the base 4; N counts as A.  Holds 31 bases."""
    return F.aggregate(F.split(F.upper(seq), ""), F.lit(0).cast("long"), lambda a, b: a * 4 + F.when(b == "C", 1).when(b == "G", 2).when(b.isin("T", "U"), 3).otherwise(0))


def umi_bases(key: Column, length: Column) -> Column:
    """The bases of a key of so many digits."""
    digits = F.transform(F.sequence(length - 1, F.lit(0), F.lit(-1)), lambda i: F.substring(F.lit("ACGT"), (F.call_function("shiftright", key, (i * 2).cast("int")).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)))
    return F.when(length > 0, F.array_join(digits, "")).otherwise("")


def name_tag(name: Column, tag: str) -> Column:
    """The value of ``;TAG:value`` in a read's name; null if it has none."""
    return F.nullif(F.regexp_extract(name, f"(?:^|;){tag}:([^;]*)", 1), F.lit(""))


def right_probability(quality: Column) -> Column:
    """Of a quality character: the probability that its base is right."""
    return F.lit(1.0) - F.pow(F.lit(10.0), -(F.ascii(quality) - PHRED).cast("double") / 10.0)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def gaussian(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2.0) / (sd * F.sqrt(F.lit(6.283185307179586)))


def partial_prefix(seq: Column, adapter: str) -> Column:
    """Length of the longest end of the adapter, over 3, with which the read begins; 0 if none."""
    n = len(adapter)
    return F.coalesce(*[F.when(F.startswith(seq, F.lit(adapter[n - k :])), k) for k in range(n, 3, -1)], F.lit(0))


def partial_suffix(seq: Column, adapter: str) -> Column:
    """Length of the longest beginning of the adapter, over 3, with which the read ends; 0 if none."""
    return F.coalesce(*[F.when(F.endswith(seq, F.lit(adapter[:k])), k) for k in range(len(adapter), 3, -1)], F.lit(0))


def random_log_likelihood(seq: Column, background: list[float], average: float) -> Column:
    """Natural log of a read's probability as independent bases of geometric length."""
    n = base_counts(seq)
    logs = [math.log(p) if p > 0 else float("-inf") for p in background]
    bases = sum((n[b].cast("double") * logs[i] for i, b in enumerate("ACGTN") if logs[i] > float("-inf")), F.lit(0.0))
    return bases + F.length(seq).cast("double") * math.log(1 - 1 / average) + math.log(1 / average)


def comparable_name(name: Column) -> Column:
    """The part of a read's name that its mates share.

    Names of seven fields (``machine:run:cell:lane:tile:x:y member:...``) and of five (``machine:lane:tile:x:y#index/member``)
    are cut to the fields; others to what precedes a blank or semicolon."""
    head = F.split(F.regexp_replace(name, "^[@>]", ""), "[ ;]")[0]
    five = F.regexp_extract(head, r"^((?:[^:]*:){4}[0-9]+)(?:#.*)?(?:/[0-9])?$", 1)
    return F.when(head.rlike(r"^(?:[^:]*:){6}[0-9]+$"), head).when(five != "", five).otherwise(F.regexp_replace(head, "/[0-9]$", ""))


def register(spark: SparkSession) -> None:
    """Make the scalar functions callable from SQL.  They are SQL expressions, not Python code."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN translate(reverse(upper(s)), 'ACGTU', 'TGCAA')")
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION dust_score(seq STRING) RETURNS DOUBLE RETURN
        transform(array(translate(regexp_replace(substring(upper(seq), 1, 64), '[^CGTU]', 'A'), 'U', 'T')), s ->
          CASE WHEN length(s) >= 4 THEN 10D * aggregate(sort_array(transform(sequence(1, length(s) - 2), i -> substring(s, i, 3))),
            named_struct('last', '', 'run', 0, 'pairs', 0), (a, t) -> named_struct('last', t, 'run', IF(a.last = t, a.run + 1, 0), 'pairs', a.pairs + IF(a.last = t, a.run + 1, 0)),
            a -> a.pairs) / (length(s) - 3) END)[0]"""
    )
