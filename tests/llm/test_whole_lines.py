"""Repeated lines of rows that share an id or have none, against brute force."""

from __future__ import annotations

import random
import re

import pytest

from readloom.llm import line_dedup as L


def cleaned(spark, rows, threshold=0.8):
    """Each row's text by brute force, in the order of (id, hash of the text where the id is shared, line)."""
    from pyspark.sql import functions as F

    ids = [i for i, _ in rows]
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    place = lambda i, t: (-(1 << 63) if i is None else i, hashes[t] if ids.count(i) > 1 else 0)
    lines = sorted({(*place(i, t), k, frozenset(re.findall(r"[^\x20\x09-\x0D]+", s))) for i, t in rows for k, s in enumerate(t.split("\n"))}, key=lambda x: x[:3])
    lines = [x for x in lines if x[3]]
    gone = {x[:3] for n, x in enumerate(lines) if any(len(x[3] & y[3]) >= threshold * len(x[3] | y[3]) - 1e-9 for y in lines[:n])}
    return sorted(("" if i is None else str(i), "\n".join(s for k, s in enumerate(t.split("\n")) if (*place(i, t), k) not in gone)) for i, t in rows)


def result(spark, rows):
    return sorted(("" if r["doc_id"] is None else str(r["doc_id"]), r["text"]) for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_lines_that_match_nothing_stay(spark):
    rows = [(1, "a b c d e f g h i j"), (None, "p q r s t u v w x y\n1 2 3 4 5 6"), (None, "k l m n o 11 12 13 14 15"), (None, "p q r s t u v w x z"), (5, "a b c d e f g h i k"), (5, "only this one here is new words")]
    got = result(spark, rows)
    assert ("5", "only this one here is new words") in got and ("", "k l m n o 11 12 13 14 15") in got and ("5", "") in got
    assert got == cleaned(spark, rows)


@pytest.mark.parametrize("seed", [5, 6])
def test_shared_and_missing_ids_by_brute_force(spark, seed):
    r = random.Random(seed)
    bases = [[f"w{r.randrange(60)}" for _ in range(r.choice((2, 5, 9, 20, 60)))] for _ in range(14)]
    rows = []
    for _ in range(50):
        lines = []
        for _ in range(r.randint(1, 4)):
            line = list(r.choice(bases))
            for _ in range(r.randint(0, 1 + len(line) // 8)):
                line[r.randrange(len(line))] = f"x{r.randrange(10_000)}"
            lines.append(" ".join(line))
        rows.append((r.choice((None, None, 1, 2, 3, *range(10, 40))), "\n".join(lines)))
    rows += rows[:3]
    assert result(spark, rows) == cleaned(spark, rows)


@pytest.mark.parametrize("threshold", [0.5, 0.66, 0.75, 0.8, 1.0])
def test_short_lines_at_any_threshold(spark, threshold):
    assert [L.least_joined(x) for x in (0.5, 0.66, 0.75, 0.8, 0.9)] == [1, 2, 3, 4, 9]
    rows = [(1, "a b c"), (2, "a b c d"), (3, "e f"), (4, "e f g"), (5, "h"), (6, "h i"), (7, "j k l m n"), (8, "j k l m n o")]
    got = L.dedup(spark.createDataFrame(rows, "doc_id long, text string"), threshold).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == cleaned(spark, rows, threshold)


def test_words_are_parted_by_every_white_character(spark):
    rows = [(1, "a b c d e f g h i j\r\nk\tl\x0bm\x0cn  o p q r s t "), (2, "  a\tb\x0bc\x0cd e f g h i\r\n\t\x0b\r\n k l m n o p q r s u"), (3, " \t \n\nnew words only here"), (4, "a b"), (5, None)]
    got = {r["doc_id"]: r["text"] for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "\t\x0b\r", 3: rows[2][1], 4: "a b", 5: None}


def test_ordered_words_are_plain_longs(spark):
    """Arrays that may hold nulls are sorted as boxed objects."""
    from pyspark.sql import functions as F

    lines = spark.createDataFrame([("b a  b\tc ",)], "s string").withColumn("turn", F.array(F.lit(0).cast("long"), F.lit(0).cast("long")))
    keys = lines.select(L._ordered(L._plain(F.col("s")), F.col("turn"), 1).alias("keys"), F.array_sort(F.array(*[F.xxhash64(F.lit(w)) for w in "abc"])).alias("words"))
    assert not keys.schema["keys"].dataType.containsNull
    assert keys.where("keys = words").count() == 1


def test_leads_of_one_form_are_not_sent(spark, monkeypatch):
    """Of the keys that lead to earlier forms, only those that several forms may have are written and joined."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(60)]
    rows += [(100 + i, " ".join([f"v{k}" for k in range(20)] + [f"u{i}"])) for i in range(5)]
    sizes = []

    def counted(df, real=L.cut):
        out = real(df)
        if "key" in out.columns and "bits" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(L, "cut", counted)
    got = L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == cleaned(spark, rows)
    # 65 forms have six keys each
    assert sizes and max(sizes) <= 40
