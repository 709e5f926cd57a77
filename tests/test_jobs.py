"""The jobs over growing input, after failures, and by their command lines.  All input is copied or made here."""

from __future__ import annotations

import datetime
import json
import logging
import subprocess
import sys
from pathlib import Path

import pytest
from compare import same
from pyspark.sql import functions as F

from jobs import demultiplex, molecules, registry
from jobs.common import default_config, existing, read_config

TOP = Path(__file__).parent.parent
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_shipdate timestamp"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, data, name):
    same(registry.queries()[name](spark, data), registry.oracle_sql()[name], data)


def add(rows, folder: str) -> None:
    rows.coalesce(1).write.mode("append").parquet(folder)


def sorted_rows(df) -> list[str]:
    return sorted(map(repr, df.collect()))


# -- demultiplexing ---------------------------------------------------------------------------------


def test_only_new_files_are_taken_in_and_the_whole_equals_one_run(spark, data, tmp_path, caplog):
    docs, table, out, mark = spark.read.parquet(f"{data}/documents.parquet"), f"{tmp_path}/t", f"{tmp_path}/o", f"{tmp_path}/c"
    conf = default_config("demultiplex")
    parts = [docs.where(F.col("doc_id") % 3 == k) for k in range(3)]
    sizes = [p.count() for p in parts]
    add(parts[0], table)
    with caplog.at_level(logging.INFO, "jobs.demultiplex"):
        first = demultiplex.run(spark, table, out, mark, conf)
    assert first["rows"] == sizes[0] and first["batches"] == 1 and f"read {sizes[0]} new rows" in caplog.text
    early = sorted_rows(demultiplex.reads_of(spark, out))
    assert first["reads"] == len(early)
    add(parts[1], table)
    add(parts[2], table)
    second = demultiplex.run(spark, table, out, mark, conf | {"files_per_batch": 1})
    assert second["rows"] == sizes[1] + sizes[2] and second["batches"] == 2
    late = sorted_rows(demultiplex.reads_of(spark, out))
    assert set(early) < set(late) and len(late) == first["reads"] + second["reads"]
    third = demultiplex.run(spark, table, out, mark, conf)
    assert third == {"batches": 0, "rows": 0, "reads": 0} and sorted_rows(demultiplex.reads_of(spark, out)) == late
    demultiplex.run(spark, table, f"{tmp_path}/o2", f"{tmp_path}/c2", conf)
    assert sorted_rows(demultiplex.reads_of(spark, f"{tmp_path}/o2")) == late
    report = {r["outcome"]: r["n"] for r in demultiplex.report(spark, out).collect()}
    assert report == {r["outcome"]: r["count"] for r in demultiplex.reads_of(spark, out).groupBy("outcome").count().collect()}
    assert set(report) == {"success", "barcode_missing", "too_short", "low_complexity"}


def test_a_batch_that_fails_half_way_is_written_once(spark, data, tmp_path, monkeypatch):
    docs, table, out, mark = spark.read.parquet(f"{data}/documents.parquet"), f"{tmp_path}/t", f"{tmp_path}/o", f"{tmp_path}/c"
    add(docs.where("doc_id % 2 = 0"), table)
    conf = default_config("demultiplex")
    plain = demultiplex.dealt

    def half(reads, conf):
        return plain(reads, conf).where(F.when(F.col("id") % 8 == 6, F.raise_error(F.lit("lost"))).otherwise(F.lit(True)))

    monkeypatch.setattr(demultiplex, "dealt", half)
    with pytest.raises(Exception, match="lost"):
        demultiplex.run(spark, table, out, mark, conf)
    monkeypatch.setattr(demultiplex, "dealt", plain)
    # and once more after the reads were written, but before their counts
    monkeypatch.setattr(demultiplex, "tally", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="division by zero"):
        demultiplex.run(spark, table, out, mark, conf)
    monkeypatch.undo()
    add(docs.where("doc_id % 2 = 1"), table)
    demultiplex.run(spark, table, out, mark, conf)
    demultiplex.run(spark, table, f"{tmp_path}/o2", f"{tmp_path}/c2", conf)
    assert sorted_rows(demultiplex.reads_of(spark, out)) == sorted_rows(demultiplex.reads_of(spark, f"{tmp_path}/o2"))
    assert sorted_rows(demultiplex.report(spark, out)) == sorted_rows(demultiplex.report(spark, f"{tmp_path}/o2"))


def test_records_and_their_samples_one_by_one(spark, tmp_path):
    conf = default_config("demultiplex") | {"seq": "line", "min_length": 4, "dust": 20.0}
    rows = [
        (1, "ACAGTTGACCATGACC\nACCGTTGACCATGACC\n\n  \nGGGGTTGACC", "a"), (2, "TTGAAA", ""), (3, None, "a"), (4, "", None), (5, f"GCCT{'A' * 40}", "b/c=d"), (5, "CATC", "7"),
    ]
    docs = spark.createDataFrame([(i, t, "x", s, 1) for i, t, s in rows], DOCS).withColumn("sample", F.lit("clash")).withColumn("lane", F.lit(3))
    add(docs, f"{tmp_path}/t")
    demultiplex.run(spark, f"{tmp_path}/t", f"{tmp_path}/o", f"{tmp_path}/c", conf)
    got = {tuple(r) for r in demultiplex.reads_of(spark, f"{tmp_path}/o").collect()}
    assert got == {
        (1, 0, "a", "S1", "success", "TTGACCATGACC"), (1, 1, "a", "S1", "success", "TTGACCATGACC"), (1, 4, "a", "undetermined", "barcode_missing", "GGGGTTGACC"),
        (2, 0, "none", "S2", "too_short", "AA"), (5, 0, "b/c=d", "S3", "low_complexity", "A" * 40), (5, 0, "7", "S4", "too_short", ""),
    }


def test_an_empty_table(spark, tmp_path):
    add(spark.createDataFrame([], DOCS), f"{tmp_path}/t")
    for _ in range(2):
        assert demultiplex.run(spark, f"{tmp_path}/t", f"{tmp_path}/o", f"{tmp_path}/c", default_config("demultiplex"))["reads"] == 0
    assert demultiplex.reads_of(spark, f"{tmp_path}/o").collect() == []
    with pytest.raises(ValueError, match="one length"):
        demultiplex.dealt(spark.createDataFrame([], "id long, record int, lane string, seq string"), default_config("demultiplex") | {"barcodes": {"a": "A", "b": "CC"}})


# -- molecules --------------------------------------------------------------------------------------


def item(k: int, day: int | None, flag: str | None = "A", part: int = 1, line: int = 1) -> tuple:
    return k, line, part, 5, flag, day and datetime.datetime(2020, 1, day, 12)


def by_hand(rows: list[tuple]) -> dict[tuple[str, str], tuple[int, int]]:
    import hashlib

    seen: dict[tuple[str, str], list] = {}
    for k, line, part, supp, flag, day in rows:
        if day is not None:
            bases = "".join("ACGT"[int(c, 16) % 4] for c in hashlib.md5(f"{k}-{line}".encode()).hexdigest()[:4])
            seen.setdefault((flag or "none", f"chr{supp % 24}"), []).append((bases, part))
    return {key: (len(set(x)), len(x)) for key, x in seen.items()}


def counts(spark, out: str) -> dict[tuple[str, str], tuple[int, int]]:
    return {(r["sample"], r["chrom"]): (r["with_umi"], r["without_umi"]) for r in molecules.counts_of(spark, out).collect()}


def test_only_later_days_are_taken_in(spark, tmp_path):
    table, out, conf = f"{tmp_path}/t", f"{tmp_path}/o", default_config("molecules")
    old = [item(k % 7, 1 + k % 3, "A" if k % 2 else None) for k in range(40)] + [item(9, None)]
    new = [item(k % 7, 4 + k % 2, "A") for k in range(30)] + [item(k, 4, "B") for k in range(5)]
    add(spark.createDataFrame(old, ITEMS), table)
    assert molecules.run(spark, table, out, conf) == {"rows": 40, "reads": 40, "upto": datetime.date(2020, 1, 3), "samples": ["A", "none"]}
    assert counts(spark, out) == by_hand(old)
    add(spark.createDataFrame(new, ITEMS), table)
    assert molecules.run(spark, table, out, conf) == {"rows": 35, "reads": 35, "upto": datetime.date(2020, 1, 5), "samples": ["A", "B"]}
    assert counts(spark, out) == by_hand(old + new)
    done = molecules.run(spark, table, out, conf)
    assert (done["rows"], done["samples"]) == (0, []) and counts(spark, out) == by_hand(old + new)
    assert existing(spark, f"{out}/increments", molecules.INCREMENTS).select("upto").distinct().count() == 2


def test_a_run_that_fails_in_between_is_mended_and_nothing_counts_twice(spark, tmp_path, monkeypatch):
    table, out, conf = f"{tmp_path}/t", f"{tmp_path}/o", default_config("molecules")
    rows = [item(k % 7, 1 + k % 3) for k in range(40)]
    add(spark.createDataFrame(rows, ITEMS), table)
    monkeypatch.setattr(molecules, "bring_up", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        molecules.run(spark, table, out, conf)
    assert counts(spark, out) == {}
    monkeypatch.undo()
    assert molecules.run(spark, table, out, conf)["samples"] == ["A"] and counts(spark, out) == by_hand(rows)
    # the increment itself fails: its day is taken in whole by the next run
    more = [item(k, 9) for k in range(20)]
    add(spark.createDataFrame(more, ITEMS), table)
    plain = molecules.placed
    monkeypatch.setattr(molecules, "placed", lambda r, c: plain(r, c).withColumn("pos", F.when(F.rand(3) > 0.5, F.raise_error(F.lit("lost"))).otherwise(F.col("pos"))))
    with pytest.raises(Exception, match="lost"):
        molecules.run(spark, table, out, conf)
    monkeypatch.undo()
    molecules.run(spark, table, out, conf)
    assert counts(spark, out) == by_hand(rows + more)


def test_odd_items(spark, tmp_path):
    out = f"{tmp_path}/o"
    add(spark.createDataFrame([], ITEMS), f"{tmp_path}/none")
    assert molecules.run(spark, f"{tmp_path}/none", out, default_config("molecules"))["rows"] == 0 and counts(spark, out) == {}
    odd = [item(1, 2, "", line=3), (None, 1, 1, 5, "A", datetime.datetime(2020, 1, 2)), item(2, 2, "x/y"), item(2, 2, "x/y")]
    clash = spark.createDataFrame(odd, ITEMS).withColumn("sample", F.lit("s")).withColumn("upto", F.lit(1)).withColumn("n", F.lit(1))
    add(clash, f"{tmp_path}/t")
    molecules.run(spark, f"{tmp_path}/t", out, default_config("molecules"))
    assert counts(spark, out) == {("none", "chr5"): (1, 1), ("x/y", "chr5"): (1, 2)}
    nothing_fits = default_config("molecules") | {"umi_pattern": "^X$"}
    assert molecules.run(spark, f"{tmp_path}/t", f"{tmp_path}/o2", nothing_fits)["reads"] == 0


def test_the_plan_reads_only_what_is_needed(spark, data, capsys):
    rows = spark.read.parquet(f"{data}/lineitem.parquet")
    new = rows.where(F.col("l_shipdate") >= F.date_add(F.lit(datetime.date(2000, 1, 1)), 1).cast("timestamp"))
    molecules.placed(new, default_config("molecules")).explain()
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_quantity" not in plan


# -- configuration and command line -----------------------------------------------------------------


def test_a_configuration_overrides_some_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"most_errors": 0}))
    assert read_config(spark, f"{tmp_path}/c.json", "demultiplex") == default_config("demultiplex") | {"most_errors": 0}


def test_command_lines(spark, tmp_path):
    add(spark.createDataFrame([(1, f"ACAG{'GATTACAC' * 3}", "x", "a", 1)], DOCS), f"{tmp_path}/d")
    add(spark.createDataFrame([item(1, 2), item(1, 2)], ITEMS), f"{tmp_path}/i")
    (tmp_path / "c.json").write_text(json.dumps({"seq": "line", "dust": 100.0}))
    for args in (["demultiplex", "--input", f"{tmp_path}/d", "--output", f"{tmp_path}/o", "--checkpoint", f"{tmp_path}/k", "--config", f"{tmp_path}/c.json"], ["molecules", "--input", f"{tmp_path}/i", "--output", f"{tmp_path}/m"]):
        done = subprocess.run([sys.executable, "-m", f"jobs.{args[0]}", *args[1:]], cwd=TOP, capture_output=True, text=True, timeout=300, check=False)
        assert done.returncode == 0 and f"jobs.{args[0]}:" in done.stderr, done.stderr[-2000:]
    assert [tuple(r) for r in demultiplex.reads_of(spark, f"{tmp_path}/o").collect()] == [(1, 0, "a", "S1", "success", "GATTACAC" * 3)]
    assert counts(spark, f"{tmp_path}/m") == {("A", "chr5"): (1, 2)}
