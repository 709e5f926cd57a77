"""Operators on small inputs, with their edges."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.functions import sequence as S
from readloom.operators import calibrate, choose, demux, evaluate, filters, label, mates, pairs, simulate, stats, umi
from readloom.plans import layout as L
from readloom.plans.model import Options, Stats, build
from readloom.plans.run import Fitted, Run, check, extract, fit, report, totals

STATS = Stats((0.25, 0.25, 0.25, 0.24, 0.01), 30, 30)
PAYLOAD = "GATTACAGGCATCCATTGACAGTA"


def reads(spark, seqs, file_ix=0):
    rows = [(file_ix, i, f"r{i}", s, s if s is None else "I" * len(s)) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, label.READS)


def value(spark, column, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(column.alias("x")).first()["x"]


def test_scalar_functions(spark):
    c = F.col
    assert value(spark, S.reverse_complement(c("s")), s="acgtuN.") == ".NAACGT"
    assert value(spark, S.clean(c("s")), s="acux.") == "ACTN."
    assert value(spark, S.count_overlapping(c("s"), "aa"), s="AAaAT") == 3
    assert value(spark, S.count_overlapping(c("s"), "acgt"), s="A") == 0
    assert value(spark, S.hamming(c("s"), c("t")), s="ACG", t="ATG") == 1
    assert value(spark, S.hamming(c("s"), c("t")), s="ACG", t="AT") is None
    assert value(spark, S.dust_score(c("s")), s="A" * 64) == pytest.approx(10 * 62 * 61 / 2 / 61)
    assert value(spark, S.dust_score(c("s")), s="ACG") is None
    assert value(spark, S.umi_key(c("s")), s="ACGTN") == 0b0001101100
    assert value(spark, S.umi_bases(S.umi_key(c("s")), F.length("s")), s="TTGAC") == "TTGAC"
    assert value(spark, S.partial_prefix(c("s"), "ACGTTGCA"), s="TTGCAGG") == 5
    assert value(spark, S.partial_suffix(c("s"), "ACGTTGCA"), s="GGACG") == 0


NEW, OLD = "NV042:17:KX3PLM:4:1208:9921:{y} {mate}:{filtered}:0:CCGTAA", "GA-IIB_0007_FC61:3:12:845:{y}#0/{mate}"
NAMES = [
    (NEW.format(y=40117, mate=1, filtered="N"), NEW.format(y=40117, mate=2, filtered="N"), True),
    (NEW.format(y=40117, mate=2, filtered="N"), NEW.format(y=40117, mate=1, filtered="Y").replace("CCGTAA", "TTGACC"), True),
    (NEW.format(y=40117, mate=1, filtered="N"), NEW.format(y=40118, mate=2, filtered="N"), False),
    (OLD.format(y=2206, mate=1), OLD.format(y=2206, mate=2), True),
    (OLD.format(y=2206, mate=1), OLD.format(y=2207, mate=2), False),
    (NEW.format(y=40117, mate=1, filtered="N"), OLD.format(y=2206, mate=2), False),
    ("read1;x", "read1 y", True),
]


@pytest.mark.parametrize("a,b,match", [*NAMES, *[(b, a, m) for a, b, m in NAMES]])
def test_read_names(spark, a, b, match):
    assert value(spark, S.comparable_name(F.col("a")) == S.comparable_name(F.col("b")), a=a, b=b) is match


def test_labels(spark):
    m = build(L.parse("B:ACAGTG,TTAGGC F:NNN R:N"), STATS, Options())
    got = {r["ord"]: r for r in label.label(reads(spark, ["ACAGTG" + "ACT" + PAYLOAD, "TTAGGC" + "GGG" + PAYLOAD, "ACAGTGACTGATTA", "", None, "GGGGGG" + "CCC" + PAYLOAD]), m, 0.5).collect()}
    assert (got[0]["outcome"], got[0]["barcode"], got[0]["fp_seq"], got[0]["fp"]) == ("success", "ACAGTG", "ACT", 7)
    assert got[0]["payloads"][0]["seq"] == PAYLOAD and len(got[0]["payloads"][0]["qual"]) == len(PAYLOAD)
    assert got[1]["barcode"] == "TTAGGC"
    assert got[2]["outcome"] in ("too_short", "mismatch")
    assert got[3]["outcome"] == got[4]["outcome"] == "mismatch"
    assert got[5]["outcome"] != "success"


def test_window_leaves_the_rest_to_the_read(spark):
    m = build(L.parse("F:NNNN R:N"), STATS, Options())
    row = label.label(reads(spark, ["ACGT" + PAYLOAD]), m, 0.0, Options(start=1, end=24)).first()
    assert row["payloads"][0]["seq"] == PAYLOAD


def test_filters(spark):
    plain = build(L.parse("R:N"), STATS, Options())
    got = label.label(reads(spark, [PAYLOAD * 2, "A" * 40, "TTTT" + PAYLOAD]), plain, 0.0)
    low = filters.low_complexity(got, 100.0)
    assert [r["outcome"] for r in low.orderBy("ord").collect()] == ["success", "low_complexity", "success"]
    refs = spark.createDataFrame([(0, "CCCC" * 20), (1, S_REF)], "ref_ix int, seq string")
    out = filters.contaminants(low, refs, 2).orderBy("ord").collect()
    assert [(r["outcome"], r["contaminant_ix"]) for r in out] == [("success", None), ("low_complexity", None), ("artifact", 1)]
    assert {r["outcome"]: r["n"] for r in filters.summary(filters.contaminants(low, refs, 2)).collect()} == {"success": 1, "low_complexity": 1, "artifact": 1}
    none = spark.createDataFrame([], "ref_ix int, seq string")
    assert filters.contaminants(got, none).where("outcome = 'artifact'").count() == 0


S_REF = "GGG" + "TTTT" + PAYLOAD[:10] + "A" + PAYLOAD[10:] + "CCC"


def test_mates(spark):
    a, b = reads(spark, [PAYLOAD, PAYLOAD]), reads(spark, [PAYLOAD], 1)
    with pytest.raises(mates.MateError):
        mates.check_counts(a.union(b))
    mates.check_names(a.union(reads(spark, [PAYLOAD, PAYLOAD], 1)))
    with pytest.raises(mates.MateError):
        mates.check_names(a.union(reads(spark, [PAYLOAD, PAYLOAD], 1).withColumn("name", F.lit("other"))))
    plain = L.parse("R:N")
    coded = L.parse("B:ACAGTG,TTAGGC R:N")
    files = [Fitted(plain, build(plain, STATS, Options()), 0.0), Fitted(coded, build(coded, STATS, Options()), 0.5)]
    got = extract(a.union(reads(spark, ["ACAGTG" + PAYLOAD, PAYLOAD[:8]], 1)), files).orderBy("ord").collect()
    assert (got[0]["outcome"], got[0]["barcode"]) == ("success", "ACAGTG") and got[1]["outcome"] != "success"
    with pytest.raises(L.LayoutError):
        check([files[1], files[1]])
    one = extract(a, files[:1])
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    labelled = label.label(a, files[0].model, 0.0).withColumn("contaminant_ix", F.lit(None).cast("int"))
    assert sorted(map(str, one.collect())) == sorted(map(str, mates.combine(filters.low_complexity(labelled, 100.0)).collect()))


def test_fit_and_choice(spark):
    p = simulate.Plan(reads=300, barcodes=("ACAGTG", "TTAGGC", "GATCAG"), read_length=24)
    some = simulate.simulate(spark, p)
    right, wrong = L.parse("B:ACAGTG,TTAGGC,GATCAG R:N"), L.parse("B:CCCCCC,GGGGGG R:N")
    layout, certainty = choose.choose(some, [wrong, right])
    assert layout == right and certainty > 0.99
    log = Run()
    f = fit(some, [right], Options(calibration_reads=400), log)
    assert 0 < f.threshold <= calibrate.MOST and log.messages
    got = extract(some, [f])
    report(totals(got).first().asDict(), log)
    assert totals(got).first()["total"] == 300
    assert fit(some, [L.parse("R:N")]).threshold == 0
    assert fit(some, [right], Options(threshold=3.0)).threshold == 3.0


def test_stats(spark):
    s = stats.sequence_stats(reads(spark, ["ACGTA", "GTAAA", "NNN"]), L.parse("P:TTACGTA R:N"))
    assert s.average_length == 4 and s.max_length == 5 and sum(s.background) == pytest.approx(1)
    assert (s.mean_5, s.sd_5) == (7.0, 1.0)  # a single hit is not enough
    empty = stats.sequence_stats(reads(spark, []).limit(0))
    assert empty.average_length == 1 and sum(empty.background) == pytest.approx(1)


def test_simulation_is_the_same_in_any_partition(spark):
    p = simulate.Plan(reads=50, barcodes=("ACAGTG",), linker_5="AAGG", linker_3="CCTT", read_length_mod=3, error_rate=0.1, indel_fraction=0.3, end_loss=2)
    a = [tuple(r) for r in simulate.simulate(spark, p).orderBy("ord").collect()]
    assert a == [(0, i, n, s, "I" * len(s)) for i, (n, s) in ((i, simulate.one(p, i)) for i in range(50))]
    assert simulate.Plan(reads=10_000).real == 8999
    assert L.parse(simulate.layout_words(p)) == L.parse("P:AAGG B:ACAGTG R:N P:CCTT")


TAGS = ("AAGGGG", "TTGGCA", "AACCCC", "GATCAG")
LINKERS = {"linker_5": "GGGGGGG", "linker_3": "TTTTTTT"}


@pytest.mark.parametrize("tags,linkers,paired,kappa,error", [(TAGS, {}, False, 0.9739, 0.0), (TAGS, LINKERS, False, 0.9874, 0.0013), ((), LINKERS, True, 1.0, 0.0017), (TAGS, LINKERS, True, 0.9874, 0.0013)])
def test_accuracy_comes_near_the_published_figures(spark, tags, linkers, paired, kappa, error):
    """10,000 reads at two percent of errors, a tenth of them random; mates without barcode.  The random numbers are others."""
    p = simulate.Plan(reads=10_000, barcodes=tags, read_length=20, **linkers)
    o = Options(calibration_reads=20_000)
    files = [simulate.simulate(spark, p)] + [simulate.simulate(spark, simulate.Plan(reads=10_000, read_length=20, random_fraction=0.0), 1)] * paired
    fitted = [fit(x, [L.parse(w)], o) for x, w in zip(files, (simulate.layout_words(p), "R:N"), strict=False)]
    done = extract(files[0].unionByName(files[1]) if paired else files[0], fitted, o)
    first = F.filter("files", lambda f: f["file_ix"] == 0)[0]
    file = F.when(F.col("outcome") == "success", F.coalesce("barcode", F.lit("READ1"))).otherwise("un")
    row = evaluate.evaluate(done.select(file.alias("file"), first["name"].alias("name"), first["payloads"][0]["seq"].alias("seq")), expected_real=p.real, expected_random=10_000 - p.real).first()
    assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == 10_000
    assert abs(row["kappa"] - kappa) < 0.02 and row["sensitivity_all"] > 0.98 and row["avg_error"] < error + 0.005


def test_reads_add_up_whatever_is_known(spark):
    read = lambda k, library, file: (file, f"x{k};SEQ:{'ACGT' if library else 'NONE'};RBC:z;BARNUM:{library}", "ACGT")
    rows = [read(k, 1, "f1") for k in range(4)] + [read(9, 1, "f2"), read(10, 2, "f2"), read(11, 2, "f2"), read(12, 2, "un"), read(13, 0, "un"), read(14, 0, "f1")]
    some = spark.createDataFrame(rows, "file string, name string, seq string")
    get = lambda *a: evaluate.evaluate(some, "p", *a).select("tp", "fp", "fn", "tn", "missed").first()
    assert tuple(get()) == (6, 3, 0, 1, 1)
    assert tuple(get(10, 5)) == (6, 3, 2, 4, 3)  # 15 reads: two real and three random ones are in no file
    assert tuple(get(1, 1)) == (6, 3, 0, 1, 1)
    assert evaluate.evaluate(some, "p", 10, 5).first()["sensitivity_all"] == pytest.approx(6 / 9)
    assert tuple(evaluate.evaluate(some.limit(0), "p", 3, 2).select("tp", "fp", "fn", "tn", "missed").first()) == (0, 0, 3, 2, 3)


def test_calibration_draws_long_reads_whole(spark):
    m = build(L.parse("B:ACAGTG,TTAGGC R:N"), Stats((0.25, 0.25, 0.25, 0.24, 0.01), 600, 600), Options())
    rng = np.random.default_rng(1)
    drawn, noise = calibrate.Sampler(m, 600).draw(rng, 200), calibrate.emit_random_many(m, rng, 200, 600)
    assert len(drawn) == len(noise) == 200 and min(map(len, drawn + noise)) >= 600
    assert sum(s[:6] in ("ACAGTG", "TTAGGC") for s in drawn) > 120 > 20 > sum(s[:6] in ("ACAGTG", "TTAGGC") for s in noise)
    short = build(L.parse("B:ACAGTG,TTAGGC R:N"), STATS, Options())
    o = Options(calibration_reads=3000)
    rows = sorted(map(tuple, calibrate.simulated(spark, short, o).collect()))
    assert len(rows) == 3000 and sum(r for _, r in rows) == 1500
    q = sorted({round(x, 2) for x, _ in rows})
    value = lambda t: sum(r for x, r in rows if round(x, 2) >= t) / 1500 - sum(not r for x, r in rows if round(x, 2) >= t) / 1500
    got = calibrate.calibrate(spark, short, o)
    assert value(got) == pytest.approx(max(map(value, q))) and got == calibrate.calibrate(spark, short, o)


def test_many_barcodes_go_to_the_nearest(spark):
    r = random.Random(3)
    codes = [("".join(r.choice("ACGT") for _ in range(r.choice((7, 8)))), k) for k in range(3000)]
    table = [(f"S{k}", b) for b, k in codes]
    tags = [b for b, _ in codes[:40]] + ["".join(r.choice("ACGTN") for _ in range(8)) for _ in range(60)] + ["", "ACG", None]
    some = spark.createDataFrame([(i, t, (t or "") + "ACGT") for i, t in enumerate(tags)], "i int, tag string, seq string")
    away = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 99
    for most in (None, 1):
        for x in demux.nearest_barcode(some, table, F.col("tag"), most).collect():
            best = min(((away(x["tag"], b), b, s) for s, b in table if x["tag"] is not None and len(b) == len(x["tag"])), default=None)
            want = (None, None, None) if best is None or most is not None and best[0] > most else (best[2], best[1], best[0])
            assert (x["sample"], x["barcode"], x["distance"]) == want
    for x in demux.exact_prefix(some, table).collect():
        assert x["sample"] == next((s for s, b in table if x["seq"].startswith(b)), None)
    few = table[:20]
    assert [tuple(x) for x in demux._tagged(some, F.col("tag"), demux._nearest(sorted(few, key=lambda b: b[::-1]), None), "sample string, barcode string, distance int").orderBy("i").collect()] == [tuple(x) for x in demux.nearest_barcode(some, few, F.col("tag")).orderBy("i").collect()]


def test_rename_and_numbers(spark):
    some = spark.createDataFrame([(0, "x_ACGT;y", "AA"), (1, "x_ACGA;y", "CC"), (2, "x_TTTT", "GG"), (3, "none", "TT")], "ord bigint, name string, seq string")
    table = spark.createDataFrame([("b", "TTTT"), ("a", "ACGT")], "sample string, barcode string")
    got = [r["header"] for r in demux.rename(some, table).orderBy("ord").collect()]
    assert got == ["a_1 x_ACGT;y orig_bc=ACGT new_bc=ACGT bc_diffs=0", "a_2 x_ACGA;y orig_bc=ACGA new_bc=ACGT bc_diffs=1", "b_1 x_TTTT orig_bc=TTTT new_bc=TTTT bc_diffs=0"]
    n = demux.numbered(spark.range(100).withColumn("g", F.col("id") % 3), "g", "id", block=7)
    assert all(r["number"] == r["id"] // 3 + 1 for r in n.collect())


def test_pairs_and_molecules(spark):
    left = reads(spark, ["ACGTACGTTTGACCATTGACAGG", "AAAA"]).drop("file_ix")
    right = left.withColumn("seq", F.when(F.col("ord") == 0, S.reverse_complement(F.lit("TTTGACCATTGACAGGCCCTTAG"))).otherwise("CCCC")).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    got = pairs.merge_pairs(left, right, 10).collect()
    assert [(r["ord"], r["seq"]) for r in got] == [(0, "ACGTACGTTTGACCATTGACAGGCCCTTAG")]
    assert pairs.trim_exact(left, "ANGT", 4).first()["seq"] == "ACGTTTGACCATTGACAGG"
    m = umi.molecules(spark.createDataFrame([(1, "c", 5), (1, "c", 5), (2, "c", 5)], "fp bigint, chrom string, pos int"))
    assert tuple(umi.per_chrom(m).first()) == ("c", 2, 3)


def test_training_raises_the_likelihood(spark):
    from readloom.operators.train import train

    p = simulate.Plan(reads=120, barcodes=("ACAGTG", "TTAGGC"), read_length=22, error_rate=0.1, random_fraction=0.0)
    m = build(L.parse("B:ACAGTG,TTAGGC R:N"), STATS, Options())
    trained, logs = train(simulate.simulate(spark, p), m, 4)
    assert all(b > a - 1e-3 for a, b in zip(logs, logs[1:], strict=False)) and logs[-1] > logs[0] + 1
    assert abs(trained.step.sum(1) + trained.end - 1).max() < 1e-9
    assert ((trained.step > 0) <= (m.step > 0)).all()


def test_sql_functions(spark):
    from readloom.functions.udfs import register_edit_search, register_label

    S.register(spark)
    register_edit_search(spark)
    register_label(spark, build(L.parse("B:ACAGTG,TTAGGC R:N"), STATS, Options()))
    row = spark.sql(f"SELECT revcomp('ACGN') AS rc, dust_score('{'A' * 20}') AS d, edit_search('ACGT', 'TTACTTT') AS e, edit_search_end('ACGT', 'ACGTT') AS g, label_read('ACAGTG{PAYLOAD}') AS r").first()
    assert (row["rc"], row["e"], row["g"]) == ("NCGT", 1, 1) and row["d"] == pytest.approx(90) and row["r"]["q"] > 5
    assert value(spark, S.dust_score(F.col("s")), s="A" * 20) == row["d"]


def test_lcg():
    from readloom.functions.lcg import Lcg

    a, b = Lcg(7), Lcg(7)
    x = [a.draw() for _ in range(1000)]
    assert x == [b.draw() for _ in range(1000)] and min(x) >= 0 and max(x) < 32768 and 0.45 < sum(v / 32768 for v in x) / 1000 < 0.55
    assert 0 <= Lcg(1).share() < 1
