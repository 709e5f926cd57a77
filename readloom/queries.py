"""Queries over sequencing reads, and the same in SQL.

There are no sequencing files among the tables, so reads are derived from the keys of ``orders``: 32 bases of a
hash each, the same in any engine.  Every query goes through the package's operators."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import sequence as S
from .operators import calibrate, choose, demux, evaluate, filters, label, mates, pairs, simulate, stats, umi
from .operators.choose import posterior
from .plans import layout as L
from .plans.model import Options, Stats, build
from .plans.run import Fitted, extract
from .sources import reads as R, sinks
from .sources.scratch import scratch

Query = Callable[[SparkSession, str], DataFrame]

#: Sixteen two-base samples, and four of six bases.
SAMPLES = [(f"S{i:02d}", a + b) for i, (a, b) in enumerate((a, b) for a in "ACGT" for b in "ACGT")]
BARCODES = [("S1", "ACAGTG"), ("S2", "ACTTGA"), ("S3", "TTAGGC"), ("S4", "GATCAG")]
ADAPTER = "ACGTTGCA"
BACKGROUND = Stats((0.25, 0.25, 0.25, 0.24, 0.01), 32.0, 32)

READS = "SELECT o_orderkey AS ord, o_custkey, translate(md5(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM orders"
MATES = "SELECT o_orderkey AS ord, translate(md5(CAST(o_orderkey AS VARCHAR) || 'b'), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM orders"


def _bases(text: Column) -> Column:
    return F.translate(F.md5(text), "0123456789abcdef", "ACGTACGTACGTACGT")


def reads(spark: SparkSession, sf_dir: str, salt: str = "") -> DataFrame:
    """(file_ix, ord, o_custkey, name, seq, qual) of every order."""
    key = F.col("o_orderkey").cast("string")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.concat(F.lit("R"), key, F.lit(";FP:"), F.col("o_custkey").cast("string"), F.lit(";BC:"), F.substring(_bases(key), 1, 6))
    return rows.select(F.lit(0).alias("file_ix"), F.col("o_orderkey").cast("bigint").alias("ord"), "o_custkey", name.alias("name"), _bases(F.concat(key, F.lit(salt))).alias("seq"), F.repeat(F.lit("I"), F.lit(32)).alias("qual"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of complex sequence per sample: nearest barcode, low-complexity filter, counts and mean distance."""
    found = demux.nearest_barcode(reads(spark, sf_dir), BARCODES, F.substring("seq", 1, 6))
    return found.where(S.dust_score(F.col("seq")) <= 100).groupBy("sample", "barcode").agg(F.count("*").alias("n"), F.sum("distance").cast("bigint").alias("differences"))


_CODES = ", ".join(f"('{s}', '{b}')" for s, b in BARCODES)
_HAMMING = "list_sum(list_transform(range(1, 7), lambda i: CASE WHEN substr({a}, i, 1) <> substr({b}, i, 1) THEN 1 ELSE 0 END))"
_DUST = """(WITH t AS (SELECT unnest(list_transform(range(1, length({s}) - 1), lambda i: substr({s}, i, 3))) AS w),
  c AS (SELECT COUNT(*) AS n FROM t GROUP BY w) SELECT 10.0::DOUBLE * SUM(n * (n - 1) / 2)::DOUBLE / (length({s}) - 3)::DOUBLE FROM c)"""
_NEAREST = f"""nearest AS (SELECT r.ord, r.seq, r.o_custkey, s.sample, s.barcode, s.distance FROM reads r JOIN (
    SELECT p.six, c.sample, c.barcode, {_HAMMING.format(a="p.six", b="c.barcode")} AS distance,
      row_number() OVER (PARTITION BY p.six ORDER BY {_HAMMING.format(a="p.six", b="c.barcode")}, c.barcode) AS k
    FROM (SELECT DISTINCT substr(seq, 1, 6) AS six FROM reads) p, (VALUES {_CODES}) AS c(sample, barcode)) s ON s.six = substr(r.seq, 1, 6) AND s.k = 1)"""


def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


def q_revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("ord", S.reverse_complement(F.col("seq")).alias("rc"))


def q_clean_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("seq", 1, 1)
    odd = F.concat(F.substring("seq", 1, 4), F.lit("uxn."))
    return reads(spark, sf_dir).select("ord", S.clean(odd).alias("cleaned"), S.base_code(first).cast("bigint").alias("code"))


def q_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = reads(spark, sf_dir).agg(*[c.cast("double").alias(k) if k == "avg_len" else c.cast("bigint").alias(k) for k, c in stats.stats_columns().items()])
    total = sum((F.col(f"n_{b}") for b in "acgtn"), F.lit(0))
    return row.select("*", *[F.round(F.col(f"n_{b}") / total, 9).alias(f"p_{b}") for b in "acgtn"])


def q_umi_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.substring("seq", 1, 8)
    return reads(spark, sf_dir).select("ord", S.umi_key(u).alias("fp"), S.umi_bases(S.umi_key(u), F.lit(8)).alias("bases"))


def q_name_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return reads(spark, sf_dir).select("ord", S.name_tag(n, "FP").cast("bigint").alias("fp"), S.name_tag(n, "BC").alias("bc"), S.name_tag(n, "XX").alias("missing"))


def q_counts_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("ord", S.count_overlapping(F.col("seq"), "aa").cast("bigint").alias("n"), S.find_end(F.col("seq"), "ACG").cast("bigint").alias("found_end"))


def q_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("ord", S.hamming(F.substring("seq", 1, 8), F.substring("seq", 9, 8)).cast("bigint").alias("distance"))


def q_phred(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.char((F.col("ord") % 41 + 33).cast("bigint"))
    return reads(spark, sf_dir).select("ord", F.round(S.right_probability(c), 9).alias("right"))


def q_dust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("ord", F.round(S.dust_score(F.col("seq")), 6).alias("score"))


def q_random_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("ord", F.round(S.random_log_likelihood(F.col("seq"), list(BACKGROUND.background), BACKGROUND.average_length), 5).alias("log_random"))


def q_read_model_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over all reads of the log-likelihood of a model of nothing but a read, which has a closed form."""
    m = build(L.parse("R:N"), BACKGROUND, Options())
    out = label.log_likelihoods(reads(spark, sf_dir), [m])
    return out.select(F.col("layout_id").cast("bigint").alias("layout_id"), F.round("log_likelihood", 2).alias("log_likelihood"))


def q_partial_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    some = reads(spark, sf_dir).select("ord", S.partial_prefix(s, ADAPTER).cast("bigint").alias("len_5"), S.partial_suffix(s, ADAPTER).cast("bigint").alias("len_3"))
    return some


def q_exact_demux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demux.exact_prefix(reads(spark, sf_dir), SAMPLES).groupBy("sample").agg(F.count("*").alias("n"))


def q_nearest_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = demux.nearest_barcode(reads(spark, sf_dir), BARCODES, F.substring("seq", 1, 6))
    return out.select("ord", "sample", "barcode", F.col("distance").cast("bigint").alias("distance"))


def q_payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads behind the first A of a window, at least 24 bases long."""
    return filters.long_payloads(reads(spark, sf_dir), F.expr("substring(seq, nullif(locate('A', seq, 3), 0) + 1)"), 24).select("ord", "payload")


def q_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = reads(spark, sf_dir).withColumn("flag", (F.col("ord") % 2048).cast("int"))
    return filters.flags_without(flagged).groupBy((F.col("flag") % 4).cast("bigint").alias("low")).agg(F.count("*").alias("n"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files with made-up outcomes."""
    names = F.array(*map(F.lit, label.OUTCOMES))
    base = reads(spark, sf_dir)
    parts = [base.select(F.lit(k).alias("file_ix"), "ord", "name", F.element_at(names, (F.col("ord") * (k + 3) % 7 % 6 + 1).cast("int")).alias("outcome"), F.when(F.lit(k) == 0, F.substring("seq", 1, 6)).alias("barcode"), F.lit(None).cast("int").alias("contaminant_ix"), F.lit(None).cast("bigint").alias("fp"), F.lit(None).cast("string").alias("fp_seq"), F.lit(1.0).alias("q"), F.array(F.struct(F.col("seq").alias("seq"), F.col("qual").alias("qual"))).alias("payloads")) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def q_mate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mates.combine(_outcomes(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("n"), F.count("barcode").alias("with_barcode"))


def q_output_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mates.output_reads(mates.combine(_outcomes(spark, sf_dir)))
    return out.where("outcome = 'success'").select("ord", F.col("read_ix").cast("bigint").alias("read_ix"), "barcode", "seq")


def q_mate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = reads(spark, sf_dir)
    return mates.counts(a.unionByName(a.withColumn("file_ix", F.lit(1)).where("ord % 3 <> 0"))).select(F.col("file_ix").cast("bigint").alias("file_ix"), "n")


def q_name_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose mates' names differ in the fields that have to agree."""
    a = reads(spark, sf_dir)
    name = lambda k: F.concat(F.lit("NV042:17:KX3PLM:4:1208:"), F.col("ord").cast("string"), F.lit(":"), (F.when(F.col("ord") % 97 == 0, F.col("ord") + k).otherwise(F.col("ord"))).cast("string"), F.lit(f" {k + 1}:Y:18:ATCACG"))
    both = a.withColumn("name", name(0)).unionByName(a.withColumns({"file_ix": F.lit(1), "name": name(1)}))
    return mates.unlike_names(both).select("ord", F.col("names")[0].alias("first"), F.col("names")[1].alias("second"))


def q_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame(BARCODES, "sample string, barcode string")
    some = reads(spark, sf_dir).withColumn("name", F.concat(F.lit("r_"), F.substring("seq", 1, 6), F.lit(";x")))
    return demux.rename(some, table)


def q_contaminants_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of eight bases held exactly against two references, on both strands."""
    refs = [(0, "ACGTACGTTTGACCATTGACAGGATTACA" * 3), (1, "GATTACACCCGGTTTAAACCGGTACGT" * 4)]
    probes = reads(spark, sf_dir).select("ord", F.substring("seq", 1, 6).alias("probe"))
    hit = filters.match_references(probes, refs, 0)
    return hit.where("hit is not null").select("ord", F.col("hit.reference").cast("bigint").alias("reference"))


def q_edit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads whose first eight bases occur in a reference with at most one error."""
    hit = filters.match_references(reads(spark, sf_dir).select("ord", F.substring("seq", 1, 8).alias("probe")), [(0, "ACGTACGTTTGACCATTGACAGGATTACACCGGT")], 1)
    return hit.where("hit is not null").select("ord", F.col("hit.errors").cast("bigint").alias("errors"))


def _molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    return umi.molecules(r.select(S.umi_key(F.substring("seq", 1, 3)).alias("fp"), F.concat(F.lit("chr"), (F.col("o_custkey") % 22).cast("string")).alias("chrom"), (F.col("o_custkey") % 7).cast("bigint").alias("pos")))


def q_umi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return umi.per_chrom(_molecules(spark, sf_dir))


def q_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    part = lambda k: r.where(F.substring("seq", k, 1) == "A").groupBy(F.substring("seq", 2, 5).alias("tag")).agg(F.count("*").alias("n"))
    return umi.side_by_side(part(1), part(9), "tag", "n")


def q_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = umi.per_chrom(_molecules(spark, sf_dir)).select(F.col("with_umi").alias("a"), F.col("without_umi").alias("b"))
    return umi.correlation(both).select(F.round("r", 9).alias("r"))


def q_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of made-up files of extracted reads, whose names hold their truth."""
    r = reads(spark, sf_dir)
    k = F.col("ord") % 5
    name = F.concat(F.lit("x;SEQ:"), F.when(k == 0, "NONE").otherwise(F.substring("seq", 7, 20)), F.lit(";RBC:z;BARNUM:"), k.cast("string"))
    file = F.when((k == 0) | (F.col("ord") % 31 == 0), "un").when(F.col("ord") % 53 == 0, "f2").otherwise(F.concat(F.lit("f"), k.cast("string")))
    got = r.select(file.alias("file"), name.alias("name"), F.substring("seq", 7, 18).alias("seq"))
    out = evaluate.evaluate(got)
    return out.select("program", *[F.round(c, 9).alias(c) for c in ("sensitivity", "specificity", "precision", "kappa", "avg_error")], "tp", "fp", "fn", "tn")


def q_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = reads(spark, sf_dir).select((F.col("ord") % 40).cast("double").alias("q"), (F.col("o_custkey") % 40 < F.col("ord") % 40).alias("is_real"))
    return calibrate.sweep(scored).select("q", F.round("sensitivity", 9).alias("sensitivity"), F.round("specificity", 9).alias("specificity"))


def q_layout_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax of summed figures per candidate."""
    sums = reads(spark, sf_dir).groupBy((F.col("ord") % 4).cast("bigint").alias("candidate")).agg((F.sum(F.length(F.translate("seq", "CGT", ""))) / 1000.0).cast("double").alias("x")).orderBy("candidate").collect()
    p = posterior([r["x"] for r in sums])
    return spark.createDataFrame([(r["candidate"], float(round(v, 9))) for r, v in zip(sums, p, strict=True)], "candidate bigint, p double")


def q_merge_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all reads that overlap by 20 bases, merged."""
    r = reads(spark, sf_dir)
    left = r.select("ord", "name", F.substring("seq", 1, 26).alias("seq"), F.lit("I" * 26).alias("qual"))
    right = r.select("ord", "name", S.reverse_complement(F.substring("seq", 7, 26)).alias("seq"), F.lit("I" * 26).alias("qual"))
    return pairs.merge_pairs(left, right, 16).select("ord", "seq", F.length("qual").cast("bigint").alias("n_qual"), F.round("identity", 6).alias("identity"), F.col("shift").cast("bigint").alias("shift"))


def q_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.join_pairs(reads(spark, sf_dir).select("ord", "name", "seq", "qual"), reads(spark, sf_dir, "b").select("ord", "name", "seq", "qual"), "NNN").select("ord", "seq", "qual")


def q_trim_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.trim_exact(reads(spark, sf_dir), "ACNT", 16).select("ord", "seq", "qual")


def q_split_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.split_by_tag(reads(spark, sf_dir), "BC").groupBy("part").agg(F.count("*").alias("n"))


def q_barcode_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least edit distance between the barcodes of each customer's reads, of all customers with a few."""
    return demux.least_distances(reads(spark, sf_dir), "o_custkey", F.substring("seq", 1, 6))


def q_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information content of each of the first eight places of all reads, against even bases."""
    return stats.information(reads(spark, sf_dir), 8).select("place", F.round("bits", 9).alias("bits"))


def q_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir).select("ord", F.substring("seq", 1, 1).alias("sample"))
    return demux.numbered(r, "sample", "ord", block=1000).select("ord", "sample", F.col("number").cast("bigint").alias("number"))


def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.summary(_outcomes(spark, sf_dir)).select("outcome", "n", "percent")


def q_low_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filters.low_complexity(_outcomes(spark, sf_dir), 8.0)
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


def q_distinct_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of two lists, each once: of the first three bases of every read, and of the three behind them."""
    r = reads(spark, sf_dir)
    part = lambda at: r.select(F.concat(F.lit("B:"), F.substring("seq", at, 3), F.lit(" R:N")).alias("layout"))
    return choose.concatenate(part(1), part(4))


def spread(rows: DataFrame) -> DataFrame:
    """The same rows over all cores: scoring a read costs far more than moving it, and a small table is read by one task."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


# -- queries without SQL ----------------------------------------------------------------------------


def _fitted(threshold: float = 1.5) -> Fitted:
    layout = L.parse("B:" + ",".join(b for _, b in BARCODES) + " R:N")
    return Fitted(layout, build(layout, BACKGROUND, Options()), threshold)


def q_label_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fitted()
    return label.label(spread(reads(spark, sf_dir)), f.model, f.threshold).select("ord", "outcome", F.round("q", 4).alias("q"), "barcode", F.size("labels").alias("n_labels"), F.col("payloads")[0]["seq"].alias("payload"))


def q_extract_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files: reads with a barcode, and plain mates; outcomes combined."""
    both = reads(spark, sf_dir).unionByName(reads(spark, sf_dir, "b").withColumn("file_ix", F.lit(1)))
    plain = L.parse("R:N")
    out = extract(spread(both), [_fitted(), Fitted(plain, build(plain, BACKGROUND, Options()), 0.0)])
    return out.select("ord", "outcome", "barcode", F.size("files").alias("files"))


def q_simulate_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simulated read for each order, labelled and held against its truth."""
    keys = reads(spark, sf_dir).select("ord")
    p = simulate.Plan(reads=keys.count(), barcodes=tuple(b for _, b in BARCODES), read_length=20)
    f = _fitted()
    got = label.label(simulate.simulate(spark, p, keys=spread(keys)), f.model, f.threshold)
    file = F.when(F.col("outcome") == "success", F.col("barcode")).otherwise("un")
    return evaluate.evaluate(got.select(file.alias("file"), "name", F.col("payloads")[0]["seq"].alias("seq")))


#: Contaminants: two of a repeated word, and one that is not.
_CONTAMINANTS = ("ACGT" * 20, "GATTACA" * 12, "TTGCAGGATCCGTTAACGCATGACCTGAAGTCTCGGATAACCTTGCAAGCGTATTCGACAG")


def _held_against(spark: SparkSession, rows: DataFrame, refs: tuple[str, ...]) -> DataFrame:
    got = label.label(spread(rows), build(L.parse("R:N"), BACKGROUND, Options()), 0.0)
    return filters.contaminants(got, spark.createDataFrame(list(enumerate(refs)), "ref_ix int, seq string"))


def q_contaminants_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_against(spark, reads(spark, sf_dir), _CONTAMINANTS[:2]).groupBy("outcome", "contaminant_ix").agg(F.count("*").alias("n"))


def q_contaminants_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads from contaminants, with up to four errors of every sort, half of them from the other strand; two errors are allowed."""
    piece = F.substring(F.element_at(F.array(*map(F.lit, _CONTAMINANTS)), (F.col("ord") % 3 + 1).cast("int")), (F.col("ord") % 23 + 1).cast("int"), F.lit(36))
    e, own = F.floor(F.col("ord") / 4) % 5, lambda k: F.substring("seq", k, 1)
    part = lambda a, n: F.substring(F.col("piece"), a, n)
    middle = F.when(e >= 2, part(11, 4)).otherwise(part(10, 5))  # a base left out
    more = F.when(e >= 3, F.concat(own(2), own(3))).otherwise("")  # two put in
    rows = reads(spark, sf_dir).withColumn("piece", piece)
    seq = F.concat(part(1, 4), F.when(e >= 1, own(1)).otherwise(part(5, 1)), part(6, 4), middle, part(15, 6), more, part(21, 4), F.when(e >= 4, own(4)).otherwise(part(25, 1)), part(26, 11))
    cut = F.substring(seq, 1, 32)
    rows = rows.withColumn("seq", F.when(F.col("ord") % 2 == 0, cut).otherwise(S.reverse_complement(cut))).withColumn("qual", F.lit(None).cast("string"))
    return _held_against(spark, rows.drop("piece"), _CONTAMINANTS).select("ord", "outcome", F.col("contaminant_ix").cast("bigint").alias("contaminant_ix"))


#: A barcode, a UMI of four bases, a spacer and a read.
_SEGMENTS = "B:" + ",".join(b for _, b in BARCODES) + " F:NNNN S:GATTCA R:N"


def _composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that the layout shows without errors: the barcode follows the order's key, the rest its hash."""
    code = F.element_at(F.array(*[F.lit(b) for _, b in BARCODES]), (F.col("ord") % 4 + 1).cast("int"))
    return reads(spark, sf_dir).withColumn("seq", F.concat(code, F.substring("seq", 29, 4), F.lit("GATTCA"), "seq")).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))


def q_label_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads taken apart into barcode, UMI, spacer and payload."""
    layout = L.parse(_SEGMENTS)
    out = label.label(spread(_composed(spark, sf_dir)), build(layout, BACKGROUND, Options()), 0.0)
    return out.select("ord", "outcome", "barcode", "fp", "fp_seq", F.col("payloads")[0]["seq"].alias("payload"), F.length(F.col("payloads")[0]["qual"]).cast("bigint").alias("n_qual"))


def q_label_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of reads whose payload is cut to 0 to 31 bases: under 16 are too short."""
    some = _composed(spark, sf_dir).withColumn("seq", F.expr("substring(seq, 1, int(16 + 8 + ord % 24))")).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    out = label.label(spread(some), build(L.parse(_SEGMENTS), BACKGROUND, Options()), 0.0)
    return out.groupBy("outcome", "barcode").agg(F.count("*").alias("n"))


def spaced(n: int, length: int, distance: int) -> list[str]:
    """The first n tags in the order of the alphabet that differ from all before them in so many places."""
    out: list[str] = []
    for letters in itertools.product("ACGT", repeat=length):
        if all(sum(map(str.__ne__, letters, t)) >= distance for t in out):
            out.append("".join(letters))
            if len(out) == n:
                break
    return out


#: A plate of samples.
PLATE = spaced(96, 8, 4)


def _plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 96 samples; one base within the barcode of every second one is wrong."""
    code = F.element_at(F.array(*[F.lit(b) for b in PLATE]), (F.col("ord") % 96 + 1).cast("int"))
    at = (F.lit(3) + F.col("ord") % 4).cast("int")
    wrong = F.concat(F.substring(code, F.lit(1), at - 1), F.translate(F.substring(code, at, F.lit(1)), "ACGT", "CGTA"), F.substring(code, at + 1, F.lit(8)))
    return reads(spark, sf_dir).withColumn("seq", F.concat(F.when(F.floor(F.col("ord") / 96) % 2 == 0, code).otherwise(wrong), "seq")).withColumn("qual", F.lit(None).cast("string"))


def q_label_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 96 barcodes of eight bases, half of them with an error."""
    layout = L.parse("B:" + ",".join(PLATE) + " R:N")
    out = label.label(spread(_plate(spark, sf_dir)), build(layout, BACKGROUND, Options()), 0.0)
    return out.select("ord", "outcome", "barcode", F.col("payloads")[0]["seq"].alias("payload"))


def q_label_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over reads of 96 barcodes, half of them with an error, and random ones that are too short for the layout."""
    rows, random = _plate(spark, sf_dir), F.col("ord") % 10 == 9
    truth = F.concat(F.lit("READ;SEQ:"), F.substring("seq", 9, 32), F.lit(";RBC:x;BARNUM:"), (F.col("ord") % 96 + 1).cast("string"))
    rows = rows.withColumn("name", F.when(random, "RAND;SEQ:NONE;RBC:NONE;BARNUM:0").otherwise(truth)).withColumn("seq", F.when(random, F.substring("seq", 9, 12)).otherwise(F.col("seq")))
    got = label.label(spread(rows), build(L.parse("B:" + ",".join(PLATE) + " R:N"), BACKGROUND, Options()), 0.0)
    file = F.when(F.col("outcome") == "success", F.col("barcode")).otherwise("un")
    return evaluate.evaluate(got.select(file.alias("file"), "name", F.col("payloads")[0]["seq"].alias("seq")))


#: An adapter at either end, an optional base, a barcode, a spacer, a UMI and a read.
_TYPES = f"P:{ADAPTER} O:T B:" + ",".join(b for _, b in BARCODES[:2]) + " S:GATTCA F:NNNN R:N P:CCGGTTAACC"


def q_label_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of all sorts of segments; of every third the optional base is missing, and a base of the spacer is wrong in others."""
    code = F.when(F.col("ord") % 2 == 0, BARCODES[0][1]).otherwise(BARCODES[1][1])
    spacer = F.when(F.col("ord") % 5 == 1, "GATCCA").otherwise("GATTCA")
    seq = F.concat(F.lit(ADAPTER), F.when(F.col("ord") % 3 == 0, "").otherwise("T"), code, spacer, F.substring("seq", 29, 4), F.lit("ACACACACACACACACACACAC"), F.lit("CCGGTTAACC"))
    rows = reads(spark, sf_dir).withColumn("seq", seq).withColumn("qual", F.lit(None).cast("string"))
    stats = Stats(BACKGROUND.background, 56.0, 56, 8.0, 1.0, 10.0, 1.0)
    out = label.label(spread(rows), build(L.parse(_TYPES), stats, Options()), 0.0)
    return out.select("ord", "outcome", "barcode", "fp_seq", F.col("payloads")[0]["seq"].alias("payload"))


def q_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold that calibration takes, from fixed confidences."""
    scored = reads(spark, sf_dir).select(((F.col("ord") % 389) / 10).cast("double").alias("q"), ((F.col("o_custkey") * 7) % 389 < F.col("ord") % 389).alias("is_real"))
    return calibrate.best_threshold(scored).select("q", F.round("sensitivity", 9).alias("sensitivity"), F.round("specificity", 9).alias("specificity"))


def _written(spark: SparkSession, sf_dir: str, record: Column, end: str, head: str | None = None) -> str:
    """A folder of files with a record of each read, in the order of the keys."""
    path = f"{scratch(spark)}.{end}"
    lines = reads(spark, sf_dir).orderBy("ord").select(record.alias("value"))
    (lines if head is None else spark.createDataFrame([(head,)], "value string").coalesce(1).union(lines)).write.text(path)
    return path


def q_fastq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as a folder of FASTQ files, and read back."""
    path = _written(spark, sf_dir, sinks.fastq(F.concat(F.lit("r "), F.col("ord").cast("string")), F.col("seq"), F.col("qual")), "fastq")
    return R.read(spark, [path]).select("ord", "name", "seq", F.length("qual").cast("bigint").alias("n_qual"))


def q_fasta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as a folder of FASTA files with three lines of bases each, and read back."""
    path = _written(spark, sf_dir, F.concat(F.lit(">r"), F.col("ord").cast("string"), *[x for k in (1, 14, 27) for x in (F.lit("\n"), F.substring("seq", k, 13))]), "fasta")
    return R.read(spark, [path]).select("ord", "name", "seq", "qual")


def q_sam_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as a folder of SAM files, and read back without those of the flags 768."""
    s = lambda c: c.cast("string")
    flag = F.when(F.col("ord") % 3 == 0, 256).when(F.col("ord") % 5 == 0, 512).otherwise(16)
    fields = [F.concat(F.lit("r"), s(F.col("ord"))), s(flag), *map(F.lit, ("chr1", "100")), s(F.col("ord") % 61), *map(F.lit, ("32M", "*", "0", "0")), F.col("seq"), F.col("qual"), F.concat(F.lit("NM:i:"), s(F.col("ord") % 4))]
    path = _written(spark, sf_dir, F.concat_ws("\t", *fields), "sam", "@HD\tVN:1.6")
    out = R.read_sam(spark, path)
    return out.select("ord", "name", "seq", F.col("flag").cast("bigint").alias("flag"), F.col("mapq").cast("bigint").alias("mapq"), F.col("nm").cast("bigint").alias("nm"))


_PUBLIC = [n for n in dict(globals()) if n.startswith("q_")]


def queries() -> dict[str, Query]:
    return {n[2:]: globals()[n] for n in _PUBLIC}


def _with(*parts: str) -> str:
    return "WITH " + ", ".join([f"reads AS ({READS})", *parts]) + " "


_COMPOSED = "composed AS (SELECT ord, list_extract([" + ", ".join(f"'{b}'" for _, b in BARCODES) + "], CAST(ord % 4 + 1 AS INTEGER)) AS barcode, substr(seq, 29, 4) AS umi, seq FROM reads)"
_OUT = ", ".join(f"'{x}'" for x in label.OUTCOMES)
_FILES = f"""files AS (SELECT 0 AS file_ix, ord, list_extract([{_OUT}], CAST(ord * 3 % 7 % 6 + 1 AS INTEGER)) AS outcome, substr(seq, 1, 6) AS barcode, seq FROM reads
  UNION ALL SELECT 1, ord, list_extract([{_OUT}], CAST(ord * 4 % 7 % 6 + 1 AS INTEGER)), NULL, seq FROM reads)"""
_WORST = f"list_extract([{_OUT}], CAST(MAX(list_position([{_OUT}], outcome)) AS INTEGER))"
_RC = "translate(reverse({s}), 'ACGT', 'TGCA')"
_REF0, _REF1 = "ACGTACGTTTGACCATTGACAGGATTACA" * 3, "GATTACACCCGGTTTAAACCGGTACGT" * 4
_NEAR_REF = "ACGTACGTTTGACCATTGACAGGATTACACCGGT"
_MOLECULES = """mol AS (SELECT CAST(list_sum(list_transform(range(1, 4), lambda i: (strpos('ACGT', substr(seq, i, 1)) - 1) * CAST(pow(4, 3 - i) AS BIGINT))) AS BIGINT) AS fp,
  'chr' || CAST(o_custkey % 22 AS VARCHAR) AS chrom, o_custkey % 7 AS pos, COUNT(*) AS n FROM reads GROUP BY ALL),
per AS (SELECT chrom, COUNT(*) AS with_umi, CAST(SUM(n) AS BIGINT) AS without_umi FROM mol GROUP BY chrom)"""


def _windows(many: int) -> tuple[str, str]:
    """The first contaminants, and all their parts on both strands that two errors can turn into 32 bases."""
    refs = ", ".join(f"({k}, '{r}')" for k, r in enumerate(_CONTAMINANTS[:many]))
    return f"refs AS (SELECT * FROM (VALUES {refs}) AS v(ref, s))", """windows AS (SELECT DISTINCT ref, substr(t, CAST(i AS BIGINT), CAST(n AS BIGINT)) AS w
      FROM (SELECT ref, s AS t FROM refs UNION ALL SELECT ref, reverse(translate(s, 'ACGT', 'TGCA')) FROM refs), range(1, 85) AS a(i), range(30, 35) AS b(n) WHERE i + n <= length(t) + 1)"""


def _nearest_windows(rows: str) -> str:
    """The nearest contaminant of each distinct read, the first on ties, where no more than two errors lie between."""
    return f"near AS (SELECT seq, ref FROM (SELECT p.seq, w.ref, row_number() OVER (PARTITION BY p.seq ORDER BY levenshtein(p.seq, w.w), w.ref) AS k FROM (SELECT DISTINCT seq FROM {rows}) p JOIN windows w ON levenshtein(p.seq, w.w) <= 2) WHERE k = 1)"


_PIECES = "pieces AS (SELECT ord, seq, CAST(ord // 4 % 5 AS BIGINT) AS e, substr((SELECT list(s ORDER BY ref) FROM refs)[CAST(ord % 3 + 1 AS BIGINT)], CAST(ord % 23 + 1 AS BIGINT), 36) AS p FROM reads)"


def oracle_sql() -> dict[str, str]:
    dust = _DUST.format(s="seq")
    prefixes = " ".join(f"WHEN starts_with(seq, '{ADAPTER[len(ADAPTER) - k:]}') THEN {k}" for k in range(len(ADAPTER), 3, -1))
    suffixes = " ".join(f"WHEN ends_with(seq, '{ADAPTER[:k]}') THEN {k}" for k in range(len(ADAPTER), 3, -1))
    exact = " ".join(f"WHEN starts_with(seq, '{b}') THEN '{s}'" for s, b in SAMPLES)
    bg = dict(zip("ACGTN", BACKGROUND.background, strict=True))
    loglik = " + ".join(f"(length(seq) - length(replace(seq, '{b}', '')))::DOUBLE * ln({bg[b]}::DOUBLE)" for b in "ACGT")
    sizes = {b.lower(): f"SUM(length(seq) - length(replace(seq, '{b}', ''))) + 1" for b in "ACGT"}
    counts = ", ".join(f"CAST({e} AS BIGINT) AS n_{b}" for b, e in sizes.items())
    return {
        "flagship": _with(_NEAREST) + f"SELECT sample, barcode, COUNT(*) AS n, CAST(SUM(distance) AS BIGINT) AS differences FROM (SELECT *, {dust} AS d FROM nearest) WHERE d <= 100 GROUP BY sample, barcode",
        "revcomp": _with() + f"SELECT ord, {_RC.format(s='seq')} AS rc FROM reads",
        "clean_codes": _with() + "SELECT ord, substr(seq, 1, 4) || 'TNN.' AS cleaned, CAST(strpos('ACGT', substr(seq, 1, 1)) - 1 AS BIGINT) AS code FROM reads",
        "background": _with(f"c AS (SELECT {counts}, CAST(1 AS BIGINT) AS n_n, COUNT(*) AS reads, AVG(length(seq))::DOUBLE AS avg_len, CAST(MAX(length(seq)) AS BIGINT) AS max_len FROM reads)")
        + "SELECT *, " + ", ".join(f"round(n_{b}::DOUBLE / (n_a + n_c + n_g + n_t + n_n)::DOUBLE, 9) AS p_{b}" for b in "acgtn") + " FROM c",
        "umi_keys": _with() + "SELECT ord, CAST(list_sum(list_transform(range(1, 9), lambda i: (strpos('ACGT', substr(seq, i, 1)) - 1) * CAST(pow(4, 8 - i) AS BIGINT))) AS BIGINT) AS fp, substr(seq, 1, 8) AS bases FROM reads",
        "name_tags": _with() + "SELECT ord, CAST(o_custkey AS BIGINT) AS fp, substr(seq, 1, 6) AS bc, CAST(NULL AS VARCHAR) AS missing FROM reads",
        "counts_overlapping": _with() + "SELECT ord, CAST(len(list_filter(range(1, 32), lambda i: substr(seq, i, 2) = 'AA')) AS BIGINT) AS n, CAST(CASE WHEN strpos(seq, 'ACG') > 0 THEN strpos(seq, 'ACG') + 2 ELSE 0 END AS BIGINT) AS found_end FROM reads",
        "hamming": _with() + "SELECT ord, CAST(hamming(substr(seq, 1, 8), substr(seq, 9, 8)) AS BIGINT) AS distance FROM reads",
        "phred": _with() + "SELECT ord, round(1 - pow(10.0::DOUBLE, -(ord % 41)::DOUBLE / 10.0::DOUBLE), 9) AS right FROM reads",
        "dust": _with() + f"SELECT ord, round({dust}, 6) AS score FROM reads",
        "random_likelihood": _with() + f"SELECT ord, round({loglik} + length(seq) * ln(1 - 1 / 32.0::DOUBLE) + ln(1 / 32.0::DOUBLE), 5) AS log_random FROM reads",
        "read_model_likelihood": _with() + f"SELECT CAST(0 AS BIGINT) AS layout_id, round(SUM({loglik} + (length(seq) - 1) * ln(1 - 1 / 32.0::DOUBLE) + ln(1 / 32.0::DOUBLE)), 2) AS log_likelihood FROM reads",
        "partial_adapters": _with() + f"SELECT ord, CAST(CASE {prefixes} ELSE 0 END AS BIGINT) AS len_5, CAST(CASE {suffixes} ELSE 0 END AS BIGINT) AS len_3 FROM reads",
        "exact_demux": _with() + f"SELECT CASE {exact} END AS sample, COUNT(*) AS n FROM reads GROUP BY 1",
        "nearest_barcode": _with(_NEAREST) + "SELECT ord, sample, barcode, CAST(distance AS BIGINT) AS distance FROM nearest",
        "payload_filter": _with("p AS (SELECT ord, seq, strpos(substr(seq, 3), 'A') AS a FROM reads)") + "SELECT ord, substr(seq, a + 3) AS payload FROM p WHERE a > 0 AND length(substr(seq, a + 3)) >= 24",
        "flags": _with() + "SELECT CAST((ord % 2048) % 4 AS BIGINT) AS low, COUNT(*) AS n FROM reads WHERE ((ord % 2048) & 768) = 0 GROUP BY 1",
        "mate_outcomes": _with(_FILES) + f", c AS (SELECT ord, {_WORST} AS outcome, MAX(barcode) AS barcode FROM files GROUP BY ord) SELECT outcome, COUNT(*) AS n, COUNT(barcode) AS with_barcode FROM c GROUP BY outcome",
        "output_reads": _with(_FILES) + f", c AS (SELECT ord, {_WORST} AS outcome, MAX(barcode) AS barcode FROM files GROUP BY ord) SELECT f.ord, CAST(f.file_ix + 1 AS BIGINT) AS read_ix, c.barcode, f.seq FROM files f JOIN c ON f.ord = c.ord WHERE c.outcome = 'success'",
        "mate_counts": _with() + "SELECT CAST(0 AS BIGINT) AS file_ix, COUNT(*) AS n FROM reads UNION ALL SELECT 1, COUNT(*) FROM reads WHERE ord % 3 <> 0",
        "name_mismatch": _with("n AS (SELECT ord, 'NV042:17:KX3PLM:4:1208:' || ord || ':' || ord AS a, 'NV042:17:KX3PLM:4:1208:' || ord || ':' || (ord + 1) AS b FROM reads WHERE ord % 97 = 0)") + "SELECT ord, least(a, b) AS first, greatest(a, b) AS second FROM n",
        "rename": _with(_NEAREST) + "SELECT ord, sample, sample || '_' || row_number() OVER (PARTITION BY sample ORDER BY ord) || ' r_' || substr(seq, 1, 6) || ';x orig_bc=' || substr(seq, 1, 6) || ' new_bc=' || barcode || ' bc_diffs=' || CAST(CAST(distance AS BIGINT) AS VARCHAR) AS header, seq FROM nearest",
        "contaminants_exact": _with("p AS (SELECT ord, substr(seq, 1, 6) AS q FROM reads)")
        + f"SELECT ord, CAST(CASE WHEN strpos('{_REF0}', q) > 0 OR strpos({_RC.format(s=repr(_REF0))}, q) > 0 THEN 0 ELSE 1 END AS BIGINT) AS reference FROM p WHERE strpos('{_REF0}', q) > 0 OR strpos({_RC.format(s=repr(_REF0))}, q) > 0 OR strpos('{_REF1}', q) > 0 OR strpos({_RC.format(s=repr(_REF1))}, q) > 0",
        "edit_search": _with(
            f"t AS (SELECT '{_NEAR_REF}' AS s UNION ALL SELECT {_RC.format(s=repr(_NEAR_REF))})",
            "parts AS (SELECT DISTINCT substr(s, i, n) AS part FROM t, range(1, 35) AS a(i), range(7, 10) AS b(n))",
            "probe AS (SELECT DISTINCT substr(seq, 1, 8) AS q FROM reads)",
            "best AS (SELECT q, MIN(levenshtein(q, part)) AS errors FROM probe, parts GROUP BY q)",
        ) + "SELECT ord, CAST(errors AS BIGINT) AS errors FROM reads JOIN best ON q = substr(seq, 1, 8) WHERE errors <= 1",
        "umi_counts": _with(_MOLECULES) + "SELECT * FROM per",
        "zero_fill": _with("x AS (SELECT substr(seq, 2, 5) AS tag, COUNT(*) AS n FROM reads WHERE substr(seq, 1, 1) = 'A' GROUP BY 1)", "y AS (SELECT substr(seq, 2, 5) AS tag, COUNT(*) AS n FROM reads WHERE substr(seq, 9, 1) = 'A' GROUP BY 1)")
        + "SELECT COALESCE(x.tag, y.tag) AS tag, COALESCE(x.n, 0) AS a, COALESCE(y.n, 0) AS b FROM x FULL JOIN y ON x.tag = y.tag",
        "correlation": _with(_MOLECULES) + "SELECT round(corr(with_umi, without_umi), 9) AS r FROM per",
        "accuracy": _with(
            "g AS (SELECT ord % 5 AS k, CASE WHEN ord % 5 = 0 OR ord % 31 = 0 THEN 'un' WHEN ord % 53 = 0 THEN 'f2' ELSE 'f' || (ord % 5) END AS file, substr(seq, 7, 18) AS s, CASE WHEN ord % 5 > 0 THEN substr(seq, 7, 20) END AS truth FROM reads)",
            "home AS (SELECT k, arg_max(file, (n, -ascii(substr(file, 2, 1)))) AS home FROM (SELECT k, file, COUNT(*) AS n FROM g WHERE k > 0 AND file <> 'un' GROUP BY ALL) GROUP BY k)",
            "j AS (SELECT g.*, home, k > 0 AND file <> 'un' AND file = home AS hit FROM g LEFT JOIN home USING (k))",
            "c AS (SELECT COUNT(*) FILTER (hit) AS tp, COUNT(*) FILTER (file <> 'un' AND NOT COALESCE(hit, FALSE)) + COUNT(*) FILTER (k > 0 AND file = 'un') AS fp, CAST(0 AS BIGINT) AS fn, COUNT(*) FILTER (k = 0 AND file = 'un') AS tn, AVG(levenshtein(s, truth)::DOUBLE / greatest(length(s), length(truth))) FILTER (hit) AS e FROM j)",
            "d AS (SELECT *, (tp + fp + fn + tn)::DOUBLE AS t FROM c)",
        ) + """SELECT 'readloom' AS program, round(tp::DOUBLE / (tp + fn), 9) AS sensitivity, round(tn::DOUBLE / (tn + fp), 9) AS specificity, round(tp::DOUBLE / (tp + fp), 9) AS "precision",
  round(((tp + tn) / t - ((tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp)) / (t * t)) / (1 - ((tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp)) / (t * t)), 9) AS kappa, round(e, 9) AS avg_error, tp, fp, fn, tn FROM d""",
        "threshold_sweep": _with("s AS (SELECT (ord % 40)::DOUBLE AS q, COUNT(*) FILTER (o_custkey % 40 < ord % 40) AS a, COUNT(*) FILTER (NOT o_custkey % 40 < ord % 40) AS b FROM reads GROUP BY 1)")
        + "SELECT q, round((SUM(a) OVER w)::DOUBLE / (SUM(a) OVER ())::DOUBLE, 9) AS sensitivity, round(1 - (SUM(b) OVER w)::DOUBLE / (SUM(b) OVER ())::DOUBLE, 9) AS specificity FROM s WINDOW w AS (ORDER BY q DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        "layout_posterior": _with("s AS (SELECT CAST(ord % 4 AS BIGINT) AS candidate, SUM(length(seq) - length(replace(seq, 'A', '')))::DOUBLE / 1000.0::DOUBLE AS x FROM reads GROUP BY 1)") + "SELECT candidate, round(exp(x - MAX(x) OVER ()) / SUM(exp(x - (SELECT MAX(x) FROM s))) OVER (), 9) AS p FROM s",
        "merge_offsets": _with(
            "p AS (SELECT ord, seq, substr(seq, 1, 26) AS a, substr(seq, 7, 26) AS b FROM reads)",
            "o AS (SELECT ord, seq, a, b, d, 26 - abs(d) AS n, list_sum(list_transform(range(1, 27 - abs(d)), lambda i: CASE WHEN substr(a, greatest(d, 0) + i, 1) = substr(b, greatest(-d, 0) + i, 1) THEN 1 ELSE 0 END)) AS same FROM p, range(-9, 10) AS r(d))",
            "w AS (SELECT *, pow(10.0::DOUBLE, -4) AS e FROM o)",
            "k AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY round(same * ln((1 - e) * (1 - e) + e * e / 3) + (n - same) * ln(2 * e * (1 - e) / 3 + 2 * e * e / 9), 8) DESC, d) AS rank FROM w)",
        ) + "SELECT ord, seq, CAST(32 AS BIGINT) AS n_qual, round(same::DOUBLE / n, 6) AS identity, CAST(d AS BIGINT) AS shift FROM k WHERE rank = 1",
        "join_pairs": _with(f"mates AS ({MATES})") + "SELECT reads.ord, reads.seq || 'NNN' || mates.seq AS seq, repeat('I', 32) || '!!!' || repeat('I', 32) AS qual FROM reads JOIN mates ON reads.ord = mates.ord",
        "trim_exact": _with("m AS (SELECT ord, seq, list_min(list_filter(range(1, 30), lambda i: regexp_matches(substr(seq, i, 4), '^AC[ACGTN]T$'))) AS i FROM reads)") + "SELECT ord, substr(seq, i + 4) AS seq, repeat('I', CAST(29 - i AS INTEGER)) AS qual FROM m WHERE i IS NOT NULL AND 29 - i >= 16",
        "split_by_tag": _with() + "SELECT substr(seq, 1, 6) AS part, COUNT(*) AS n FROM reads GROUP BY 1",
        "label_segments": _with(_COMPOSED) + "SELECT ord, 'success' AS outcome, barcode, CAST(list_sum(list_transform(range(1, 5), lambda i: (strpos('ACGT', substr(umi, i, 1)) - 1) * CAST(pow(4, 4 - i) AS BIGINT))) AS BIGINT) AS fp, umi AS fp_seq, seq AS payload, CAST(32 AS BIGINT) AS n_qual FROM composed",
        "label_plate": _with() + "SELECT ord, 'success' AS outcome, list_extract([" + ", ".join(f"'{b}'" for b in PLATE) + "], CAST(ord % 96 + 1 AS INTEGER)) AS barcode, seq AS payload FROM reads",
        "label_evaluate": _with() + "SELECT 'readloom' AS program, 1.0::DOUBLE AS sensitivity, 1.0::DOUBLE AS specificity, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS kappa, 0.0::DOUBLE AS avg_error, SUM(CASE WHEN ord % 10 <> 9 THEN 1 ELSE 0 END)::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, SUM(CASE WHEN ord % 10 = 9 THEN 1 ELSE 0 END)::BIGINT AS tn, 0::BIGINT AS missed, 1.0::DOUBLE AS sensitivity_all FROM reads",
        "label_types": _with() + f"SELECT ord, 'success' AS outcome, CASE WHEN ord % 2 = 0 THEN '{BARCODES[0][1]}' ELSE '{BARCODES[1][1]}' END AS barcode, substr(seq, 29, 4) AS fp_seq, 'ACACACACACACACACACACAC' AS payload FROM reads",
        "label_outcomes": _with(_COMPOSED) + "SELECT CASE WHEN 8 + ord % 24 < 16 THEN 'too_short' ELSE 'success' END AS outcome, barcode, COUNT(*) AS n FROM composed GROUP BY ALL",
        "threshold": _with("s AS (SELECT (ord % 389)::DOUBLE / 10 AS q, COUNT(*) FILTER ((o_custkey * 7) % 389 < ord % 389) AS a, COUNT(*) FILTER (NOT (o_custkey * 7) % 389 < ord % 389) AS b FROM reads GROUP BY 1)",
            "t AS (SELECT q, (SUM(a) OVER w)::DOUBLE / (SUM(a) OVER ())::DOUBLE AS x, 1 - (SUM(b) OVER w)::DOUBLE / (SUM(b) OVER ())::DOUBLE AS y FROM s WINDOW w AS (ORDER BY q DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")
        + "SELECT least(round(q, 2), 20.0::DOUBLE) AS q, round(x, 9) AS sensitivity, round(y, 9) AS specificity FROM t ORDER BY round(x + y, 12) DESC, t.q DESC LIMIT 1",
        "fastq_files": _with() + "SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, 'r;' || ord AS name, seq, CAST(32 AS BIGINT) AS n_qual FROM reads",
        "fasta_files": _with() + "SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, 'r' || ord AS name, seq, CAST(NULL AS VARCHAR) AS qual FROM reads",
        "sam_files": _with() + "SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, 'r' || ord AS name, seq, CAST(16 AS BIGINT) AS flag, CAST(ord % 61 AS BIGINT) AS mapq, CAST(ord % 4 AS BIGINT) AS nm FROM reads WHERE ord % 3 <> 0 AND ord % 5 <> 0",
        "barcode_distance": _with("r AS (SELECT o_custkey, ord, substr(seq, 1, 6) AS b FROM reads)") + "SELECT x.o_custkey, CAST(MIN(levenshtein(x.b, y.b)) AS BIGINT) AS least FROM r x JOIN r y ON x.o_custkey = y.o_custkey AND x.ord < y.ord GROUP BY 1",
        "information": _with("b AS (SELECT i AS place, substr(seq, CAST(i + 1 AS BIGINT), 1) AS base, COUNT(*) AS n FROM reads, range(0, 8) AS r(i) GROUP BY ALL)", "p AS (SELECT place, n::DOUBLE / SUM(n) OVER (PARTITION BY place) AS p FROM b)") + "SELECT CAST(place AS BIGINT) AS place, round(SUM(p * log2(p / 0.25::DOUBLE)), 9) AS bits FROM p GROUP BY place",
        "numbered": _with() + "SELECT ord, substr(seq, 1, 1) AS sample, row_number() OVER (PARTITION BY substr(seq, 1, 1) ORDER BY ord) AS number FROM reads",
        "summary": _with(_FILES) + ", n AS (SELECT outcome, COUNT(*) AS n FROM files GROUP BY outcome) SELECT outcome, n, round(100.0::DOUBLE * n / (SELECT COUNT(*) FROM files), 4) AS percent FROM n",
        "low_complexity": _with(_FILES) + f", d AS (SELECT CASE WHEN {dust} > 8 THEN 'low_complexity' ELSE outcome END AS outcome FROM files) SELECT outcome, COUNT(*) AS n FROM d GROUP BY outcome",
        "contaminants_errors": _with(*_windows(2), _nearest_windows("reads")) + "SELECT CASE WHEN n.ref IS NULL THEN 'success' ELSE 'artifact' END AS outcome, CAST(n.ref AS INTEGER) AS contaminant_ix, COUNT(*) AS n FROM reads r LEFT JOIN near n ON n.seq = r.seq GROUP BY 1, 2",
        "contaminants_near": _with(*_windows(3), _PIECES, "made AS (SELECT ord, CASE WHEN ord % 2 = 0 THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END AS seq FROM (SELECT ord, substr(substr(p, 1, 4) || CASE WHEN e >= 1 THEN substr(seq, 1, 1) ELSE substr(p, 5, 1) END || substr(p, 6, 4) || CASE WHEN e >= 2 THEN substr(p, 11, 4) ELSE substr(p, 10, 5) END || substr(p, 15, 6) || CASE WHEN e >= 3 THEN substr(seq, 2, 2) ELSE '' END || substr(p, 21, 4) || CASE WHEN e >= 4 THEN substr(seq, 4, 1) ELSE substr(p, 25, 1) END || substr(p, 26, 11), 1, 32) AS seq FROM pieces))", _nearest_windows("made"))
        + "SELECT r.ord, CASE WHEN n.ref IS NULL THEN 'success' ELSE 'artifact' END AS outcome, CAST(n.ref AS BIGINT) AS contaminant_ix FROM made r LEFT JOIN near n ON n.seq = r.seq",
        "distinct_layouts": _with() + "SELECT 'B:' || substr(seq, 1, 3) || ' R:N' AS layout FROM reads UNION SELECT 'B:' || substr(seq, 4, 3) || ' R:N' FROM reads",
    }
