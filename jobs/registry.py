"""The jobs as queries over the given tables, and their results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.queries import _DUST
from readloom.sources.scratch import scratch

from . import demultiplex, molecules
from .common import default_config

Query = Callable[[SparkSession, str], DataFrame]


def job1_demultiplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a read, taken in by two runs with one checkpoint."""
    conf, out = default_config(demultiplex.NAME), scratch(spark)
    for _ in range(2):
        demultiplex.run(spark, f"{sf_dir}/documents.parquet", f"{out}/out", f"{out}/checkpoint", conf)
    return demultiplex.reads_of(spark, f"{out}/out")


def job2_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules of every line item, taken in by two runs."""
    conf, out = default_config(molecules.NAME), scratch(spark)
    for _ in range(2):
        molecules.run(spark, f"{sf_dir}/lineitem.parquet", out, conf)
    return molecules.counts_of(spark, out)


def queries() -> dict[str, Query]:
    return {"job1_demultiplex": job1_demultiplex, "job2_molecules": job2_molecules}


_CODES = ", ".join(f"('{s}', '{b}')" for s, b in default_config(demultiplex.NAME)["barcodes"].items())
_DIFFER = "list_sum(list_transform(range(1, 5), lambda i: CASE WHEN substr(p.tag, i, 1) <> substr(c.barcode, i, 1) THEN 1 ELSE 0 END))"

DEMULTIPLEX = f"""
WITH lines AS (SELECT doc_id AS id, coalesce(nullif(source, ''), 'none') AS lane, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS record, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
reads AS (SELECT id, lane, record, left(translate(md5(line), '0123456789abcdef', 'ACGTACGTACGTACGT'), length(line)) AS seq FROM lines WHERE trim(line) <> ''),
tags AS (
    SELECT p.tag, c.sample, row_number() OVER (PARTITION BY p.tag ORDER BY {_DIFFER}, c.barcode) AS k, {_DIFFER} AS distance
    FROM (SELECT DISTINCT substr(seq, 1, 4) AS tag FROM reads WHERE length(seq) >= 4) p, (VALUES {_CODES}) AS c(sample, barcode)
), dealt AS (
    SELECT r.id, r.record, r.lane, CASE WHEN t.distance <= 1 THEN t.sample ELSE 'undetermined' END AS sample, CASE WHEN t.distance <= 1 THEN substr(r.seq, 5) ELSE r.seq END AS payload
    FROM reads r LEFT JOIN tags t ON t.tag = substr(r.seq, 1, 4) AND t.k = 1
), scored AS (SELECT payload, {_DUST.format(s="payload")} AS d FROM (SELECT DISTINCT payload FROM dealt WHERE sample <> 'undetermined'))
SELECT id, record, lane, d.sample, CASE WHEN d.sample = 'undetermined' THEN 'barcode_missing' WHEN length(payload) < 16 THEN 'too_short' WHEN s.d > 2.5 THEN 'low_complexity' ELSE 'success' END AS outcome, payload
FROM dealt d LEFT JOIN scored s USING (payload)
"""

MOLECULES = """
WITH reads AS (
    SELECT coalesce(nullif(l_returnflag, ''), 'none') AS sample, 'chr' || (l_suppkey % 24) AS chrom, l_partkey AS pos,
        substr(translate(md5(l_orderkey || '-' || l_linenumber), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 4) AS umi
    FROM lineitem WHERE l_shipdate IS NOT NULL
), molecules AS (SELECT sample, chrom, pos, umi, COUNT(*) AS n FROM reads GROUP BY ALL)
SELECT sample, chrom, COUNT(*) AS with_umi, CAST(SUM(n) AS BIGINT) AS without_umi, round(1 - COUNT(*) / CAST(SUM(n) AS DOUBLE), 9) AS duplication FROM molecules GROUP BY sample, chrom
"""


def oracle_sql() -> dict[str, str]:
    return {"job1_demultiplex": DEMULTIPLEX, "job2_molecules": MOLECULES}
