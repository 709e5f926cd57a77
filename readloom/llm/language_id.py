"""Language identification by fusing evidence.

The posterior of a language is the product of the likelihood of the text (character trigrams, hashed, with
a naive Bayes model), of the language that the markup declares, of the address's suffix, and of a prior
for the host.  Declarations, suffixes and hosts are counted over the whole table, by the language that the
text alone suggests: how a declaration or suffix goes with languages comes from one grouped aggregation
each, and the host's prior is smoothed towards its domain's, which is smoothed towards the table's.
Long texts would drown all else, since their characters are not independent; the text's log-likelihood
per trigram therefore counts for at most ``MOST`` trigrams.

The text model is trained on at most ``max_docs`` documents of each labelled language (those of the smallest id
hashes), of at most ``max_languages`` languages (those with the most rows).

Defined results: a null text or page has no text evidence; a missing declaration, suffix or host counts for
nothing; with no evidence at all the language with the greatest prior wins, ties go to the first by
code; an empty training table gives null languages; repeated rows get one result each; columns that are not
named here are ignored; an empty table gives an empty result.  The time is linear in the length of a page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, give_back, sample_each, to_python
from .html_extract import Page, attributes, shown

BITS = 14
MOST = 60
MAX_DOCS = 150
KAPPA = 8.0  # how many pages a prior is worth
ALPHA = 0.5  # added to each count of a declaration or suffix
#: Languages of which there are more than so many have their most frequent ones modelled.
MAX_LANGUAGES = 200
_CODE = re.compile(r"\s*([A-Za-z]{2,8})")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # 2**BITS, languages: log-likelihoods

    def score(self, text: str) -> np.ndarray:
        """The text's log-likelihood in each language, for at most MOST trigrams' worth."""
        h = trigrams(text)
        if not len(h):
            return np.zeros(len(self.languages))
        counts = np.bincount(h, minlength=1 << BITS)
        return (counts @ self.table) * (min(len(h), MOST) / len(h))


def trigrams(text: str) -> np.ndarray:
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) < 3:
        return np.array([], np.int64)
    x = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    return (x >> np.uint32(32 - BITS)).astype(np.int64)


def fit(texts: list[tuple[str, str]]) -> Model:
    """From (language, text) rows."""
    languages = sorted({a for a, _ in texts})
    counts = np.full((1 << BITS, len(languages)), 0.1)
    for lang, text in texts:
        counts[:, languages.index(lang)] += np.bincount(trigrams(text), minlength=1 << BITS)
    return Model(languages, np.log(counts / counts.sum(0)))


def train(docs: DataFrame, max_docs: int = MAX_DOCS, max_languages: int = MAX_LANGUAGES) -> Model:
    """From rows (doc_id, lang, text): at most ``max_docs`` of each language, of the ``max_languages`` with the most rows."""
    labelled = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null")
    known = [r[0] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()]
    return fit([(lang, text) for lang, _, text in sample_each(labelled.where(F.col("lang").isin(known)), "lang", max_docs, "text")])


def declared(page: Page) -> str | None:
    """The language that a page's html element names, else its content-language, in lower case."""
    for wanted in ("html", "meta"):
        for name, raw, _, _ in page.elements:
            if name != wanted or "=" not in raw:
                continue
            attrs = attributes(raw)
            said = (attrs.get("lang") or attrs.get("xml:lang")) if name == "html" else attrs.get("content") if attrs.get("http-equiv", "").lower() == "content-language" else None
            if said and (m := _CODE.match(said)):
                return m[1].lower()
    return None


def _scores(rows: DataFrame, model: Model, markup: bool) -> DataFrame:
    """(id columns, host, declared, loglik) from (ids, host, text): the text is HTML with ``markup``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in rows.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 500):
                part = batch.slice(at, 500)
                said, score = [], []
                for raw in part.column(len(keep)).to_pylist():
                    page = Page(raw) if markup and raw else None
                    said.append(declared(page) if page else None)
                    score.append(shared.value.score(" ".join(x for name, x in shown(page) if not name) if page else raw or ""))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(said, pa.string()), pa.array([s.tolist() for s in score], pa.list_(pa.float64()))], [*keep, "declared", "loglik"])
        give_back()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "content")
    return to_python(rows).select(*keep, "content").mapInArrow(run, f"{schema}, declared string, loglik array<double>")


def _counts(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, counts per language) by the text's own best language."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[F.count(F.when(F.col("best") == k, 1)) for k in range(n)]).alias(f"{key}_n"))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x).cast("double")


def fuse(scored: DataFrame, languages: list[str]) -> DataFrame:
    """Add lang, probability and text_lang to scored rows (host, declared, loglik)."""
    n = len(languages)
    if not n:
        return scored.drop("loglik").withColumns({"lang": F.lit(None).cast("string"), "probability": F.lit(None).cast("double"), "text_lang": F.lit(None).cast("string")})
    label = F.split("host", "\\.")
    dotted = F.col("host").contains(".")
    rows = scored.withColumns({
        "best": (F.array_position("loglik", F.array_max("loglik")) - 1).cast("int"),
        "suffix": F.when(dotted, F.element_at(label, -1)),
        "domain": F.when(dotted, F.array_join(F.slice(label, F.greatest(F.size(label) - 1, F.lit(1)), F.lit(2)), ".")).otherwise(F.col("host")),
    })
    # a text that favours no language says nothing
    rows = cut(rows.withColumn("best", F.when(F.array_max("loglik") > F.array_min("loglik"), F.col("best")) if n > 1 else F.col("best")))
    whole = rows.agg(*[F.count(F.when(F.col("best") == k, 1)) for k in range(n)]).first()
    total = sum(whole)
    base = F.array(*[F.lit((c + 1) / (total + n)) for c in whole])

    for key in ("declared", "suffix", "domain", "host"):
        # rows without the key match nothing; they are spread, or they would all meet in one task
        spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(scored.columns[0]), F.lit(4096)).cast("string"))
        rows = rows.withColumn("_key", F.coalesce(F.col(key), spread)).join(_counts(rows, key, n).withColumnRenamed(key, "_key"), "_key", "left").drop("_key")

    def smoothed(counts: Column, prior: Column) -> Column:
        return F.when(counts.isNull(), prior).otherwise(F.zip_with(counts, prior, lambda c, p: (c.cast("double") + F.lit(KAPPA) * p) / (_total(counts) + F.lit(KAPPA))))

    def given(counts: Column) -> Column:
        """Of each language's pages, the share with this declaration or suffix."""
        share = F.zip_with(counts, F.array(*[F.lit(float(c)) for c in whole]), lambda c, t: (c.cast("double") + ALPHA) / (t + 2 * ALPHA))
        return F.when(counts.isNull(), F.array(*[F.lit(1.0)] * n)).otherwise(share)

    rows = rows.withColumn("domain_p", smoothed(F.col("domain_n"), base))
    rows = rows.withColumn("prior", smoothed(F.col("host_n"), F.col("domain_p")))
    rows = rows.withColumns({"said_p": given(F.col("declared_n")), "suffix_p": given(F.col("suffix_n"))})
    logs = F.array(*[F.col("loglik")[k] + F.log(F.col("prior")[k]) + F.log(F.col("said_p")[k]) + F.log(F.col("suffix_p")[k]) for k in range(n)])
    rows = rows.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    names = F.array(*map(F.lit, languages))
    evidence = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return rows.select(
        *[c for c in scored.columns if c not in ("loglik",)],
        F.element_at(names, F.array_position("logs", F.col("top")).cast("int")).alias("lang"),
        F.round(1 / evidence, 6).alias("probability"),
        F.get(names, F.col("best")).alias("text_lang"),
    )


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, _HOST, 1), F.lit("")))


def identify_pages(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, host, declared, lang, probability, text_lang) for every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("content"))
    return fuse(_scores(rows, model, markup=True), model.languages)


def identify_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, host, declared, lang, probability, text_lang) for every document; its source takes the place of the host."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("content"))
    return fuse(_scores(rows, model, markup=False), model.languages)
