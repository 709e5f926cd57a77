"""Fill-in-middle against lists of units, its SQL, and on odd rows."""

from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings, strategies as st

from compare import same
from readloom.llm import fim
from readloom.llm.registry import op11_fim


def brute(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**12), st.text("abPSM<>. é\n\x00日\U0001f600", max_size=40), st.sampled_from([1, 2, 3, 7, 1 << 20]))
def test_units_and_cuts_equal_lists_of_units(doc_id, text, piece):
    was = fim._SLICE
    try:
        fim._SLICE = piece
        assert fim.transform(doc_id, text) == brute(doc_id, text)
    finally:
        fim._SLICE = was


def test_every_unit_end_is_found():
    text = "Ab c, déf <P\n\n日本 x"
    ranks, units = fim.Ranks(text), re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert ranks.n == len(units) and not ranks.marked
    assert [ranks.place(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_query_equals_its_sql_and_restores_every_text(spark, data):
    same(op11_fim(spark, data), fim.SQL, data)
    texts = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id", "sha2(cast(coalesce(text, '') as binary), 256) AS restored_sha256")
    assert op11_fim(spark, data).select("doc_id", "restored_sha256").exceptAll(texts).count() == 0
    assert {r["form"] for r in op11_fim(spark, data).select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_odd_rows_and_clashing_columns(spark):
    long = "naïve <word> " * 200_000
    rows = [(1, None, 7, "x"), (2, "", 7, None), (None, "some words here", 7, "x"), (None, "some words here", 7, "x"), (4, long, 7, "x"), (4, long, 7, "x"), (5, "has <M> in it", 7, "x"), (6, "  ", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, output string")
    out = fim.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(((r["doc_id"], r["text"], tuple(r)[2:]) for r in out.collect()), key=repr)
    assert got == sorted(((i, t, brute(i, t)) for i, t, _, _ in rows), key=repr)
    back = out.select(fim.restored(out["output"], out["form"]).alias("t"), "text").where("t <> coalesce(text, '')")
    assert back.count() == 0
    assert fim.digests(fim.fill_in_middle(docs.limit(0))).collect() == []


def test_parameters(spark):
    docs = spark.range(200).selectExpr("id AS key", "concat('text ', id, ' of some words') AS body")
    forms = lambda **k: {r["form"]: r["count"] for r in fim.fill_in_middle(docs, "body", "key", **k).groupBy("form").count().collect()}
    assert forms(plain=0, spm=100) == {"spm": 200} and forms(plain=0, spm=0) == {"psm": 200} and forms(plain=100) == {"plain": 200}
    assert forms(seed=2) != forms() or forms(seed=3) != forms()
