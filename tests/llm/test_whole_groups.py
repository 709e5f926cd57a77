"""Near-duplicate groups of rows without ids, and of rows that share one."""

from __future__ import annotations

from readloom.llm import simhash as S

DOCS = "doc_id long, text string, source string"


def test_rows_without_ids_are_grouped_and_kept(spark):
    long = " ".join(f"w{i}" for i in range(400))
    near = long + " more"
    assert 0 < (S.fingerprint(long) ^ S.fingerprint(near)).bit_count() <= S.DISTANCE
    rows = [
        (None, "alone and clean one", "a"),
        (None, "twice the very same", "b"), (None, "twice the very same", "a"), (None, "Twice  the very same", "c"),
        (None, long, "a"), (8, near, "a"), (None, near, "a"),
        (9, "one text of nine", "a"), (9, "quite another of nine here", "a"), (3, "one text of nine", "a"),
    ]
    d = spark.createDataFrame(rows, DOCS)
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.groups(d).collect()), key=repr)
    assert got == sorted([(None, None)] * 4 + [(None, 8), (8, 8), (None, 8), (9, 3), (9, 9), (3, 3)], key=repr)
    kept = S.dedup(d)
    assert kept.columns == d.columns and kept.schema["source"].dataType == d.schema["source"].dataType
    kept = [tuple(r) for r in kept.collect()]
    assert (None, "alone and clean one", "a") in kept and sum(t.lower().split() == "twice the very same".split() for _, t, _ in kept) == 1
    assert sorted((r[:2] for r in kept if r[0]), key=repr) == [(3, "one text of nine"), (8, near), (9, "quite another of nine here")]
    assert len(kept) == 5
    assert [tuple(r) for r in S.dedup(d.repartition(3)).where("doc_id is null").orderBy("text").collect()] == sorted(r for r in kept if r[0] is None)


def test_a_chain_through_a_row_without_an_id(spark):
    far = lambda a, b: (S.fingerprint(a) ^ S.fingerprint(b)).bit_count()
    words = [f"v{i}" for i in range(300)]
    texts = [" ".join(words + [f"x{k}" for k in range(n)]) for n in range(0, 60)]
    a, b, c = next((x, y, z) for x in texts for y in texts for z in texts if far(x, y) <= 4 and far(y, z) <= 4 and far(x, z) > 4)
    d = spark.createDataFrame([(1, a, "s"), (None, b, "s"), (2, c, "s")], DOCS)
    assert {r["component_id"] for r in S.groups(d).collect()} == {1}
    assert [r["doc_id"] for r in S.dedup(d).collect()] == [1]
