"""Every stage of the pipeline on odd rows, and on none."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, copies int, line int, row string, component_id string, fp string, ids string"
GOOD = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(70))
LONG = " ".join(f"x{i % 5000}y{i // 5000}" for i in range(20_000))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (2, "  \n"), (3, GOOD), (3, GOOD), (3, OTHER), (None, OTHER + " z"), (None, OTHER + " z"), (None, None), (5, LONG), (6, "a b c\na b c"), (7, GOOD + " more")]
    return spark.createDataFrame([(i, t, None if k % 2 else "en", (None, "s", "t")[k % 3], None, "k", "z", 1, 2, "r", "c", "f", "i") for k, (i, t) in enumerate(rows)], SCHEMA)


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def want(*rows):
    return sorted(rows, key=repr)


def test_stages_on_odd_rows(spark, odd, data):
    import corpus_pipeline as P

    stage = {name: lambda docs, f=f: f(spark, docs, data) for name, f in P.STAGES}
    out = {name: f(odd) for name, f in stage.items()}
    for name, df in out.items():
        assert df.columns == odd.columns + ["decoded"] * (name == "encoding") if name != "encoding" else set(df.columns) == {*odd.columns, "decoded"}
        assert {r["kept"] for r in df.collect()} <= {"k"}
    assert texts(out["quality rules"]) == want((3, GOOD), (3, GOOD), (3, OTHER), (None, OTHER + " z"), (None, OTHER + " z"), (5, LONG), (7, GOOD + " more"))
    lines = texts(out["line dedup"])
    assert len(lines) == odd.count() and lines.count((None, OTHER + " z")) == 2 and (None, None) in lines and (2, "  \n") in lines
    assert (3, "") in lines and (6, "a b c") in lines and (7, "") in lines and lines.count((3, GOOD)) == 2 and (5, LONG) in lines
    near = texts(out["near dedup"])
    assert near.count((3, GOOD)) == 2 and [x for x in near if x[1] in (None, "", "  \n")] == [(1, None)] and (5, LONG) in near
    mixed = texts(out["mixing"])
    assert all((t or "").strip() for _, t in mixed) and len(mixed) > 0
    ids = {r["text"]: r["ids"] for r in out["encoding"].collect()}
    assert ids[None] == ids[""] == [] and len(ids[LONG]) >= 20_000 and out["encoding"].count() == odd.count()


def test_stages_on_no_rows(spark, odd, data):
    import corpus_pipeline as P

    for name, f in P.STAGES:
        assert f(spark, odd.limit(0), data).count() == 0, name
