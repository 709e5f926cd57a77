"""The operators over whole corpora: against brute force and SQL."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from compare import same

from readloom.llm import graph, line_dedup as L, mixing, registry, simhash as S
from readloom.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """From (doc_id, text[, source])."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows], DOCS)


def union_find(n, edges):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


# -- graph ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    n = 120
    edges = [(r.randrange(n), r.randrange(n)) for _ in range((40, 90, 150)[seed])] + [(i, i + 1) for i in range(0, 40)]
    want = union_find(n, edges)
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: want[i] for i in {x for e in edges for x in e if e[0] != e[1]}}


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


# -- SimHash ----------------------------------------------------------------------------------------


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark, data):
    texts = [None, "", " \n", "One", "one  two\tthree", "É ONE TWO three four", "a b c d e f"] + [r["text"] for r in table(spark, data, "documents").limit(60).collect()]
    for t in texts:
        assert S.fingerprint(t) == slow_fingerprint(t)


def brute_groups(rows, distance=S.DISTANCE):
    ids = np.array([i for i, _ in rows])
    fp = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
    label = union_find(len(ids), zip(*np.nonzero(near), strict=True))
    least = {}
    for i, k in zip(ids.tolist(), label, strict=True):
        least[k] = min(i, least.get(k, i))
    return {(i, f"{f:016x}", least[k]) for i, f, k in zip(ids.tolist(), fp.tolist(), label, strict=True)}


def test_groups_query(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()]
    assert {tuple(r) for r in registry.op7_simhash(spark, data).collect()} == brute_groups(rows)


@pytest.mark.parametrize("limit,blocks", [(S.BUCKET_LIMIT, None), (3, 5), (1, 7), (S.BUCKET_LIMIT, 8), (20, 5)])
def test_links_in_dense_clouds(spark, limit, blocks):
    """Fingerprints around a few centres: many share keys, and some groups hang on chains only."""
    r = random.Random(8)
    fps = set()
    for _ in range(4):
        c = r.getrandbits(64)
        for _ in range(60):
            fps.add(c ^ sum(1 << b for b in {r.randrange(64) for _ in range(r.randint(0, 5))}))
    fps = sorted(fps | {r.getrandbits(64) for _ in range(60)})
    nodes = spark.createDataFrame([(i, S._signed(f)) for i, f in enumerate(fps)], "node long, fp long")
    found = {x["node"]: x["component"] for x in graph.components(S.links(nodes, 4, limit, blocks)).collect()}
    x = np.array(fps, np.uint64)
    want = union_find(len(fps), zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4), strict=True))
    assert [found.get(i, i) for i in range(len(fps))] == want


def test_masks_cover_every_pair():
    for b in range(5, 10):
        r = random.Random(b)
        masks = [m & (1 << 64) - 1 for m in S.block_masks(b)]
        for _ in range(200):
            d = sum(1 << i for i in r.sample(range(64), 4))
            assert any(not d & m for m in masks)
    assert S.block_count(10) == 5 and S.block_count(1 << 20) == 6 and S.block_count(1 << 27) == 7


def test_simhash_edges(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "a b c d e"), (4, "a b c d e"), (5, "A  B\tC D E"), (None, "a b c d e"), (6, "word " * 30_000)]
    got = S.groups(docs(spark, rows))
    assert got.count() == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4), (6, 6)}
    kept = S.dedup(docs(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 4, 6] and kept.columns == docs(spark, rows).columns
    assert S.groups(docs(spark, rows).limit(0)).count() == 0 and S.dedup(docs(spark, rows).limit(0)).count() == 0


# -- lines ------------------------------------------------------------------------------------------


def brute_removed(rows, threshold=0.8):
    """Per document: the numbers of lines that match any earlier line."""
    lines = sorted((i, k, frozenset(re.findall(r"[^\x20\x09-\x0D]+", s))) for i, t in rows if t is not None for k, s in enumerate(t.split("\n")))
    lines = [x for x in lines if x[2]]
    out = {}
    for n, (i, k, w) in enumerate(lines):
        if any(len(w & v) >= threshold * len(w | v) - 1e-9 for _, _, v in lines[:n]):
            out.setdefault(i, []).append(k)
    return out


def cloud(seed, n=60):
    """Documents of copied and changed lines, of few words and of many."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["the", "of"] * 20
    bases = [[r.choice(words) for _ in range(r.choice((1, 2, 4, 5, 9, 20, 60, 130)))] for _ in range(12)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(r.randint(0, 5)):
            line = list(r.choice(bases))
            for _ in range(r.randint(0, 1 + len(line) // 8)):
                line[r.randrange(len(line))] = r.choice(words) if r.random() < 0.5 else f"x{r.randrange(10_000)}"
            lines.append(r.choice((" ", "  ", "\t")).join(line))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_lines_equal_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # every group is a crowd
        monkeypatch.setattr(L, "CROWD", 1)
        monkeypatch.setattr(L, "SLICES", 2)
    rows = cloud(seed)
    want = brute_removed(rows)
    got = L.dedup(docs(spark, rows), removed_col="gone").collect()
    assert {r["doc_id"]: r["gone"] for r in got if r["gone"]} == want
    for r in got:
        lines = dict(rows)[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(s for k, s in enumerate(lines) if k not in want.get(r["doc_id"], []))


def test_lines_query(spark, data):
    same(registry.op9_line_dedup(spark, data), L.SQL, data)


def test_line_edges(spark):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, "\n \n"), (4, "a b c\nx\na b c"), (None, "x"), (5, "c b  a"), (6, "only one"), (6, "only one"), (7, "long " + "w " * 5000 + "\nend")]
    d = docs(spark, rows).withColumn("line", F.lit(1)).withColumn("n", F.lit("clash"))
    got = {(r["doc_id"], r["text"]) for r in L.dedup(d).collect()}
    assert got == {(1, None), (2, ""), (3, "\n \n"), (4, "a b c"), (None, "x"), (5, ""), (6, "only one"), (7, rows[-1][1])}
    assert L.dedup(d).columns == d.columns and L.dedup(d).count() == len(rows)
    assert L.dedup(d.limit(0)).count() == 0


# -- mixing -----------------------------------------------------------------------------------------


def test_mix_query(spark, data):
    same(registry.op4_mixing(spark, data), mixing.SQL, data)


def slow_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, held = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in held]
        level = (total - sum(cap * sizes[s] for s in held)) / sum(w[s] for s in free) if free else 0
        over = {s for s in free if cap * sizes[s] <= w[s] * level}
        if not over:
            return {s: cap * sizes[s] if s in held else w[s] * level for s in order}
        held |= over


def test_targets(spark):
    r = random.Random(9)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i}é" if i % 2 else f"S{i}": r.choice((0, 1, 10, 1000, 10**6)) for i in range(n)} | ({None: 50} if n > 2 else {})
        got = {x["source"]: x["target"] for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = slow_targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
        assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_taken_comes_near_the_target_and_reruns_agree(spark, data):
    d = table(spark, data.replace("sf0.001", "sf0.1"), "documents")
    rows = mixing.taken(d).collect()
    by = {}
    src = {r["doc_id"]: r["source"] for r in d.select("doc_id", "source").collect()}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        t = by.setdefault(src[r["doc_id"]], [0, r["target"]])
        t[0] += r["taken"]
    assert all(abs(a - t) < 0.15 * t for a, t in by.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.taken(d.repartition(7)).collect()))
    n = sum(r["copies"] for r in rows)
    assert mixing.mix(d).count() == n


def test_mix_edges(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, "a"), (2, "", None), (3, "one two", None), (3, "one two", None), (4, "  x\x0by", "b"), (None, "w " * 40, "b")]
    d = docs(spark, rows).withColumn("size", F.lit("clash")).withColumn("copies", F.lit(1))
    got = mixing.taken(d).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 3, 40] and all(r["taken"] <= 2 * r["size"] for r in got)
    out = mixing.mix(d)
    assert out.columns == d.columns and out.where("text is null or text = ''").count() == 0
    assert mixing.taken(d.limit(0)).count() == 0 and mixing.mix(d.limit(0)).count() == 0


# -- pipeline ---------------------------------------------------------------------------------------


def test_pipeline(spark, data, tmp_path):
    import corpus_pipeline as P

    from readloom.llm import bpe, quality

    read = table(spark, data, "documents")
    columns, steps = read.columns, [read]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, steps[-1], data).write.parquet(str(tmp_path / str(k)))
        steps.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < len(P.STAGES) - 1:
            assert steps[-1].columns == columns
    rows = [sorted(((r["doc_id"], r["text"]) for r in s.collect()), key=repr) for s in steps]
    judged = {r["doc_id"] for r in quality.judge(read, quality.fit(read, table(spark, data, "labels"))).where("kept").collect()}
    assert {i for i, _ in rows[1]} == judged
    gone = brute_removed(rows[1])
    assert rows[2] == sorted(((i, "\n".join(s for k, s in enumerate(t.split("\n")) if k not in gone.get(i, []))) for i, t in rows[1]), key=repr)
    assert {i for i, _ in rows[3]} == {c for _, _, c in brute_groups(rows[2])}
    copies = {r["doc_id"]: r["copies"] for r in mixing.taken(steps[3]).collect()}
    assert rows[4] == sorted((x for x in rows[3] for _ in range(copies[x[0]])), key=repr)
    c = bpe.codec()
    assert [c.encode(t) for _, t in rows[4]] == [r["ids"] for r in sorted(steps[5].collect(), key=lambda r: repr((r["doc_id"], r["text"])))]
    assert sorted(map(str, P.run(spark, data).collect())) == sorted(map(str, steps[5].collect()))
