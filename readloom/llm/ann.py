"""Nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample: each node's vectors are split by spherical k-means until its share of the
sample is small, and every row is then put into the leaf that it reaches by going to the nearest centre at each node.
A query takes nodes from a priority queue by the likeness of their centres; a leaf that comes up is visited, another node
gives way to its children.  How many leaves a query visits is calibrated: for some queries the true neighbours are
found by brute force over all rows, their leaves are looked up in the order in which the queries would visit them,
and visits are widened until the share of neighbours found reaches the wanted recall.  A query goes on where the leaves so
far hold too few rows.  Within a leaf every row is compared.

Leaves that are neighbours in the tree form shards of bounded size, larger leaves several; a query is sent once to
each shard that it visits.  Rows and queries of a shard meet in one group, and if its queries are many, in several.
Of rows with the same vector only those with the smallest ids can be among the nearest, so the others are put aside before
anything else, however many they are, and equal queries are searched for once.

Defined results: a query's nearest rows are ranked by cosine (double precision, from the vectors as given), ties by
the smaller id; rows whose vector or id is null, whose vector is zero or empty or holds a null or a number that is
not finite, or whose vector has not the commonest length (the greater of two), take no part; repeated rows are one, and rows
that share an id are one item, as near as the nearest of its vectors, and no neighbour of itself; a query with fewer
candidates than asked for gets all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import cut, give_back, to_python

#: Bounds of what the tree is fitted on and of the tree: rows, leaves, and bytes of vectors of either.
SAMPLE_ROWS, MAX_LEAVES, FIT_BYTES = 32_768, 4_096, 32_000_000
#: Rows that a leaf is meant to hold, and children of a node.
LEAF_ROWS, BRANCH = 64, 12
#: Queries that are answered by brute force, and the recall that is wanted for them.
CALIBRATION, RECALL = 200, 0.97
#: Bytes of vectors in a shard, queries that meet them at once, and queries of one task that plans visits.
SHARD_BYTES, QUERY_BLOCK, PLAN_ROWS = 8_000_000, 2_048, 2_000

RESULT = "query_id long, rank int, vec_id long, score double"


def unscaled(vectors: np.ndarray) -> np.ndarray:
    """The same directions: each row times a power of two, so that no square overflows or vanishes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, initial=1e-300))[1][:, None]) if len(vectors) else vectors


def unit(vectors: np.ndarray) -> np.ndarray:
    v = unscaled(vectors)
    return v / np.sqrt((v * v).sum(1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a with the same row of b."""
    a, b = unscaled(a), unscaled(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres (unit vectors) and each row's centre; fewer than k where rows are alike."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        used, own = np.unique(own, return_inverse=True)
        sums = np.zeros((len(used), x.shape[1]))
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(1))
        # opposite vectors may cancel out: any of them stands for the others then
        sums[size < 1e-9] = centres[used][size < 1e-9]
        centres = sums / np.maximum(np.sqrt((sums * sums).sum(1)), 1e-300)[:, None]
    own = (x @ centres.T).argmax(1)
    used, own = np.unique(own, return_inverse=True)
    return centres[used], own


@dataclass
class Tree:
    """Nodes: the centre of each, where its children begin and how many they are, and the leaf that it is (or -1)."""

    centres: np.ndarray
    first: np.ndarray
    many: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    @classmethod
    def fit(cls, x: np.ndarray, leaves: int, seed: int = 7) -> Tree:
        """A tree with about so many leaves, of unit vectors in rows; without rows it is one leaf."""
        rng, most = np.random.default_rng(seed), max(1, math.ceil(len(x) / max(1, leaves)))
        centres, first, many, members = [np.zeros(x.shape[1])], [0], [0], {0: np.arange(len(x))}
        todo = [0]
        for node in todo:
            rows = members.pop(node)
            if len(rows) <= most:
                continue
            found, own = k_means(x[rows], min(BRANCH, len(rows), max(2, math.ceil(len(rows) / most))), rng)
            if len(found) < 2:
                continue
            first[node], many[node] = len(centres), len(found)
            for j, c in enumerate(found):
                members[len(centres)] = rows[own == j]
                todo.append(len(centres))
                centres.append(c)
                first.append(0)
                many.append(0)
        leaf, count, stack = np.full(len(centres), -1), 0, [0]
        while stack:  # numbered in the order of the tree, so that neighbours have like numbers
            node = stack.pop()
            if many[node]:
                stack += range(first[node] + many[node] - 1, first[node] - 1, -1)
            else:
                leaf[node], count = count, count + 1
        return cls(np.array(centres), np.array(first), np.array(many), leaf)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row reaches."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.many[node]:
                out[rows] = self.leaf[node]
                continue
            lo = self.first[node]
            own = (x[rows] @ self.centres[lo : lo + self.many[node]].T).argmax(1)
            for j in np.unique(own):
                todo.append((lo + int(j), rows[own == j]))
        return out

    def order(self, q: np.ndarray) -> Iterator[int]:
        """All leaves, in the order in which a query visits them."""
        queue = [(-1.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.many[node]:
                yield int(self.leaf[node])
                continue
            lo = int(self.first[node])
            for j, s in enumerate((self.centres[lo : lo + self.many[node]] @ q).tolist()):
                heapq.heappush(queue, (-s, lo + j))


def usable(rows: DataFrame, vec_col: str, id_col: str, query: Column) -> DataFrame:
    """(id, v, q): the rows that take part but for their length, and whether each is a query."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(f"`{id_col}`").isNotNull() & sound).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("v"), F.coalesce(query, F.lit(False)).alias("q"))


def brute(rows: DataFrame, ids: list[int], vectors: np.ndarray, k: int) -> dict[int, list[tuple[int, int, float]]]:
    """Of each given query (few), its true neighbours among all rows (id, v, leaf): (id, leaf, cosine)."""
    width, units = vectors.shape[1], unit(vectors)
    given = rows.sparkSession.sparkContext.broadcast((np.array(ids), units))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = given.value
        best = [(np.zeros((len(own), 0)),) * 3]
        for batch in batches:
            x = matrix(batch.column(1), width)
            for at in range(0, len(x), 4096):
                some = unit(x[at : at + 4096])
                row, leaf = (batch.column(c).to_numpy(zero_copy_only=False)[at : at + 4096] for c in (0, 2))
                s = q @ some.T
                s[own[:, None] == row[None, :]] = -2.0
                s, row, leaf = (np.concatenate((a, np.broadcast_to(b, s.shape)), 1) for a, b in zip(best[0], (s, row, leaf), strict=True))
                if s.shape[1] > k:
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    s, row, leaf = (np.take_along_axis(a, top, 1) for a in (s, row, leaf))
                best[0] = (s, row, leaf)
        s, row, leaf = best[0]
        at, _ = np.nonzero(s > -1.5)
        yield pa.RecordBatch.from_arrays([pa.array(own[at], pa.int64()), *(pa.array(a[s > -1.5].astype(np.int64)) for a in (row, leaf)), pa.array(s[s > -1.5].astype(float))], ["c", "id", "leaf", "s"])

    found = to_python(rows.select("id", "v", "leaf")).mapInArrow(run, "c long, id long, leaf long, s double")
    top = found.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy(F.col("s").desc(), "id"))).where(F.col("k") <= k)
    out: dict[int, list[tuple[int, int, float]]] = {i: [] for i in ids}
    for r in top.collect():  # at most k rows of each of the given queries
        out[r["c"]].append((r["id"], r["leaf"], r["s"]))
    return out


def calibrate(tree: Tree, true: dict[int, list[tuple[int, int, float]]], vectors: dict[int, np.ndarray], recall: float) -> int:
    """The least number of visits by which so many of the true neighbours are found."""
    need = []
    for i, near in true.items():
        place = {leaf: k for k, leaf in enumerate(tree.order(vectors[i]), 1)} if near else {}
        need += [place[leaf] for _, leaf, _ in near]
    need.sort()
    return need[max(0, math.ceil(recall * len(need)) - 1)] if need else 1


def _top(query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which pairs are the k best of their query, one for each id."""
    order = np.lexsort((ids[row], -score, query))
    _, once = np.unique(np.stack((query[order], ids[row[order]])), axis=1, return_index=True)
    order = order[np.sort(once)]
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def _meet(width: int, k: int):
    """What is done with the queries and rows of one shard: each query's k best rows in the leaves that it visits."""
    schema = pa.schema([("qk", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        x, y = matrix(queries["v"], width), matrix(rows["v"], width)
        leaf, ids = rows["leaf"].to_numpy(), rows["id"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        y, leaf, ids = y[order], leaf[order], ids[order]
        ux, uy = unit(x), unit(y)
        visits = queries["leaves"].combine_chunks()
        who, where = np.repeat(np.arange(len(x)), np.diff(visits.offsets.to_numpy())), visits.flatten().to_numpy()
        by = np.argsort(where, kind="stable")
        who, where = who[by], where[by]
        pairs = [(np.zeros(0, np.int64),) * 2]
        for one in np.unique(leaf):
            (a, b), (lo, hi) = np.searchsorted(where, [one, one + 1]), np.searchsorted(leaf, [one, one + 1])
            for at in range(a, b, 256):
                some = who[at : min(b, at + 256)]
                s = ux[some] @ uy[lo:hi].T
                # all that could be among the k best once the last bits are settled
                least = np.partition(s, -k, axis=1)[:, -k] - 1e-12 if hi - lo > k else np.full(len(some), -2.0)
                i, j = np.nonzero(s >= least[:, None])
                pairs.append((some[i], lo + j))
        q, r = (np.concatenate(p) for p in zip(*pairs, strict=True))
        score = np.concatenate([cosines(x[q[i : i + 65536]], y[r[i : i + 65536]]) for i in range(0, max(len(q), 1), 65536)])
        keep = _top(q, r, score, ids, k)
        return pa.table([queries["qk"].to_numpy()[q[keep]], ids[r[keep]], score[keep]], schema=schema)

    return run, "qk long, id long, score double"


@dataclass
class Index:
    """Rows (id, v, leaf) of distinct vectors, written; the tree; and the rows of each leaf."""

    rows: DataFrame
    tree: Tree
    sizes: np.ndarray
    width: int


def build(base: DataFrame, width: int, n: int, k: int) -> Index:
    """The index of n rows (id, v); of equal vectors it holds the rows of the k smallest ids."""
    spark, sample_rows = base.sparkSession, min(SAMPLE_ROWS, FIT_BYTES // (8 * width))
    share = min(1.0, sample_rows / n)
    some = base.select("v") if share == 1 else base.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("v").limit(2 * sample_rows)
    x = np.unique(unit(matrix(some.toArrow()["v"], width)), axis=0)
    leaves = max(1, min(MAX_LEAVES, FIT_BYTES // (8 * width), math.ceil(n / LEAF_ROWS), len(x) // 8))
    tree = spark.sparkContext.broadcast(Tree.fit(x, leaves))
    kind = base.schema["v"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            own = np.concatenate([tree.value.assign(unit(x[at : at + 8192])) for at in range(0, max(len(x), 1), 8192)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], ["id", "v", "leaf"])
        give_back()

    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    first = base.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= k).select("id", "v").distinct()
    rows = cut(to_python(first).mapInArrow(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("v", kind), T.StructField("leaf", T.IntegerType())])))
    sizes = np.zeros(tree.value.leaves, np.int64)
    for r in rows.groupBy("leaf").count().collect():  # at most MAX_LEAVES
        sizes[r["leaf"]] = r["count"]
    return Index(rows, tree.value, sizes, width)


def shards(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Of each leaf, its first shard and how many it has: small leaves share one, so that none holds many more rows than ``most``."""
    out, now, held = [], 0, 0
    for n in sizes.tolist():
        parts = math.ceil(n / most)
        if held and (parts > 1 or held + n > most):
            now, held = now + 1, 0
        out.append((now, max(parts, 1)))
        if parts > 1:
            now += parts
        else:
            held += n
    return out


def search(rows: DataFrame, query: Column, k: int = 5, vec_col: str = "embedding", id_col: str = "vec_id", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of every row for which ``query`` holds."""
    spark = rows.sparkSession
    base = usable(rows, vec_col, id_col, query)
    known = base.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.count_if("q").alias("nq")).orderBy(F.desc("n"), F.desc("width")).first()
    if not known or not known["nq"]:
        return spark.createDataFrame([], RESULT)
    width, n, nq = known["width"], known["n"], known["nq"]
    base = base.where(F.size("v") == width)
    index = build(base.select("id", "v"), width, n, k + 1)
    tree, sizes = spark.sparkContext.broadcast(index.tree), index.sizes

    asked = base.where("q").select(F.col("id").alias("query_id"), "v", F.xxhash64("v").alias("h"))
    tried = asked.groupBy("query_id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION).collect()
    vectors = np.array([r["v"] for r in tried], float)
    ids = [r["query_id"] for r in tried]
    visits = calibrate(index.tree, brute(index.rows, ids, vectors, k), dict(zip(ids, unit(vectors), strict=True)), recall)

    place = shards(sizes, max(1, SHARD_BYTES // (8 * width)))
    kind = rows.schema[vec_col].dataType
    keys = asked.groupBy("h", "v").agg(F.min("query_id").alias("qk"))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, where, lists = [], [], []
            for i, q in enumerate(unit(matrix(batch.column(1), width))):
                by: dict[int, list[int]] = {}
                held = 0
                for seen, leaf in enumerate(tree.value.order(q)):
                    if seen >= visits and held > k:
                        break
                    held += int(sizes[leaf])
                    shard, parts = place[leaf]
                    for s in range(shard, shard + parts):
                        by.setdefault(s, []).append(leaf)
                took += [i] * len(by)
                where += by
                lists += by.values()
            picked = pa.array(took, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array(where, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["qk", "v", "shard", "leaves"])

    kinds = T.StructType([T.StructField("qk", T.LongType()), T.StructField("v", kind), T.StructField("shard", T.IntegerType()), T.StructField("leaves", T.ArrayType(T.IntegerType()))])
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(nq / PLAN_ROWS))
    sent = cut(to_python(keys.select("qk", "v").repartition(spread, "qk")).mapInArrow(plan, kinds))
    blocks = sent.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    # a row for each leaf, of which there are at most MAX_LEAVES
    homes = F.broadcast(spark.createDataFrame([(i, *p) for i, p in enumerate(place)], "leaf int, shard int, parts int"))
    held = index.rows.join(homes, "leaf").select("id", "v", "leaf", (F.col("shard") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("shard"))
    held = held.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("qk"), F.col("blocks")).cast("int"))
    run, out = _meet(width, k + 1)
    cols = ("shard", "block", "v")
    found = sent.select(*cols, "qk", "leaves").groupBy("shard", "block").cogroup(held.select(*cols, "id", "leaf").groupBy("shard", "block")).applyInArrow(run, out)

    # the k + 1 best of each distinct query are given to all rows that ask it
    best = found.groupBy("qk", "id").agg(F.max("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("qk").orderBy(F.col("score").desc(), "id"))).where(F.col("r") <= k + 1)
    answers = asked.join(keys, ["h", "v"]).select("query_id", "qk").join(best, "qk").where(F.col("query_id") != F.col("id"))
    answers = answers.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
