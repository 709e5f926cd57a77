"""Near-duplicate groups by SimHash.

Fingerprints are 64-bit majority votes over XXH64 values of word shingles.  Fingerprints that differ
in few bits are linked by the pigeonhole principle: with the 64 bits in ``b`` blocks, two fingerprints
at distance ``d`` agree on at least ``b - d`` blocks, so each fingerprint is keyed once for every choice
of ``b - d`` blocks and pairs are looked for within equal keys only.  ``b`` follows the number of
distinct fingerprints, so that chance collisions stay rare at any size; the links found are the same
for every ``b``.  Keys with more than ``bucket_limit`` distinct fingerprints are not compared pair by
pair: their members meet at the centres of Hamming balls of half the distance, which gives the same
components in linear time.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; a text of
fewer words than a shingle is one shingle; equal texts get equal fingerprints; repeated ids yield one
row each, and rows are linked by their texts alone, whatever their ids; a row without an id links like
any other, and a group of such rows only has no component id; of that group deduplication keeps one row
(of the least hash of the text), of other groups the rows with the smallest id; an empty table gives an
empty result; ids are whole numbers (others fail to cast to long); other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, give_back, to_python
from .graph import components

BITS = 64
SHINGLE = 4
DISTANCE = 4
BUCKET_LIMIT = 4096
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[at : at + _CHUNK], np.uint64)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, fp) of every row: version is a hash of the text, fp the fingerprint of all of it, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64), pa.int64())], ["doc_id", "version", "fp"])
            pa.default_memory_pool().release_unused()
        give_back()

    return to_python(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, version long, fp long")


def block_count(n: int, distance: int = DISTANCE) -> int:
    """The least number of blocks whose keys have about as many values as there are fingerprints."""
    for b in range(distance + 1, 2 * distance + 2):
        if (b - distance) * BITS // b >= np.log2(max(n, 2)):
            return b
    return 2 * distance + 2


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """A signed mask for each choice of ``blocks - distance`` blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    one = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(one, blocks - distance)]


def ball(radius: int) -> list[int]:
    """Signed masks of at most ``radius`` bits."""
    return [_signed(sum(1 << i for i in c)) for r in range(radius + 1) for c in combinations(range(BITS), r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _longs(values: list[int]) -> Column:
    return F.lit(np.array(values, np.int64))


def linked_in_group(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the group's links, by breadth-first search over positions."""
    rest = np.arange(len(fps))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= distance
            if near.any():
                found = rest[near].tolist()
                yield from ((at, x) for x in found)
                front += found
                rest = rest[~near]


def _links_within(distance: int):
    """mapInArrow over rows sorted by key: the links within each key; a key may run over batch ends."""

    def links(key: np.ndarray, which: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (which[1:] != which[:-1]))))
        length = np.diff(np.append(new, len(key)))
        group = np.repeat(np.arange(len(new)), length)
        left, right = [], []
        small = length[group] <= 16
        for k in range(1, 16):  # every pair of the small groups, by the distance of their rows
            a = np.flatnonzero((group[:-k] == group[k:]) & small[:-k]) if len(group) > k else np.array([], int)
            if not len(a):
                break
            a = a[np.bitwise_count(fp[a] ^ fp[a + k]) <= distance]
            left.append(node[a])
            right.append(node[a + k])
        for g in np.flatnonzero(length > 16):
            at, n = new[g], length[g]
            pairs = np.array(list(linked_in_group(fp[at : at + n], distance)), np.int64).reshape(-1, 2) + at
            left.append(node[pairs[:, 0]])
            right.append(node[pairs[:, 1]])
        cat = lambda x: pa.array(np.concatenate(x) if x else np.array([], np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([cat(left), cat(right)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "which", "node", "fp")]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            first = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if first:
                yield links(*(c[:first] for c in cols[:3]), cols[3][:first].view(np.uint64))
            kept = [c[first:] for c in cols]
        if kept is not None:
            yield links(*kept[:3], kept[3].view(np.uint64))

    return run


def links(nodes: DataFrame, distance: int = DISTANCE, bucket_limit: int = BUCKET_LIMIT, blocks: int | None = None) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of (node, fp) within the distance."""
    masks = block_masks(blocks or block_count(nodes.count(), distance), distance)
    keyed = nodes.select("node", "fp", F.posexplode(F.transform(_longs(masks), lambda m: F.col("fp").bitwiseAND(m))).alias("which", "key"))
    met = keyed.groupBy("which", "key").count().where("count > 1")
    members = keyed.join(met, ["which", "key"])
    pairs = (
        members.where(F.col("count") <= bucket_limit)
        .select("which", "key", "node", "fp")
        .repartition("which", "key")
        .sortWithinPartitions("which", "key")
        .mapInArrow(_links_within(distance), "a long, b long")
    )
    large = members.where(F.col("count") > bucket_limit).select("node", "fp").distinct()
    reached = large.select("node", F.explode(F.transform(_longs(ball(distance // 2)), lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
    centre = reached.groupBy("z").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = reached.join(centre, "z").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    return pairs.union(stars)


def _grouped(docs: DataFrame, id_col: str, text_col: str, distance: int, bucket_limit: int) -> DataFrame:
    """(doc_id, version, fp, centre, component_id) for every row; centre is the group's least fingerprint."""
    prints = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), distance, bucket_limit))
    centred = cut(nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("centre")))
    # written before it is joined, so that a large group's side can be split
    named = cut(centred.groupBy("centre").agg(F.min("least").alias("component_id")))
    return prints.join(centred.select("fp", "centre").join(named, "centre"), "fp")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest id reachable."""
    return _grouped(docs, id_col, text_col, distance, bucket_limit).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, which all stay, and one row of each group without ids."""
    rows = cut(_grouped(docs, id_col, text_col, distance, BUCKET_LIMIT).select("doc_id", "version", "centre", "component_id"))
    first = rows.where("doc_id = component_id").select(F.col("doc_id").alias("\x00id"), F.col("version").alias("\x00version")).distinct()
    alone = rows.where("component_id is null").groupBy("centre").agg(F.min("version").alias("\x00version")).select("\x00version")
    keyed = docs.withColumns({"\x00key": F.col(id_col).cast("long"), "\x00hash": F.xxhash64(text_col)})
    same = F.col("`\x00hash`") == F.col("`\x00version`")
    named = keyed.join(first, (F.col("`\x00key`") == F.col("`\x00id`")) & same, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    rest = keyed.where("`\x00key` is null").join(alone, same, "left_semi")
    # equal texts: of these rows the one that is least as JSON
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = rest.groupBy("`\x00hash`").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return named.unionAll(one)
