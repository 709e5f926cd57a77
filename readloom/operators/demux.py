"""Barcodes without a model: exact prefixes, the nearest barcode, and the renaming of demultiplexed reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.sequence import hamming
from ..plans.layout import least_distance
from ..sources.scratch import cut

#: A table of at most so many barcodes goes to every executor; a larger one is joined with the tags (``nearest_of_table``).
MOST_BARCODES = 10_000
#: So many barcodes may stand in a plan as constants; more go to the executors as one table.
MOST_CONSTANTS = 64


def nearest_barcode(reads: DataFrame, barcodes: list[tuple[str, str]], observed: Column, most: int | None = None) -> DataFrame:
    """Add sample, barcode and distance: the barcode (sample, sequence) with the fewest differing bases, the first in order on ties.

    Reads stay where they are: a few barcodes stand in the plan as constants, and larger tables (of a checked size) are
    held against each batch's distinct tags."""
    order = sorted(barcodes, key=lambda b: (b[1], b[0]))
    if len(order) > MOST_BARCODES:
        return nearest_of_table(reads, reads.sparkSession.createDataFrame(order, "sample string, barcode string"), observed, most)
    if len(order) > MOST_CONSTANTS:
        return _tagged(reads, observed, _nearest(order, most), "sample string, barcode string, distance int")
    table = F.array(*[F.struct(F.lit(s).alias("sample"), F.lit(b).alias("barcode")) for s, b in order])
    tag = F.col("\x00tag")
    scored = F.filter(F.transform(table, lambda b: F.struct(hamming(tag, b["barcode"]).alias("distance"), b["barcode"].alias("barcode"), b["sample"].alias("sample"))), lambda x: x["distance"].isNotNull())
    nearest = F.array_min(scored)
    if most is not None:
        nearest = F.when(nearest["distance"] <= most, nearest)
    # a generator is evaluated once, where plain columns would be for each field and again for each filter on them
    out = reads.withColumn("\x00tag", observed).select("*", F.inline_outer(F.array(nearest)).alias("\x00distance", "\x00barcode", "\x00sample"))
    return out.select(*[f"`{c}`" for c in reads.columns], *[F.col(f"\x00{c}").alias(c) for c in ("sample", "barcode", "distance")])


def exact_prefix(reads: DataFrame, barcodes: list[tuple[str, str]]) -> DataFrame:
    """Add sample: that of the first barcode with which the read begins; null if none."""
    if len(barcodes) > MOST_CONSTANTS:
        return _tagged(reads, F.substring("seq", 1, max(len(b) for _, b in barcodes)), _prefixes(barcodes), "sample string")
    return reads.withColumn("sample", F.coalesce(*[F.when(F.startswith("seq", F.lit(b)), F.lit(s)) for s, b in barcodes], F.lit(None)))


Answer = tuple[object, ...]


def _nearest(order: list[tuple[str, str]], most: int | None) -> Callable[[str], Answer]:
    """What ``nearest_barcode`` adds to a read with a tag; the barcodes are in order."""
    tables: dict[int, tuple[list[tuple[str, str]], np.ndarray]] = {}
    for size in {len(b) for _, b in order}:
        some = [x for x in order if len(x[1]) == size]
        tables[size] = some, np.array([[ord(c) for c in b] for _, b in some], np.uint32).reshape(len(some), size)

    def answer(tag: str) -> Answer:
        some, codes = tables.get(len(tag), ([], None))
        if not some:
            return None, None, None
        differ = (codes != np.array([ord(c) for c in tag], np.uint32)).sum(1)
        k = int(differ.argmin())
        return (*some[k], int(differ[k])) if most is None or differ[k] <= most else (None, None, None)

    return answer


def _prefixes(barcodes: list[tuple[str, str]]) -> Callable[[str], Answer]:
    """What ``exact_prefix`` adds to a read that begins so."""
    first: dict[str, int] = {}
    for k, (_, b) in enumerate(barcodes):
        first.setdefault(b, k)
    sizes = sorted({len(b) for b in first})

    def answer(start: str) -> Answer:
        k = min((first[start[:n]] for n in sizes if start[:n] in first and len(start) >= n), default=-1)
        return (barcodes[k][0],) if k >= 0 else (None,)

    return answer


def _tagged(reads: DataFrame, tag: Column, answer: Callable[[str], Answer], added: str) -> DataFrame:
    """Add the columns that ``answer`` gives for each read's tag (nulls for none), once per distinct tag of a batch."""
    new = T.StructType.fromDDL(added)
    schema = T.StructType([*reads.schema.fields, *new.fields])
    kinds = {"string": pa.string(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Answer] = {}
        for batch in batches:
            tags = batch.column(batch.num_columns - 1).to_pylist()
            if len(known) > 100_000:
                known.clear()
            known[None] = (None,) * len(new)
            for t in set(tags) - known.keys():
                known[t] = answer(t)
            rows = [known[t] for t in tags]
            cols = [pa.array([r[k] for r in rows], kinds[f.dataType.simpleString()]) for k, f in enumerate(new)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], schema.names)

    return reads.select("*", tag.alias("\x00tag")).mapInArrow(run, schema)


#: Tags are first looked up with so many places left open; of the few that are left, blocks of these sizes meet all barcodes.
_OPEN = 2
_TAG_BLOCK, _CODE_BLOCK = 2_000, 50_000


def _shuffled(rows: DataFrame) -> DataFrame:
    """The right side of a join, never sent whole to all: Spark takes the size of a small compressed file for that of the
    many rows that come of it, and would put them together in the driver."""
    return rows.hint("merge")


def _masked(text: Column, places: int) -> Column:
    """The text with each choice of so many places (0 to 2) blotted out: texts with one in common differ there only."""
    blot = lambda s, i: F.concat(F.substring(s, F.lit(1), i - 1), F.lit("\x00"), F.substring(s, i + 1, F.length(s)))
    n = F.length(text)
    if places == 0:
        return F.array(text)
    if places == 1:
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: blot(text, i)))
    return F.when(n >= 2, F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: blot(blot(text, i), j)))))


def _blocks_nearest(tags: pa.Table, codes: pa.Table) -> pa.Table:
    """Of each tag, the nearest of the barcodes of its length, the first in order on ties."""
    schema = pa.schema([("tag", pa.string()), ("distance", pa.int32()), ("barcode", pa.string()), ("sample", pa.string())])
    if not tags.num_rows or not codes.num_rows:
        return schema.empty_table()
    rows = sorted(zip(codes["barcode"].to_pylist(), codes["sample"].to_pylist(), strict=True))
    letters = lambda texts: np.array([[ord(c) for c in t] for t in texts], np.uint32).reshape(len(texts), -1)
    wanted, known = tags["tag"].to_pylist(), letters([b for b, _ in rows])
    out = []
    for tag, code in zip(wanted, letters(wanted), strict=True):
        differ = (known != code).sum(1)
        k = int(differ.argmin())
        out.append((tag, int(differ[k]), *rows[k]))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def nearest_of_table(reads: DataFrame, barcodes: DataFrame, observed: Column, most: int | None = None) -> DataFrame:
    """As ``nearest_barcode``, for a table (sample, barcode) of any size.

    Distinct tags meet the barcodes by joins on equal texts: as they are, then with one place left open, then with two,
    each for the tags that the step before left over.  Whatever a step finds is nearest, since nearer ones were found
    before.  Tags that differ in three places or more from all barcodes of their length are held against these in blocks,
    unless ``most`` rules that out.  Neither table goes through the driver or is sent to all executors; reads of a frequent
    tag meet one row."""
    tagged = reads.withColumn("\x00tag", observed)
    codes = barcodes.select("sample", "barcode").where(F.col("barcode").isNotNull())
    left = cut(tagged.where(F.col("\x00tag").isNotNull()).select(F.col("\x00tag").alias("tag")).distinct())
    kind, found = "tag string, distance int, barcode string, sample string", None
    for places in range(0, 1 + (_OPEN if most is None else min(most, _OPEN))):
        a = left.withColumn("key", F.explode(_masked(F.col("tag"), places)))
        b = codes.withColumn("key", F.explode(_masked(F.col("barcode"), places)))
        first = a.join(_shuffled(b), "key").groupBy("tag").agg(F.min(F.struct("barcode", "sample")).alias("m"))
        step = cut(first.select("tag", F.lit(places).alias("distance"), "m.barcode", "m.sample"))
        left = left.join(_shuffled(step), "tag", "left_anti")
        found = step if found is None else found.union(step)
    if most is None or most > _OPEN:
        far, size = left.withColumn("size", F.length("tag")), F.length("barcode").alias("size")
        # a row for each length: into how many blocks its barcodes and its tags are dealt
        shape = codes.groupBy(size).agg(F.ceil(F.count("*") / _CODE_BLOCK).cast("int").alias("n"))
        shape = shape.join(far.groupBy("size").agg(F.ceil(F.count("*") / _TAG_BLOCK).cast("int").alias("parts")), "size")
        far = far.join(shape, "size").select("size", "tag", F.pmod(F.xxhash64("tag"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
        near = codes.select("*", size).join(shape, "size").select("size", "barcode", "sample", F.pmod(F.xxhash64("barcode"), F.col("n")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        keys = ("size", "part", "block")
        met = far.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(_blocks_nearest, kind)
        best = met.groupBy("tag").agg(F.min(F.struct("distance", "barcode", "sample")).alias("m")).select("tag", "m.*")
        found = found.union(best if most is None else best.where(F.col("distance") <= most))
    out = tagged.join(_shuffled(found.withColumnRenamed("tag", "\x00tag")), "\x00tag", "left")
    return out.select(*[f"`{c}`" for c in reads.columns], "sample", "barcode", "distance")


def _shorter(text: Column, places: int) -> Column:
    """The text and all that are left of it without up to so many of its places (1 or 2)."""
    without = lambda s: F.when(F.length(s) >= 1, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array(s))
    once = F.array_union(F.array(text), without(text))
    return once if places == 1 else F.array_distinct(F.flatten(F.transform(once, lambda s: F.array_union(F.array(s), without(s)))))


def least_distances(reads: DataFrame, group: str, tag: Column) -> DataFrame:
    """(group, least): the least edit distance between the tags of each group's reads, of all groups with a few.

    A tag that a group has twice makes it 0.  Of the groups without one, tags that become the same text by leaving out a
    place of each are compared first, then, in the groups where that finds none so near, those that do by two places: so few
    tags can become one text that no group makes all its pairs.  Only in groups whose tags all differ in three places or more,
    which are the fewer the nearer tags have to be told apart, is each tag held against each other."""
    one = cut(reads.where(F.col(group).isNotNull() & F.col("ord").isNotNull()).groupBy(group, tag.alias("b")).agg((F.min("ord") < F.max("ord")).alias("again")))
    per = one.groupBy(group).agg(F.max("again").alias("any"), F.count("*").alias("n"))
    zero = per.where("any").select(group, F.lit(0).cast("bigint").alias("least"))
    rest, found = one.join(_shuffled(per.where("not any and n > 1")), group).select(group, "b"), zero
    for places in (1, 2):
        keyed = rest.select(group, "b", F.explode(_shorter(F.col("b"), places)).alias("key"))
        near = keyed.alias("x").join(_shuffled(keyed.alias("y")), [group, "key"]).where("x.b < y.b").withColumn("d", F.levenshtein("x.b", "y.b", places)).where("d >= 0")
        step = cut(near.groupBy(group).agg(F.min("d").cast("bigint").alias("least")))
        found, rest = found.union(step), rest.join(_shuffled(step), group, "left_anti")
    both = rest.alias("x").join(_shuffled(rest.alias("y")), group).where("x.b < y.b")
    return found.union(both.groupBy(group).agg(F.min(F.levenshtein("x.b", "y.b")).cast("bigint").alias("least")))


def name_barcode(name: Column) -> Column:
    """The last run of bases before a semicolon, or the end, of a read's name."""
    return F.nullif(F.regexp_extract(F.split(name, ";")[0], "([ACGT]+)[^ACGT]*$", 1), F.lit(""))


def rename(reads: DataFrame, sample_map: DataFrame) -> DataFrame:
    """(ord, sample, header, seq): reads named ``{sample}_{number} {name} orig_bc= new_bc= bc_diffs=``, numbered per sample.

    A name's barcode goes to its sample exactly, or else to the nearest barcode; numbers follow ``ord``."""
    named, few = reads.withColumn("observed", name_barcode(F.col("name"))), sample_map.select("sample", "barcode").limit(MOST_BARCODES + 1).collect()
    if len(few) <= MOST_BARCODES:
        found = nearest_barcode(named, [(r["sample"], r["barcode"]) for r in few], F.col("observed"))
    else:
        found = nearest_of_table(named, sample_map, F.col("observed"))
    found = found.where("sample is not null")
    n = numbered(found, "sample", "ord")
    header = F.concat_ws(" ", F.concat(F.col("sample"), F.lit("_"), F.col("number")), F.col("name"), F.concat(F.lit("orig_bc="), "observed"), F.concat(F.lit("new_bc="), "barcode"), F.concat(F.lit("bc_diffs="), F.col("distance").cast("string")))
    return n.select("ord", "sample", header.alias("header"), "seq")


def numbered(reads: DataFrame, group: str, order: str, block: int = 1 << 16) -> DataFrame:
    """Add number: 1, 2, ... within each group by order.

    Groups are counted in blocks of the order first, so that no task holds a whole group: a number is the count
    of the blocks before, plus the place within the block."""
    cell = F.floor(F.col(order) / block).cast("bigint")
    tagged = reads.withColumn("cell", cell)
    before = Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = tagged.groupBy(group, "cell").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(group, "cell").orderBy(order)
    return tagged.withColumn("place", F.row_number().over(inside)).join(cells, [group, "cell"]).withColumn("number", F.col("before") + F.col("place")).drop("cell", "place", "before")


def barcode_warning(barcodes: list[str]) -> str | None:
    d = least_distance(tuple(barcodes))
    return f"two barcodes are {d} apart" if d is not None and d < 2 else None
