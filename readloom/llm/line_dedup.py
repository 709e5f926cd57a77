"""Near-duplicate lines: an exact set-similarity join, from which later matches are removed.

A line is the set of its words, held as their 64-bit hashes; two lines match if the Jaccard similarity
of their sets is at least the threshold.  A line is removed if it matches any line before it, in the
order of (document id, hash of the text, line number), where the hash only counts among rows that share
an id or have none; lines without a word always stay.

Lines of one word set are one *form*, at the place of the first of them, so copies cost nothing but a
row.  The words of a form are ordered by rarity, taken from a fixed-size table of counts over all words;
matching forms share a word within their prefixes.  Forms are first held against the earliest form that
shares one of their rarest words: those that match are settled, which takes groups of near copies in
linear time.  Only the others are joined with everything before them.  Length, position and a parity
sketch of the sets (whose differing bits are at most the sets' differing words) precede the verification
of the whole sets.

Only DataFrame operations are used.  Defined results: a null text has no lines and stays null; a text
whose lines are all removed becomes empty; rows of one id that differ in text are documents of their own,
equal ones are one, so that neither loses lines to the other, and so are rows without an id; null ids come
first; an empty table gives an empty result; ids are whole numbers (others fail to cast to long); other columns
stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

THRESHOLD = 0.8
RARITY_BITS = 18
#: Of so many of its first words, by an order of their own, each pair leads a form to the earliest form that has both
#: there.  (The rarest words would not do: in a near copy they are the ones that were changed.)
LEADS = 4
#: Groups of more forms than CROWD are held against SLICES forms each.
CROWD, SLICES = 4, 32
#: Larger sets have two parity sketches.
SHORT = 80


def _plain(text: Column) -> Column:
    """The text with a space for each character that separates words but does not end a line."""
    odd = F.lit(False)
    for c in "\t\v\f\r":  # byte searches, which take far less than a pattern
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.regexp_replace(text, r"[\x09\x0B-\x0D]", " ")).otherwise(text)


def _hashes(line: Column) -> Column:
    """The hashes of the words of a line of plain text; an empty string between adjoining spaces is no word."""
    return F.array_remove(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def _every(counted: DataFrame, bits: int) -> DataFrame:
    """(b, n) for each b below 2**bits: that of ``counted``, or 0."""
    return counted.sparkSession.range(1 << bits).select(F.col("id").alias("b")).join(counted, "b", "left").select("b", F.coalesce("n", F.lit(0)).alias("n"))


def rarity(docs: DataFrame, bits: int = RARITY_BITS) -> DataFrame:
    """One row with one array of 2**bits longs: for each value of a hash's first ``bits``, what turns the hash
    (by exclusive or) into a long that begins with the rank of that value's number of words.

    The array's size does not depend on the input."""
    words = docs.select(F.explode(F.split(F.replace(_plain(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w <> ''")
    counted = words.select(F.shiftrightunsigned(F.xxhash64("w"), 64 - bits).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    flip = 1 << (bits - 1)  # signed longs sort by this bit first
    order = F.sort_array(F.collect_list(F.struct("n", "b")))
    place = F.sort_array(F.transform(order, lambda x, i: F.struct(x["b"].alias("b"), F.shiftleft(x["b"].bitwiseXOR(i.cast("long")).bitwiseXOR(F.lit(flip)), 64 - bits).alias("turn"))))
    return cut(_every(counted, bits).agg(F.transform(place, lambda x: x["turn"]).alias("entries")))


def _ordered(line: Column, turn: Column, bits: int) -> Column:
    """The set of a line's words as longs, rarest first."""
    # entries are never null; where Spark knows that, it sorts plain longs
    return F.sort_array(F.transform(F.array_distinct(_hashes(line)), lambda h: h.bitwiseXOR(F.coalesce(turn[F.shiftrightunsigned(h, 64 - bits)], F.lit(0).cast("long")))))


class _Sieve:
    """A Bloom filter of one hash and 2**bits bits, to leave out rows before a shuffle.

    Its size does not depend on the input; where it is full it lets everything through."""

    BITS = 22

    def __init__(self, rows: DataFrame, *cols: str) -> None:
        spot = self._spot(*cols)
        word = rows.select(F.shiftright(spot, 6).alias("b"), F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
        words = _every(word.groupBy("b").agg(F.bit_or("bit").alias("n")), self.BITS - 6)
        self.table = cut(words.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "n"))), lambda x: x["n"]).alias("entries")))

    def _spot(self, *cols: str) -> Column:
        return F.xxhash64(*cols).bitwiseAND(F.lit((1 << self.BITS) - 1))

    def hit(self, *cols: str) -> Column:
        """Whether a row may be among those the filter was made of."""
        spot = self._spot(*cols)
        entry = F.get(self.table.scalar(), F.shiftright(spot, 6).cast("int"))
        return F.call_function("shiftright", entry, spot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    def split(self, rows: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
        """The rows that may be among those the filter was made of, and those that are not."""
        hit = self.hit(*cols)
        return rows.where(hit), rows.where(~hit)


def prefix_length(n: Column, threshold: float) -> Column:
    """Of how many words a match must share one: the overlap with a set no larger is at least threshold * n."""
    return (n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")


#: A line's place.  row is the hash of the text where rows may share the id, else 0, which costs shuffles next to nothing.
PLACE = ("doc", "row", "line")


def least_joined(threshold: float) -> int:
    """The size from which on a set can match one that it does not equal: one of n words can match one of n + 1."""
    n = 1
    while n < (n + 1) * threshold - 1e-9 and threshold < 1:
        n += 1
    return n


def _rows(docs: DataFrame, id_col: str) -> DataFrame:
    """(doc, row, version, text) for every row."""
    some = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col("text"))
    shared = _Sieve(some.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "doc")
    return some.select("doc", F.when(shared.hit("doc"), F.xxhash64("text")).otherwise(0).alias("row"), F.xxhash64("text").alias("version"), "text")


def _lines(rows: DataFrame) -> DataFrame:
    """(*PLACE, version, s) for every line that has a word; s is plain."""
    lines = rows.select("doc", "row", "version", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line", "s"))
    return lines.where(F.trim("s") != "")


def _after(a: str, b: str) -> Column:
    return _beyond([F.col(f"{a}.{c}") for c in PLACE], [F.col(f"{b}.{c}") for c in PLACE])


def _beyond(a: list[Column], b: list[Column]) -> Column:
    """Whether place a comes after place b."""
    return (a[0] > b[0]) | ((a[0] == b[0]) & ((a[1] > b[1]) | ((a[1] == b[1]) & (a[2] > b[2]))))


def _possible(a: str, b: str, threshold: float) -> Column:
    """Length, position and sketch filters, which a match passes at its first shared word; positions count from 0.  The sketches of one set in two add up to that in one."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    both = na + nb
    need = both * F.lit(threshold / (1 + threshold)) - F.lit(1e-6)  # least overlap
    # at a pair's first shared word, the words before it are not shared
    rest = F.least(na - F.col(f"{a}.at"), nb - F.col(f"{b}.at"))
    before = F.col(f"{a}.at") + F.col(f"{b}.at")
    even, odd = (F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in ("bits", "odd"))
    sketch = F.when((na > SHORT) & (nb > SHORT), F.bit_count(even) + F.bit_count(odd)).otherwise(F.bit_count(even.bitwiseXOR(odd)))
    return (sketch <= both - 2 * need) & (before <= both - 2 * need) & (F.least(na, nb) >= F.greatest(na, nb) * F.lit(threshold) - F.lit(1e-6)) & (rest >= need)


def _pairs(near: DataFrame) -> DataFrame:
    """(*PLACE, *PLACE2): each pair of a join of later (a) and earlier (b) forms once."""
    return cut(near.select(*[f"a.{c}" for c in PLACE], *[F.col(f"b.{c}").alias(f"{c}2") for c in PLACE]).distinct())


def _verified(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The places of the later forms of candidate pairs (*PLACE, *PLACE2) whose whole sets match."""
    place2 = [f"{c}2" for c in PLACE]
    wanted = pairs.select(*PLACE).union(pairs.select(*place2)).distinct()
    wanted = cut(wanted)
    some = rows.where(_Sieve(wanted, "doc").hit("doc"))  # other rows need not be taken apart
    text = _Sieve(wanted, *PLACE).split(_lines(some).select(*PLACE, "s"), *PLACE)[0].join(wanted, [*PLACE])
    sets = cut(text.select(*PLACE, F.array_distinct(_hashes(F.col("s"))).alias("words")))
    other = sets.select(*[F.col(c).alias(f"{c}2") for c in PLACE], F.col("words").alias("words2"))
    both = pairs.join(sets, [*PLACE]).join(other, place2)
    common = F.size(F.array_intersect("words", "words2"))
    return both.where(common >= F.lit(threshold) * (F.size("words") + F.size("words2") - common) - F.lit(1e-9)).select(*PLACE).distinct()


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", bits: int = RARITY_BITS) -> DataFrame:
    """(doc, version, removed): for every document that loses lines, their sorted numbers.

    doc is the id (the least long for null) and version a hash of the text."""
    docs = docs.select(F.col(id_col), F.col("text"))
    rows = _rows(docs, id_col)
    keys = F.col("keys")
    turn = rarity(docs, bits)
    # the optimizer puts the subquery in the place of the column, so no row holds the array
    lines = _lines(rows).select("*", turn.scalar().alias("turn")).select(*PLACE, "version", _ordered(F.col("s"), F.col("turn"), bits).alias("keys"))

    def parity(words: Column) -> Column:
        return F.aggregate(words, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))))

    # one sketch of all words, or for large sets two, of the words whose hash has the next bit clear or set
    odd = F.when(F.size(keys) > SHORT, parity(F.filter(keys, lambda k: k.bitwiseAND(F.lit(64)) != 0))).otherwise(0)
    # the prefix, and never less than the words that lead
    first = F.when(F.size(keys) >= least_joined(threshold), F.transform(F.slice(keys, F.lit(1), F.greatest(prefix_length(F.size(keys), threshold), F.lit(LEADS))), lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")))
    wide = lines.select(*PLACE, "version", F.size(keys).alias("n"), F.xxhash64("keys").alias("sig1"), F.xxhash64("keys", F.lit(1)).alias("sig2"), parity(keys).alias("all"), odd.alias("odd"), first.alias("first"))
    wide = cut(wide.withColumn("bits", F.col("all").bitwiseXOR(F.col("odd"))).drop("all"))
    forms = cut(wide.groupBy("sig1", "sig2").agg(F.min(F.struct(*PLACE, "n", "bits", "odd", "first")).alias("f"), F.count("*").alias("copies")).select("sig1", "sig2", "f.*", "copies"))
    lines = cut(wide.select(*PLACE, "version", "sig1", "sig2"))
    del wide

    mixed = F.sort_array(F.transform("first", lambda k: F.xxhash64(k)))
    leads = F.array(*[F.xxhash64(F.get("mixed", F.lit(i)), F.get("mixed", F.lit(j))) for j in range(LEADS) for i in range(j)])
    lead = forms.where("first is not null").withColumn("mixed", mixed).select(*PLACE, "n", "bits", "odd", F.lit(0).alias("at"), F.explode(leads).alias("key"))
    # most keys are those of one form; they go before whole rows are sorted and sent
    shared = lead.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    lead = cut(_Sieve(shared, "key").split(lead, "key")[0])
    head = lead.groupBy("key").agg(F.min(F.struct(*PLACE, "n", "bits", "odd", "at")).alias("r"), F.count("*").alias("m")).where("m > 1").select("key", "m", "r.*")
    head = cut(head)
    near = lead.alias("a").join(head.alias("b"), "key").where(_after("a", "b") & _possible("a", "b", threshold))
    settled = cut(_verified(_pairs(near), rows, threshold))

    # in a crowd the earliest form may lie at the edge: those left are held against the earliest of each slice of it
    crowds = cut(head.where(F.col("m") > CROWD).select("key"))
    crowd = cut(_Sieve(crowds, "key").split(lead, "key")[0].join(crowds, "key"))
    part = F.pmod(F.xxhash64(*PLACE), F.lit(SLICES))
    heads = crowd.groupBy("key", part.alias("part")).agg(F.min(F.struct(*PLACE, "n", "bits", "odd", "at")).alias("r")).select("key", "r.*")
    left = crowd.join(settled, [*PLACE], "left_anti")
    near = left.alias("a").join(heads.alias("b"), "key").where(_after("a", "b") & _possible("a", "b", threshold))
    settled = cut(settled.union(_verified(_pairs(near), rows, threshold)))

    del lead, head, crowds, crowd, heads, left, near  # their checkpoints make room for the join
    some, others = _Sieve(settled, *PLACE).split(forms.where("first is not null"), *PLACE)
    some = some.join(settled.withColumn("settled", F.lit(True)), [*PLACE], "left")
    prefix = F.slice("first", F.lit(1), prefix_length(F.col("n"), threshold))
    marked = some.unionByName(others.withColumn("settled", F.lit(None).cast("boolean")))
    marked = marked.select(*PLACE, "n", "bits", "odd", F.when(F.col("settled"), 0).otherwise(1).alias("open"), F.posexplode(prefix).alias("at", "key"))
    # the condition on the later form names both sides: pushed below the join, it would keep the sides from sharing one shuffle
    later_is_open = F.col("a.open") * 2 + F.col("b.open") >= 2
    near = marked.alias("a").join(marked.alias("b"), "key").where(later_is_open & _after("a", "b") & _possible("a", "b", threshold))
    matched = cut(settled.union(_verified(_pairs(near), rows, threshold)))

    repeated = forms.where((F.col("copies") > 1) | _Sieve(matched, *PLACE).hit(*PLACE))
    verdict = repeated.join(matched.withColumn("matched", F.lit(True)), [*PLACE], "left").where("copies > 1 or matched").select("sig1", "sig2", *[F.col(c).alias(f"{c}1") for c in PLACE], "matched")
    gone = lines.join(verdict, ["sig1", "sig2"]).where(F.col("matched").isNotNull() | _beyond([F.col(c) for c in PLACE], [F.col(f"{c}1") for c in PLACE]))
    return gone.groupBy("doc", "version").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def dedup(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", removed_col: str | None = None) -> DataFrame:
    """``docs`` without the removed lines; with ``removed_col``, their numbers (from 0) in that column."""
    gone = cut(removed_lines(docs, threshold, id_col)).toDF("\x00doc", "\x00version", "\x00removed")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    keyed = docs.withColumns({"\x00key": key, "\x00hash": F.xxhash64("text")})
    some, others = _Sieve(gone, "`\x00doc`", "`\x00version`").split(keyed, "`\x00key`", "`\x00hash`")
    some = some.join(gone, (F.col("`\x00key`") == F.col("`\x00doc`")) & (F.col("`\x00hash`") == F.col("`\x00version`")), "left")
    gap = F.col("`\x00removed`")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda s, i: ~F.array_contains(gap, i)), "\n")
    none = F.array().cast("array<int>")

    def out(rows: DataFrame, text: Column, removed: Column) -> DataFrame:
        cols = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
        return rows.select(*cols, *([removed.alias(removed_col)] if removed_col else []))

    return out(some, F.when(gap.isNull(), F.col("text")).otherwise(left), F.coalesce(gap, none)).unionAll(out(others, F.col("text"), none))


SQL = r"""
WITH line AS (
  SELECT doc_id, pos - 1 AS pos, parts[pos] AS s
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL)),
worded AS (
  SELECT doc_id, pos, list_sort(list_distinct(regexp_extract_all(s, '[^\x20\x09-\x0D]+'))) AS ws FROM line),
form AS (
  SELECT ws, len(ws) AS n, MIN((doc_id, pos)) AS first, row_number() OVER () AS id FROM worded WHERE len(ws) > 0 GROUP BY ws),
word AS (
  SELECT id, n, unnest(ws) AS w FROM form),
rare AS (
  SELECT w, COUNT(*) AS df FROM word GROUP BY w),
prefix AS (
  SELECT id, n, w FROM word JOIN rare USING (w)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, w) <= n - CEIL(n * 0.8::DOUBLE - 1e-9) + 1),
near AS (
  SELECT DISTINCT a.id AS x, b.id AS y FROM prefix a JOIN prefix b ON a.w = b.w AND a.id <> b.id AND a.n BETWEEN b.n * 0.8 - 1e-6 AND b.n * 1.25 + 1e-6),
matched AS (
  SELECT DISTINCT x AS id FROM near JOIN form f ON f.id = x JOIN form g ON g.id = y
  WHERE f.first > g.first
    AND len(list_intersect(f.ws, g.ws)) >= 0.8::DOUBLE * (f.n + g.n - len(list_intersect(f.ws, g.ws))) - 1e-9),
gone AS (
  SELECT l.doc_id, l.pos FROM worded l JOIN form f ON l.ws = f.ws
  WHERE (l.doc_id, l.pos) > f.first OR f.id IN (SELECT id FROM matched)),
per AS (
  SELECT l.doc_id, COUNT(g.pos) AS n_removed,
    COALESCE(string_agg(CAST(g.pos AS VARCHAR), ',' ORDER BY g.pos), '') AS removed_lines,
    COALESCE(string_agg(CASE WHEN g.pos IS NULL THEN l.s END, chr(10) ORDER BY l.pos), '') AS text
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, COALESCE(removed_lines, '') AS removed_lines, p.text
FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id
"""
