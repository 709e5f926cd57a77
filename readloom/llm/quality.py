"""Quality rules: a few counts with fixed limits, then a calibrated classifier.

The classifier is logistic regression over hashed word and character n-grams: the mean over a text's
words of one weight per word, per adjacent word pair and per character n-gram (with word ends marked).
Because the model is linear, every distinct word has one score, kept in a bounded memory; word pairs
are scored with vectorised gathers.  It is trained on the driver with rows of a labelled table, at most
``max_train`` of them (those of the smallest id hashes; of rows that share an id, the least text), and calibrated by Platt scaling on a held-out
fifth.  Scoring runs in Arrow batches over whole texts against a fixed threshold.

Defined results: a null text counts as empty, has no words and fails the base rules; without usable
labels of both classes the classifier passes every text that the base rules pass; repeated rows get one
result each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import give_back, to_python

DIM_BITS = 18
CHAR_N = (2, 3, 4)
MAX_TRAIN = 1200
THRESHOLD = 0.3
#: Texts whose words are in Python at once.
_SLICE = 100
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\v\f\r"
#: About so many bytes of word scores are kept.
_MEMORY, _ENTRY = 12_000_000, 250
_MASK = np.uint64((1 << DIM_BITS) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    return (x ^ (x >> np.uint64(29))) & _MASK


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in words), np.uint64, len(words))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row of the word, feature) of each word's own weight and its character n-grams."""
    joined = b"".join(b"\x02" + w + b"\x03" for w in words)
    flat = np.frombuffer(joined.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begins = np.frombuffer(joined, np.uint8) & 0xC0 != 0x80  # of each character the first byte
    length = np.add.reduceat(begins, np.cumsum(size) - size, dtype=np.int64) if len(words) else size
    start = np.cumsum(length) - length
    row = np.repeat(np.arange(len(words)), length)
    left = start[row] + length[row] - np.arange(len(flat))
    rows, feats = [np.arange(len(words))], [_mix(word_hashes(words) + np.uint64(1))]
    code = flat.copy()
    for n in range(2, max(CHAR_N) + 1):
        code = code[:-1] * np.uint64(0x100000001B3) + flat[n - 1 :] if len(code) > 1 else code[:0]
        if n in CHAR_N:
            ok = np.flatnonzero(left[: len(code)] >= n)
            rows.append(row[ok])
            feats.append(_mix(code[ok] * np.uint64(8) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(feats).astype(np.int64)


def pair_features(hashes: np.ndarray) -> np.ndarray:
    return _mix((hashes[:-1] * np.uint64(31)) ^ hashes[1:]).astype(np.int64) if len(hashes) > 1 else np.array([], np.int64)


@dataclass
class Model:
    """Weights, and the slope and offset that turn a score into the probability of good quality."""

    weights: np.ndarray
    slope: float
    offset: float
    accuracy: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -30, 30)))


def _fit_logistic(cols: np.ndarray, rows: np.ndarray, values: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.5, decay: float = 1e-6) -> np.ndarray:
    """Full-batch Adagrad on sparse rows; classes weigh alike."""
    n, dim = len(y), 1 << DIM_BITS
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, seen = np.zeros(dim), np.full(dim, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, values * w[cols], n), -30, 30)))
        g = np.bincount(cols, values * ((p - y) * weight)[rows], dim) + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def train(texts: list[str], labels: list[int]) -> Model | None:
    """A calibrated model of label 1 against 0, or nothing if a class has too few rows."""
    y = np.array(labels, float)
    if len(y) < 20 or min(y.sum(), (1 - y).sum()) < 4:
        return None
    cols, rows, values = [], [], []
    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        uniq, back = np.unique(np.array(words, object), return_inverse=True) if words else (np.array([], object), np.array([], int))
        if not len(uniq):
            continue
        r, f = word_features(list(uniq))
        times = np.bincount(back)[r].astype(float)
        pairs = pair_features(word_hashes(list(uniq))[back])
        f, times = np.concatenate((f, pairs)), np.concatenate((times, np.ones(len(pairs))))
        u, at = np.unique(f, return_inverse=True)
        cols.append(u.astype(np.int32))
        values.append((np.bincount(at, times) / len(words)).astype(np.float32))
        rows.append(np.full(len(u), i, np.int32))
    if not cols:
        return None
    c, r, v = (np.concatenate(x) for x in (cols, rows, values))
    del cols, rows, values
    held = np.arange(len(y)) % 5 == 0
    if min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) < 1:
        held = np.zeros(len(y), bool)
    use = ~held[r]
    w = _fit_logistic(c[use], np.cumsum(~held)[r[use]] - 1, v[use], y[~held])
    score = np.bincount(r, v * w[c], len(y))
    test = held if held.any() else ~held
    slope, offset = _platt(score[test], y[test])
    hit = ((slope * score[test] + offset > 0) == (y[test] > 0)).mean()
    return Model(w.astype(np.float32), slope, offset, float(hit))


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack((score, np.ones_like(score)), 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return float(beta[0]), float(beta[1])


class Scorer:
    """Scores texts with one model; holds a bounded memory of word scores."""

    def __init__(self, model: Model | None) -> None:
        self.model, self.known, self.held = model, {}, 0

    def learn(self, words: set[bytes]) -> None:
        """Make sure that the score and hash of every word are known."""
        new = [w for w in words if w not in self.known]
        size = lambda some: sum(map(len, some)) + _ENTRY * len(some)
        if self.held + (more := size(new)) > _MEMORY:
            self.forget()
            new = list(words)
            more = size(new)
        self.held += more
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            r, f = word_features(part)
            score = np.bincount(r, self.model.weights[f], len(part))
            self.known.update(zip(part, zip(score.tolist(), word_hashes(part).tolist(), strict=True), strict=True))

    def forget(self) -> None:
        self.known, self.held = {}, 0

    def score(self, words: list[bytes], index: np.ndarray, distinct: list[bytes]) -> float:
        if not words:
            return 0.0
        found = [self.known[w] for w in distinct]
        total = np.array([x[0] for x in found])[index].sum()
        hashes = np.array([x[1] for x in found], np.uint64)[index]
        return float((total + self.model.weights[pair_features(hashes)].sum()) / len(words))


def repeat_words(index: np.ndarray, kinds: int) -> int:
    """Words that lie in a 3-word window found at least twice; index numbers the text's words."""
    if len(index) < 4:
        return 0
    a, b, c = index[:-2].astype(np.int64), index[1:-1], index[2:]
    pair = a * kinds + b
    if kinds > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * kinds + c
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    in_any = np.zeros(len(index), bool)
    for k in range(3):
        in_any[k : len(again) + k] |= again
    return int(in_any.sum())


def base_counts(text: str | None) -> tuple[tuple[int, int, int, int, int], list[bytes], np.ndarray, list[bytes]]:
    """The five counts; and the words, their numbering, and the distinct words."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    number: dict[bytes, int] = {}
    index = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    spaces = len(data) - len(data.translate(None, _SPACE))
    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    counts = len(words), len(text) - spaces, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(index, len(number))
    return counts, words, index, list(number)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    """Train on at most ``max_train`` labelled rows: those whose ids have the smallest hashes."""
    half = max_train // 2
    some = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = some.where("quality = 0").orderBy(*order).limit(half).union(some.where("quality = 1").orderBy(*order).limit(max_train - half)).collect()
    if not chosen:
        return None
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r[0], r[1]) for r in chosen], "doc_id long, quality int")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"]).encode()), r["doc_id"]))
    return train([r["text"] for r in rows], [r["quality"] for r in rows])


def verdicts(scorer: Scorer, texts: list[str | None], threshold: float) -> tuple[list, list[bool], np.ndarray, list[bool]]:
    """Of each text: its counts and words, whether the base rules fail it, the probability of good quality, and whether it stays."""
    got = [base_counts(t) for t in texts]
    failed = [base_failed(c[0], c[4]) for c, *_ in got]
    if scorer.model is None:
        p = np.ones(len(got))
    else:
        scorer.learn(set().union(*(d for (*_, d), bad in zip(got, failed, strict=True) if not bad)))
        p = scorer.model.probability(np.array([0.0 if bad else scorer.score(*g[1:]) for g, bad in zip(got, failed, strict=True)]))
    return got, failed, p, [not bad and bool(x >= threshold) for x, bad in zip(p, failed, strict=True)]


def judge(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all if None), the five counts, base_failed, probability and kept, for every row.

    A column of the input with the name of a new one is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = T.StructType([*BASE.fields, T.StructField("base_failed", T.BooleanType()), T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    fields = [f for f in docs.schema if (keep is None or f.name in keep) and f.name not in new.names]
    source = docs.select(F.col("text").alias("\x00text"), *[F.col(f"`{f.name}`") for f in fields])
    holder: list[Scorer] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holder:
            holder.append(Scorer(shared.value))
        scorer = holder[0]
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), _SLICE):
                part = batch.slice(at, _SLICE)
                got, failed, p, kept = verdicts(scorer, part.column(0).to_pylist(), threshold)
                counts = np.array([c for c, *_ in got], np.int64).reshape(-1, 5)
                cols = [pa.array(counts[:, i]) for i in range(5)]
                prob = pa.array([None if bad else float(x) for x, bad in zip(p, failed, strict=True)], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *cols, pa.array(failed, pa.bool_()), prob, pa.array(kept, pa.bool_())], [*(f.name for f in fields), *new.names])
        scorer.forget()
        give_back()

    return to_python(source).mapInArrow(run, T.StructType([*fields, *new.fields]))


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text, holder = docs.columns.index("text"), []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holder:
            holder.append(Scorer(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                *_, kept = verdicts(holder[0], part.column(at_text).to_pylist(), threshold)
                yield part.filter(pa.array(kept, pa.bool_()))
            pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batch took
        holder[0].forget()
        give_back()

    return to_python(docs).mapInArrow(run, docs.schema)
