"""Personal data in texts: exact rules, and a character-level BiLSTM-CRF that adds what the rules miss.

The rules find emails, addresses of hosts, card numbers (with a valid check digit) and phone numbers.  The
tagger, which knows secrets (tokens, keys, passwords) too, is a
bidirectional LSTM over characters whose tag sequence is scored by a CRF; it is trained here, in numpy,
from labelled spans: sentences of a bounded sample of documents into which numbers and addresses of many
shapes (and look-alikes that are none) are written at known places.  Texts are cut into overlapping
windows on a fixed grid.  A span must hold a digit or an at sign, so windows with neither are left
out.  Where windows overlap, their scores of a character are averaged, each by its distance from the
window's edge, and one best tag sequence is found over each whole run of windows, so that no seam breaks
a span.  Spans of the tagger that touch one of the rules are dropped.  A text is flagged if it has any span
but cards whose check digit is not valid.

Defined results: a null or empty text has no spans; equal texts get equal spans; repeated rows get one
result each; an empty table gives an empty result; other columns than the id and the text are ignored;
offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import give_back, sample, to_python

KINDS = ("email", "ip", "card", "phone")
FOUND = (*KINDS, "secret")  # the last by the tagger only
TAGS = 1 + 2 * len(FOUND)  # O, then begin and inside of each kind
WINDOW, STRIDE = 96, 48
HIDDEN = 16
CODES = 131  # ASCII, other letters, other characters, padding
PAD = 130
TRAIN_DOCS = 300
#: Of each of them, so many characters give the words around the generated sentences.
TRAIN_CHARS = 4_000
TRAIN_WINDOWS = 5000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the rules, by start and kind.  Each kind is leftmost and without overlap; failing matches are used up."""
    if not _TRIGGER.search(text):
        return []
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        left = at
        while left > free and text[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append((left, 0, free := m.end()))
        at = text.find("@", m.end() if m else at + 1)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() < 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_CODE = np.arange(0x3000, dtype=np.int64)
_CODE[128:] = [128 if chr(i).isalpha() else 129 for i in range(128, 0x3000)]
_CODE = np.append(_CODE, 129).astype(np.int16)


def codes(text: str) -> np.ndarray:
    return _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x3000)]


@dataclass
class Tagger:
    """Two LSTMs (index 0 reads forward, 1 backward), a linear layer to tag scores, and CRF scores."""

    wx: np.ndarray  # 2, CODES, 4 * HIDDEN
    wh: np.ndarray  # 2, HIDDEN, 4 * HIDDEN
    wo: np.ndarray  # 2 * HIDDEN, TAGS
    bo: np.ndarray  # TAGS
    trans: np.ndarray  # TAGS, TAGS
    start: np.ndarray  # TAGS

    def params(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.wo, self.bo, self.trans, self.start]


def new_tagger(rng: np.random.Generator) -> Tagger:
    h = HIDDEN
    make = lambda *s, x=0.3: rng.normal(0, x, s).astype(np.float32)
    t = Tagger(make(2, CODES, 4 * h), make(2, h, 4 * h), make(2 * h, TAGS), np.zeros(TAGS, np.float32), make(TAGS, TAGS, x=0.01), np.zeros(TAGS, np.float32))
    t.wx[:, :, h : 2 * h] += 1  # remember at first
    return t


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def run_lstm(t: Tagger, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states (T, 2, B, H), in each reader's own order; with ``keep``, what the gradient needs."""
    h4, n = HIDDEN, x.shape[1]
    both = np.stack((x, x[:, ::-1]))
    hs = np.zeros((n, 2, len(x), h4), np.float32)
    h = np.zeros((2, len(x), h4), np.float32)
    c, kept = np.zeros_like(h), []
    for k in range(n):
        z = np.matmul(h, t.wh)
        z[0] += t.wx[0][both[0, :, k]]
        z[1] += t.wx[1][both[1, :, k]]
        s = _sigmoid(z[..., : 3 * h4])
        g = np.tanh(z[..., 3 * h4 :])
        i, f, o = s[..., :h4], s[..., h4 : 2 * h4], s[..., 2 * h4 :]
        old, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            kept.append((h, old, s, g, tc))
        h = o * tc
        hs[k] = h
    return hs, kept


def emissions(t: Tagger, hs: np.ndarray) -> np.ndarray:
    """(T, B, TAGS) from the states of both readers."""
    return hs[:, 0] @ t.wo[:HIDDEN] + hs[::-1, 1] @ t.wo[HIDDEN:] + t.bo


def viterbi(t: Tagger, e: np.ndarray) -> np.ndarray:
    """(B, T): each window's best tag sequence."""
    return decode(t, [e])


def decode(t: Tagger, parts: Iterable[np.ndarray]) -> np.ndarray:
    """(B, T): the best tag sequences of B texts whose emissions come in parts (T, B, TAGS)."""
    score, backs = None, []
    for e in parts:
        back = np.zeros(e.shape, np.int8)
        for k in range(len(e)):
            if score is None:
                score = e[0] + t.start
                continue
            step = score[:, :, None] + t.trans
            back[k] = step.argmax(1)
            score = step.max(1) + e[k]
        backs.append(back)
    out = np.zeros((sum(map(len, backs)), score.shape[0]), np.int8)
    rows, tag, at = np.arange(score.shape[0]), score.argmax(1).astype(np.int8), len(out)
    for back in reversed(backs):
        for k in range(len(back) - 1, -1, -1):
            at -= 1
            out[at] = tag
            tag = back[k][rows, tag]
    return out.T


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def gradients(t: Tagger, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of tags y (B, T) and its gradient for every parameter."""
    hs, kept = run_lstm(t, x, keep=True)
    e = emissions(t, hs)
    n, b, h = x.shape[1], len(x), HIDDEN
    fwd, bwd = np.zeros_like(e), np.zeros_like(e)
    fwd[0] = e[0] + t.start
    for k in range(1, n):
        fwd[k] = _lse(fwd[k - 1][:, :, None] + t.trans, 1) + e[k]
    for k in range(n - 2, -1, -1):
        bwd[k] = _lse(t.trans + (e[k + 1] + bwd[k + 1])[:, None, :], 2)
    z = _lse(fwd[-1], 1)
    rows = np.arange(b)
    gold = t.start[y[:, 0]] + sum(e[k][rows, y[:, k]] for k in range(n)) + sum(t.trans[y[:, k - 1], y[:, k]] for k in range(1, n))
    de = np.exp(fwd + bwd - z[None, :, None])
    dtrans = np.zeros_like(t.trans)
    for k in range(1, n):
        dtrans += np.exp(fwd[k - 1][:, :, None] + t.trans + (e[k] + bwd[k])[:, None, :] - z[:, None, None]).sum(0)
    np.add.at(dtrans, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
    for k in range(n):
        de[k][rows, y[:, k]] -= 1
    de /= b
    dstart = de[0].sum(0)
    flat = de.reshape(-1, TAGS)
    dwo = np.concatenate((hs[:, 0].reshape(-1, h).T @ flat, hs[::-1, 1].reshape(-1, h).T @ flat))
    dh_out = np.stack((de @ t.wo[:h].T, (de @ t.wo[h:].T)[::-1]), 1)
    dwx, dwh = np.zeros_like(t.wx), np.zeros_like(t.wh)
    both = np.stack((x, x[:, ::-1]))
    dh, dc = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
    for k in range(n - 1, -1, -1):
        before, old, s, g, tc = kept[k]
        i, f, o = s[..., :h], s[..., h : 2 * h], s[..., 2 * h :]
        dh = dh + dh_out[k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate((dc * g * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), -1)
        dwh += np.matmul(before.transpose(0, 2, 1), dz)
        for d in (0, 1):
            np.add.at(dwx[d], both[d, :, k], dz[d])
        dh, dc = np.matmul(dz, t.wh.transpose(0, 2, 1)), dc * f
    return float((z - gold).mean()), [dwx, dwh, dwo, flat.sum(0), dtrans / b, dstart]


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 96, rate: float = 0.02, seed: int = 3) -> Tagger:
    """Adam over shuffled batches, with a rate that falls to a tenth."""
    rng = np.random.default_rng(seed)
    t = new_tagger(rng)
    m1 = [np.zeros_like(p) for p in t.params()]
    m2 = [np.zeros_like(p) for p in t.params()]
    total, step = epochs * max(1, len(x) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, max(len(x) - batch + 1, 1), batch):
            pick, step = order[at : at + batch], step + 1
            _, grads = gradients(t, x[pick], y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            now = rate * (1 - 0.9 * step / total)
            for p, g, a, b in zip(t.params(), grads, m1, m2, strict=True):
                g = g * min(1, 5 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return t


# -- labelled spans ---------------------------------------------------------------------------------

_PHONES = ("+# (###) ###-####", "+## ## #### ####", "(###) ###-####", "###-###-####", "+##-###-#######", "0## ### ## ##", "+# ### ### ####", "00## ### #######", "###.###.####")
_CARDS = ("################", "#### #### #### ####", "####-####-####-####", "#### ###### #####", "###############", "###################", "####.####.####.####")
_SECRETS = ("token", "key", "secret", "password", "api_key", "access token", "auth")
_LETTERS = "0123456789" * 2 + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OTHER = ("version #.", "#.#", "##.##", "19##", "20##", "#,###", "##:##", "20##-0#-1#", "$##.##", "No. ####", "#####", "(#)", "#.#.#", "####/##", "##%", "ISBN ###-#-##", "@", "@ ##")


def _digits(r: random.Random, shape: str) -> str:
    return re.sub("#", lambda _: str(r.randrange(10)), shape)


def _name(r: random.Random) -> str:
    return "".join(r.choice(("an", "er", "jo", "li", "mar", "to", "ka", "be", "son", "el")) for _ in range(r.randint(1, 4)))


def _insert(r: random.Random) -> tuple[str, int]:
    """A text and the number of its kind, or -1 for a look-alike; of a secret, the part after the last blank, quote, colon or equals sign."""
    kind = r.choice((0, 0, 1, 2, 2, 3, 3, 4, -1, -1, -1))
    if kind == 0:
        user = _name(r) + r.choice(("", ".", "_", "+")) + r.choice((_name(r), str(r.randrange(100))))
        return user + r.choice(("@", "@", "@", " @ ", "(@)")) + _name(r) + r.choice(("", str(r.randrange(10)), "-" + _name(r))) + "." + r.choice(("com", "org", "example.com", "example.net", "co.uk", "de")), 0
    if kind == 1:
        if r.random() < 0.15:
            return ":".join(f"{r.randrange(65536):x}" for _ in range(8)), 1
        return ".".join(str(r.randrange(256)) for _ in range(4)) + (f":{r.randrange(65536)}" if r.random() < 0.1 else ""), 1
    if kind == 2:
        return _digits(r, r.choice(_CARDS)), 2
    if kind == 3:
        return _digits(r, r.choice(_PHONES)), 3
    if kind == 4:
        letters = r.choice(("0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF", _LETTERS))
        return r.choice(_SECRETS) + r.choice((" = ", "=", ": ", ":")) + r.choice(('"', "'", "")) + "".join(r.choice(letters) for _ in range(r.choice((24, 32, 40, 40, 48, 64)))), 4
    if r.random() < 0.3:
        return r.choice(("id", "part", "rev", "build", *_SECRETS)) + r.choice((" = ", "=", ": ")) + "".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 9))), -1
    return _digits(r, r.choice(_OTHER)), -1


def labelled(texts: list[str], n: int = TRAIN_WINDOWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of codes and tags: words of the texts, and spans and look-alikes at known places."""
    r = random.Random(seed)
    words = [w for t in texts for w in t.split() if not _TRIGGER.search(w)] or ["lorem", "ipsum", "dolor"]
    x, y = np.full((n, WINDOW), PAD, np.int16), np.zeros((n, WINDOW), np.int16)
    for row in range(n):
        text, tags = "", []
        while len(text) < WINDOW + 40:
            if r.random() < 0.35:
                part, kind = _insert(r)
            else:
                at = r.randrange(len(words))
                part, kind = " ".join(words[at : at + r.randint(1, 8)]), -1
            part += r.choice(("", "", "", "", ".", ",", "!!", "***", "###"))[: 3 if kind < 0 else 3]
            size = len(part) if kind < 0 else len(part.rstrip(".,!*#"))
            lead = max(part.rfind(c) for c in " \"':=") + 1 if kind == 4 else 0
            if lead and part[lead - 1] in "\"'":
                part, size = part[:size] + part[lead - 1] + part[size:], size
            if r.random() < 0.1:
                part = part.upper()
            sep = r.choice((" ",) * 12 + ("\n", ": ", " | ", "  ", "\t", ", "))
            text += part + sep
            tags += ([0] * len(part) if kind < 0 else [0] * lead + [1 + 2 * kind] + [2 + 2 * kind] * (size - lead - 1) + [0] * (len(part) - size)) + [0] * len(sep)
        at = r.randrange(40)
        end = WINDOW if r.random() < 0.9 else r.randint(20, WINDOW)
        x[row, :end], y[row, :end] = codes(text[at : at + end]), tags[at : at + end]
    return x, y


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS, windows: int = TRAIN_WINDOWS, chars: int = TRAIN_CHARS) -> Tagger:
    """A tagger whose sentences come from the first ``chars`` characters of at most ``max_docs`` documents: those of the smallest id hashes."""
    rows = sample(docs.where("text is not null").withColumn("text", F.substring("text", 1, chars)), max_docs, "text")
    return fit(*labelled([text for _, text in rows], windows))


# -- whole texts ------------------------------------------------------------------------------------


def _cells(t: Tagger, runs: list[tuple[np.ndarray, int]], windows: int, batch: int) -> Iterator[np.ndarray]:
    """Emissions (T, B, TAGS) of B runs of so many windows each, which begin in their texts' codes where the runs say."""
    step = max(1, batch // len(runs))
    left = (np.arange(STRIDE, dtype=np.float32) + 1)[:, None, None] / (STRIDE + 1)  # how much the later window counts
    before = None
    for at in range(0, windows, step):
        n = min(step, windows - at)
        x = np.full((len(runs), (n + 1) * STRIDE), PAD, np.int16)
        for row, (coded, start) in enumerate(runs):
            piece = coded[start + at * STRIDE :][: x.shape[1]]
            x[row, : len(piece)] = piece
        cut = np.stack([x[:, k * STRIDE : k * STRIDE + WINDOW] for k in range(n)])
        e = emissions(t, run_lstm(t, cut.reshape(-1, WINDOW))[0]).reshape(WINDOW, n, len(runs), TAGS)
        for k in range(n):
            now = e[:STRIDE, k] if before is None else e[:STRIDE, k] * left + before * (1 - left)
            now[x[:, k * STRIDE : (k + 1) * STRIDE].T == PAD] = np.where(np.arange(TAGS) == 0, 50, 0)
            yield now
            before = e[STRIDE:, k].copy()
    before[x[:, n * STRIDE :].T == PAD] = np.where(np.arange(TAGS) == 0, 50, 0)
    yield before


def tag_texts(t: Tagger, texts: list[str], batch: int = 512) -> list[np.ndarray]:
    """The tag of every character of every text."""
    coded = [codes(x) for x in texts]
    runs: dict[int, list[tuple[int, int]]] = {}  # by their number of windows: text and first character
    for k, c in enumerate(coded):
        hot = np.unique(np.flatnonzero(((c >= 48) & (c <= 57)) | (c == 64)) // STRIDE)
        cells = np.unique(np.concatenate((hot, hot - 1)))
        cells = cells[cells >= 0]
        first = np.flatnonzero(np.diff(cells, prepend=-2) > 1)
        for i, n in zip(first.tolist(), np.diff(first, append=len(cells)).tolist(), strict=True):
            runs.setdefault(n, []).append((k, int(cells[i]) * STRIDE))
    out = [np.zeros(len(c), np.int8) for c in coded]
    for n, group in runs.items():
        many = max(1, batch // n)
        for at in range(0, len(group), many):
            part = group[at : at + many]
            tags = decode(t, _cells(t, [(coded[k], s) for k, s in part], n, batch))
            for (k, s), row in zip(part, tags, strict=True):
                out[k][s : s + len(row)] = row[: len(out[k]) - s]
    return out


def tag_spans(text: str, tags: np.ndarray) -> Iterator[Span]:
    """Spans of the tags that hold a digit or an at sign, without spaces at the ends."""
    n = len(tags)
    kind = (tags.astype(int) + 1) // 2  # 0: none
    starts = np.flatnonzero((kind > 0) & ((tags % 2 == 1) | (np.concatenate(([0], kind[:-1])) != kind)))
    for s in starts.tolist():
        e = s + 1
        while e < n and kind[e] == kind[s] and tags[e] % 2 == 0:
            e += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        while s < e and text[s].isspace():
            s += 1
        part = text[s:e]
        digits = re.sub("[^0-9]", "", part)
        fits = ("@" in part, len(digits) >= 4, len(digits) >= 4, len(digits) >= 4, len(digits) >= 4 and e - s >= 16)
        if e > s and fits[kind[s] - 1]:
            yield s, int(kind[s]) - 1, e


def find(t: Tagger | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For every text, the spans of the rules, and all spans."""
    base = [base_spans(x) for x in texts]
    hot = [i for i, x in enumerate(texts) if _TRIGGER.search(x)] if t is not None else []
    whole = [list(b) for b in base]
    for i, tags in zip(hot, tag_texts(t, [texts[i] for i in hot]) if hot else [], strict=True):
        taken = np.zeros(len(texts[i]) + 1, bool)
        for s, _, e in base[i]:
            taken[s:e] = True
        whole[i] = sorted([*base[i], *(x for x in tag_spans(texts[i], tags) if not taken[x[0] : x[2]].any())])
    return list(zip(base, whole, strict=True))


def flagged(text: str, spans: list[Span]) -> bool:
    """Whether any span is more than a number that looks like a card's."""
    return any(FOUND[k] != "card" or luhn(re.sub("[^0-9]", "", text[s:e])) for s, k, e in spans)


def show(spans: list[Span]) -> str:
    return ",".join(f"{FOUND[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, flagged boolean"


def scan(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """(doc_id, counts and digest of the rules' spans, all spans, their number, ``flagged``) for every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 500):
                part = batch.slice(at, 500)
                texts = [x or "" for x in part.column(1).to_pylist()]
                found = find(shared.value, texts)
                counts = [pa.array([sum(k == j for _, k, _ in b) for b, _ in found], pa.int64()) for j in range(len(KINDS))]
                digest = pa.array([hashlib.sha256(show(b).encode()).hexdigest() for b, _ in found], pa.string())
                whole = [pa.array([show(w) for _, w in found], pa.string()), pa.array([len(w) for _, w in found], pa.int64()), pa.array([flagged(x, w) for x, (_, w) in zip(texts, found, strict=True)], pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digest, *whole], [x.split()[0] for x in SCHEMA.split(", ")])
        give_back()

    return to_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{FOUND[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])
