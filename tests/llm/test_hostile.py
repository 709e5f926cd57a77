"""Inputs made to crash or stall the operators, clashing columns, and what the methods themselves decide."""

from __future__ import annotations

import math
import random
import re
import time
from copy import copy

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import common, html_extract as H, language_id, media, mixing, pii, quality
from readloom.llm.common import table

# -- pages ------------------------------------------------------------------------------------------

HOSTILE = {
    "open tags, a lone quote": "<a " * 160_000 + "'",
    "stray closes": "<div>" * 100_000 + "</x>" * 100_000,
    "items over inline tags": "<i>" * 100_000 + "<dt></dt>" * 50_000,
    "closes behind a scope": "<b><div>" + "<i>" * 50_000 + "</b>" * 100_000,
    "open quotes": "<a x='" * 100_000,
    "comments": "<!--" * 200_000,
    "raw text": "<title>" * 100_000,
    "attributes": "<p " + "a=\"'" * 100_000 + ">x",
    "blanks": "<div a" + " " * 500_000 + ">x</div>",
    "equals": "<a b" + " = " * 200_000 + ">",
    "metas": "<meta content-language " * 50_000,
    "langs": "<html lang " * 50_000,
    "depth": "<p><div>" * 60_000 + "word",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_is_linear_in_a_page(name):
    began = time.process_time()
    page = H.Page(HOSTILE[name])
    H.extract(HOSTILE[name])
    language_id.declared(page)
    assert time.process_time() - began < 8  # quadratic: minutes


def test_learned_weights_decide(spark, data, monkeypatch):
    pages = [r["html"] for r in table(spark, data, "pages").collect()]
    want = [H.extract(p) for p in pages]
    assert all(want)
    for tag in ("div", "section", 'div class="x"'):
        assert [H.extract(p.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag.split()[0]}>")) for p in pages] == want
    neutral = copy(H.learned())
    neutral.evidence, neutral.word, neutral.tags = {}, 1.0, dict.fromkeys(neutral.tags, 0.0)
    for name in ("_OTHER_BLOCK", "_OTHER_INLINE"):
        monkeypatch.setattr(H, name, 0.0)
    assert not any(H.extract(p, neutral) == w for p, w in zip(pages, want, strict=True))
    monkeypatch.undo()
    monkeypatch.setattr(H, "best_run", lambda scores: (0, len(scores)))
    assert not any(H.extract(p) == w for p, w in zip(pages, want, strict=True))


def test_the_region_is_the_best_of_all():
    r = random.Random(12)
    parts = ["<p>", "</p>", "<div>", "</div>", "<ul><li>", "</ul>", "<a href=x>", "</a>", "one two three four five", "word", '<div class="ad">', "<nav>", "</nav>", "<br>"]
    for _ in range(60):
        page = "".join(r.choice(parts) for _ in range(r.randint(1, 25)))
        read = H.Page(page)
        scores = H.learned().scores(read)
        n = len(scores)
        lo, hi = max(((i, j) for i in range(n) for j in range(i, n + 1)), key=lambda x: (round(sum(scores[x[0] : x[1]]), 9), -x[0], -x[1]), default=(0, 0))
        got = H.best_run(scores)
        assert sum(scores[got[0] : got[1]]) == pytest.approx(max(0, sum(scores[lo:hi])))
        words = [w for (name, text, _), s in zip(read.tokens[got[0] : got[1]], scores[got[0] : got[1]], strict=True) if not name and s >= 0 for w in text.split()]
        assert "".join(H.extract(page).split()) == "".join(words)


def test_runs_that_cost_are_those_of_a_search():
    """Maximal runs of least sum: less than any of their parts, and in no longer run of the kind."""
    r = random.Random(3)
    for _ in range(400):
        x = [float(r.randint(-4, 4)) for _ in range(r.randint(0, 12))]
        n = len(x)
        total = [sum(x[:i]) for i in range(n + 1)]
        # every beginning costs, and every end does
        fit = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if all(total[k] < total[i] for k in range(i + 1, j + 1)) and all(total[k] > total[j] for k in range(i, j))]
        whole = [p for p in fit if not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in fit)]
        firm = [i for i, s in enumerate(x) if s > 0]
        assert H.least_runs(x) == [(a, b) for a, b in whole if firm and firm[0] < a and b <= firm[-1]]
    began = time.process_time()
    H.least_runs([-1.0, 0.5] * 100_000 + [3.0, -2.0] * 100_000 + [0.5, -1.0] * 100_000)
    assert time.process_time() - began < 5


WRAPPERS = (
    "wrapper nav-open|layout sidebar-left|content comments-open|main-column no-sidebar|entry share-on|story related-topics-politics|page has-sidebar|main ads-enabled|post-body with-comments|"
    "container header-fixed|site footer-sticky|grid menu-closed|single-post share-enabled|body-copy cookie-accepted|article-wrap newsletter-on|text search-open|inner banner-top|row promo-hidden|box related-left|td-post-content no-ads"
)


@pytest.mark.parametrize("words", [5, 14, 60])
def test_wrappers_that_name_what_a_page_has_do_not_hide_the_body(words):
    parts = [" ".join(f"w{i}" for i in range(n)) + "." for n in (words, words + 4, words)]
    body = "".join(f"<p>{p}</p>" for p in parts)
    for w in WRAPPERS.split("|"):
        for page in (
            f'<body><div class="{w}">{body}</div></body>', f'<body><div class="{w}"><article>{body}</article></div></body>', f'<body><article><div class="{w}">{body}</div></article></body>',
            f'<body><nav><a>x</a></nav><section class="{w}">{body}</section><footer>the foot</footer></body>',
        ):
            assert H.extract(page) == "\n\n".join(parts), page


def test_what_is_named_by_joined_words_goes_whatever_its_length():
    text = lambda n: " ".join(f"w{i}" for i in range(n)) + "."
    parts = [text(5), text(30), text(33), text(3)]
    body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}</p>" for p in parts[1:])
    for name in "site-footer cookie-notice cookie-banner newsletter-signup related-posts share-buttons ad-slot comment-list comments-area social-links site-header main-menu sidebar-widget popup-overlay user-comments search-form promo-box".split():
        for n in (8, 25, 200):
            other = f'<div class="{name}"><p>{text(n)}</p></div>'
            for page in (f"<body>{other}<article>{body}</article></body>", f"<body><div>{body}</div>{other}</body>", f"<body><article><h1>{parts[0]}</h1><p>{parts[1]}</p>{other}<p>{parts[2]}</p><p>{parts[3]}</p></article></body>"):
                assert H.extract(page) == "\n\n".join(parts), page


def test_no_pages(spark):
    none = H.main_text(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.collect() == [] and none.columns == ["page_id", "url", "text", "n_chars"]


def test_lists_and_headings_of_articles_stay_and_adverts_within_go():
    text = lambda c, n=30: " ".join([c] * n)
    inner = f"<h1>A title of some words</h1><ul><li>one two three four five six</li></ul><ol><li>a b c d e f</li></ol><h3>head</h3><p>{text('w')}</p><div class='ad'>buy now</div><p>{text('v')}</p>"
    want = f"A title of some words\n\none two three four five six\n\na b c d e f\n\nhead\n\n{text('w')}\n\n{text('v')}"
    for shape in ("article", "div", "main", 'div id="content"', "section"):
        page = f'<body><div class="has-sidebar"><div class="sidebar">s s</div><{shape}>{inner}</{shape.split()[0]}></div></body>' if shape in ("article", "main") else f"<body><nav>m</nav><{shape}>{inner}</{shape.split()[0]}><section id='comments'><p>{text('c', 80)}</p></section></body>"
        assert H.extract(page) == want, shape


# -- media ------------------------------------------------------------------------------------------


def forged() -> dict[str, bytes]:
    e, v = media.element, media.vint
    cluster = lambda body: e(media.SEGMENT, e(media.CLUSTER, body))
    block = lambda track: e(media.SIMPLE_BLOCK, track + b"\x00\x00\x80abcd")
    deep = b""
    for _ in range(3000):
        deep = media.SEGMENT.to_bytes(4, "big") + v(len(deep), 8) + deep
    rate = lambda x: e(media.SEGMENT, e(media.TRACKS, e(media.TRACK, e(media.NUMBER, b"\x01") + e(media.CODEC, b"A_PCM/INT/LIT") + e(media.AUDIO, e(media.RATE, x)))) + e(media.CLUSTER, block(v(1))))
    return {
        "deep": deep,
        "track": cluster(block(v(1 << 50, 8))),
        "time": cluster(e(media.TIMESTAMP, b"\x7f" * 20) + block(v(1))),
        "scale": e(media.SEGMENT, e(media.INFO, e(media.SCALE, b"\x7f" * 30)) + e(media.CLUSTER, e(media.TIMESTAMP, b"\x05") + block(v(1)))),
        "cue": e(media.SEGMENT, e(media.CUES, e(media.CUE_POINT, e(media.CUE_TIME, b"\x7f" * 20) + e(media.CUE_PLACE, e(media.CUE_TRACK, b"\x01"))))),
        "tiny rate": rate(b"\x00" * 7 + b"\x01"),
        "no number": rate(b"\x7f\xf8" + b"\x00" * 6),
    }


def test_forged_files_end_in_an_error_and_keep_the_packets_so_far(spark):
    good = media.element(media.SIMPLE_BLOCK, media.vint(1) + b"\x00\x00\x80first")
    rows = list(forged().items())
    rows.append(("after", media.element(media.SEGMENT, media.element(media.CLUSTER, good + media.element(media.SIMPLE_BLOCK, media.vint(1 << 50, 8) + b"\x00\x00\x80x")))))
    got = {r["id"]: r for r in media.packet_table(spark.createDataFrame(rows, "id string, blob binary"), "blob", "id").collect()}
    assert len(got) == len(rows)
    for name in ("deep", "track", "time", "scale", "cue", "after"):
        assert got[name]["error"], name
    for name in ("tiny rate", "no number"):  # such a rate gives no time of its own
        assert got[name]["error"] is None and [p["timestamp_ns"] for p in got[name]["packets"]] == [0]
    assert [p["size"] for p in got["after"]["packets"]] == [5]


def test_features_equal_those_of_plain_python():
    r = random.Random(3)
    for n in (1, 7, 1600):
        payload, _ = media.payload_of("".join(r.choice("ab é\n") for _ in range(n)))
        m = media.read(media.write_pcm(payload))
        got = dict(x.split("=") for x in media.features(payload, m).split(";"))
        mean = sum(b - 128 for b in payload) / len(payload)
        share = [payload.count(bytes([b])) / len(payload) for b in set(payload)]
        assert got["packets"] == str(len(payload) // 192) and got["ms"] == str(len(payload) // 8)
        assert float(got["mean"]) == pytest.approx(mean, abs=1e-4)
        assert float(got["rms"]) == pytest.approx(math.sqrt(sum((b - 128) ** 2 for b in payload) / len(payload)), abs=1e-4)
        assert int(got["crossings"]) == sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:], strict=False))
        assert float(got["entropy"]) == pytest.approx(-sum(p * math.log2(p) for p in share), abs=1e-4)


# -- personal data ----------------------------------------------------------------------------------


def test_a_long_run_of_zeros_is_an_address():
    assert pii.base_spans("0" * 5000 + ".1.2.3") == [(0, 1, 5006)]
    assert pii.base_spans("9" * 5000 + ".1.2.3 0256.1.1.1 00255.0.0.000") == [(5018, 1, 5031)]


@pytest.fixture(scope="module")
def tagger(spark, data):
    docs = table(spark, data.replace("sf0.001", "sf0.01"), "documents").where("doc_id % 2 = 0")
    return pii.train(docs, windows=4000)


def test_parts_decode_as_a_whole(tagger):
    rng = np.random.default_rng(1)
    e = rng.normal(0, 2, (300, 4, pii.TAGS)).astype(np.float32)
    whole = pii.viterbi(tagger, e)
    assert (pii.decode(tagger, [e[:7], e[7:200], e[200:]]) == whole).all()
    best = lambda tags, b: tagger.start[tags[0]] + sum(e[k, b, t] for k, t in enumerate(tags)) + sum(tagger.trans[a, c] for a, c in zip(tags, tags[1:], strict=False))
    for b in range(4):
        for _ in range(40):
            other = whole[b].copy()
            other[rng.integers(300)] = rng.integers(pii.TAGS)
            assert best(other, b) <= best(whole[b], b) + 1e-3


def test_tags_do_not_depend_on_the_batch(tagger):
    r = random.Random(2)
    texts = ["x" * r.randint(0, 300) + "reach 4884838406913480 or +49 (030) 555-1234 " * r.randint(0, 40) + "y " * r.randint(0, 200) for _ in range(12)] + ["", "7", "no digits at all"]
    one = pii.tag_texts(tagger, texts)
    for batch in (1, 7, 64):
        for a, b in zip(one, pii.tag_texts(tagger, texts, batch), strict=True):
            assert (a == b).all()


def test_the_tagger_alone_finds_what_the_rules_find_in_documents_it_has_not_seen(spark, data, tagger):
    """Documents of the driver, not of the training generator."""
    texts = [r["text"] for r in table(spark, data.replace("sf0.001", "sf0.01"), "documents").where("doc_id % 2 = 1 and text is not null").collect()]
    secret = re.compile(r'token = "([0-9a-f]{32,})"')
    gold = hit = said = right = 0
    for text, tags in zip(texts, pii.tag_texts(tagger, texts), strict=True):
        want = pii.base_spans(text) + [(m.start(1), 4, m.end(1)) for m in secret.finditer(text)]
        got = list(pii.tag_spans(text, tags))
        touch = lambda x, some: any(a < x[2] and x[0] < b for a, _, b in some)
        gold, hit = gold + len(want), hit + sum(touch(x, got) for x in want)
        said, right = said + len(got), right + sum(touch(x, want) for x in got)
    assert gold > 20 and hit / gold > 0.9 and right / said > 0.9


def test_secrets_are_spans_and_only_true_cards_flag_a_text(tagger):
    text = 'of the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and 4884838406913481 to 4884838406913480 then'
    ((base, whole),) = pii.find(tagger, [text])
    assert [(pii.FOUND[k], text[s:e]) for s, k, e in whole if k != 2] == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    assert not [k for _, k, _ in base if k > 3] and pii.flagged(text, whole)
    ((_, whole),) = pii.find(tagger, ["of the 4884838406913480 and then of"])
    assert len(whole) == 1 and not pii.flagged("of the 4884838406913480 and then of", whole)


# -- mixing, quality, languages ---------------------------------------------------------------------


def test_rows_of_one_id_go_by_their_own_source(spark):
    r = random.Random(4)
    rows = [(i % 60, " ".join(["w"] * r.randint(1, 30)), s) for i in range(300) for s in ("a", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {(x["doc_id"], x["source"], x["version"]): x["copies"] for x in mixing._planned(docs).collect()}
    got = sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    want = sorted(((i, t, s) for i, t, s, v in docs.withColumn("v", F.xxhash64("text")).collect() for _ in range(plan[i, s, v])), key=repr)
    assert got == want
    alone = spark.createDataFrame([(None, f"text of its own {k}", "s") for k in range(200)] + [(k, "a b c d e", "t") for k in range(200)], "doc_id long, text string, source string")
    assert len({x["taken"] > 0 for x in mixing.taken(alone).where("doc_id is null").collect()} | {x["copies"] for x in mixing.taken(alone).where("doc_id is null").collect()}) > 1


def test_training_does_not_depend_on_the_order_of_rows(spark):
    r = random.Random(6)
    rows = [(i % 40, " ".join(r.choice(("good", "fine", "text", "words", "bad")) for _ in range(60))) for i in range(120)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    one, two = quality.fit(docs, labels), quality.fit(docs.repartition(7, F.rand(3)), labels.repartition(3))
    assert (one.weights == two.weights).all() and (one.slope, one.offset) == (two.slope, two.offset)


def test_character_n_grams_run_over_characters():
    for word, n in (("e", 4), ("é", 4), ("日本語", 10), ("😀a", 7)):
        rows, feats = quality.word_features([word.encode()])
        assert len(feats) == n and (rows == 0).all()
    rows, feats = quality.word_features(["é".encode(), b"ab", "日".encode()])
    assert sorted(rows.tolist()) == [0] * 4 + [1] * 7 + [2] * 4


def test_scores_equal_a_slow_sum():
    r = random.Random(8)
    texts = [" ".join(r.choice(("alpha", "bêta", "日本", "x", "###")) for _ in range(70)) for _ in range(40)]
    model = quality.train(texts, [i % 2 for i in range(40)])
    scorer = quality.Scorer(model)
    _, failed, p, kept = quality.verdicts(scorer, texts, 0.3)
    mix = lambda x: int(quality._mix(np.array([x % 2**64], np.uint64))[0])
    for text, got, bad in zip(texts, p, failed, strict=True):
        words, total = text.split(), 0.0
        code = [int(quality.word_hashes([w.encode()])[0]) for w in words]
        for w, h in zip(words, code, strict=True):
            feats, chars = [mix(h + 1)], [2, *map(ord, w), 3]
            for n in (2, 3, 4):
                for i in range(len(chars) - n + 1):
                    x = chars[i]
                    for c in chars[i + 1 : i + n]:
                        x = (x * 0x100000001B3 + c) % 2**64
                    feats.append(mix(x * 8 + n))
            total += sum(float(model.weights[f]) for f in feats)
        total += sum(float(model.weights[mix((a * 31 % 2**64) ^ b)]) for a, b in zip(code, code[1:], strict=False))
        want = float(model.probability(np.array([total / len(words)]))[0])
        assert bad or got == pytest.approx(want, rel=1e-4)


def test_fused_evidence_equals_plain_python(spark):
    r = random.Random(5)
    langs = ["de", "en", "fr"]
    hosts = ["a.x.de", "b.x.de", "c.org", None, "lone"]
    rows = [(i, r.choice(hosts), r.choice(("de", "en", None)), [r.choice((-3.0, -1.5, 0.0)) for _ in langs]) for i in range(80)]
    got = {x["page_id"]: x for x in language_id.fuse(spark.createDataFrame(rows, "page_id long, host string, declared string, loglik array<double>"), langs).collect()}
    best = lambda s: s.index(max(s)) if max(s) > min(s) else None
    suffix = lambda h: h.split(".")[-1] if h and "." in h else None
    domain = lambda h: ".".join(h.split(".")[-2:]) if h and "." in h else h
    count = lambda key: [sum(1 for x in rows if key(x) and best(x[3]) == k) for k in range(3)]
    whole = count(lambda x: True)
    for i, host, said, score in rows:
        base = [(c + 1) / (sum(whole) + 3) for c in whole]

        def smoothed(value, of, prior):
            n = count(lambda x: of(x) == value) if value is not None else None
            return prior if n is None else [(c + 8 * p) / (sum(n) + 8) for c, p in zip(n, prior, strict=True)]

        def given(value, of):
            return [1.0] * 3 if value is None else [(c + 0.5) / (t + 1) for c, t in zip(count(lambda x: of(x) == value), whole, strict=True)]

        prior = smoothed(host, lambda x: x[1], smoothed(domain(host), lambda x: domain(x[1]), base))
        logs = [s + math.log(p) + math.log(a) + math.log(b) for s, p, a, b in zip(score, prior, given(said, lambda x: x[2]), given(suffix(host), lambda x: suffix(x[1])), strict=True)]
        top = max(logs)
        assert got[i]["lang"] == langs[logs.index(top)] and got[i]["probability"] == pytest.approx(1 / sum(math.exp(x - top) for x in logs), abs=2e-6)


def test_declared_languages():
    for page, want in (('<html lang="de-AT"><p>x', "de"), ("<HTML xml:lang='fr'>", "fr"), ('<meta http-equiv="Content-Language" content="es">', "es"), ("<html lang=x><p>", None), ("<p>lang=de", None), ('<meta name="a" content="de">', None)):
        assert language_id.declared(H.Page(page)) == want


def test_samples_are_the_same_for_each_group(spark):
    df = spark.createDataFrame([(i % 50, "ab"[i % 2] if i % 7 else None, f"t{i}") for i in range(300)], "doc_id long, g string, text string")
    got = common.sample_each(df, "g", 4, "text")
    assert {x[0] for x in got} - {None} == {"a", "b"}
    for g in "ab":
        own = [x[1:] for x in got if x[0] == g]
        assert own == common.sample(df.where(F.col("g") == g), 4, "text") and len(own) == 4


# -- clashing columns -------------------------------------------------------------------------------


def test_clashing_columns_change_nothing(spark, data, tagger):
    pages = table(spark, data, "pages").limit(20)
    clash = pages.withColumns({"text": F.lit("x"), "n_chars": F.lit("y"), "host": F.lit("h"), "declared": F.lit("d"), "lang": F.lit("l"), "loglik": F.lit(1), "best": F.lit(2)})
    docs = table(spark, data, "documents").limit(30)
    odd = docs.withColumns({"n_bytes": F.lit("x"), "feature": F.lit(1), "spans": F.lit(2), "n_email": F.lit("z"), "host": F.lit("h"), "declared": F.lit(0), "flagged": F.lit(3)})
    rows = lambda df: sorted(map(repr, df.collect()))
    model = language_id.train(docs)
    assert rows(H.main_text(clash)) == rows(H.main_text(pages))
    assert rows(language_id.identify_pages(clash, model)) == rows(language_id.identify_pages(pages, model))
    assert rows(language_id.identify_documents(odd, model)) == rows(language_id.identify_documents(docs, model))
    assert rows(media.store_texts(odd)) == rows(media.store_texts(docs))
    assert rows(pii.scan(odd, tagger)) == rows(pii.scan(docs, tagger))
