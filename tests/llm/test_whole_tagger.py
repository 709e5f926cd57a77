"""The bound on the tagger's words is a parameter."""

from __future__ import annotations

from readloom.llm import pii


def test_the_bound_on_training_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "labelled", lambda texts, windows: (seen.append([len(t) for t in texts]), windows))
    monkeypatch.setattr(pii, "fit", lambda *_: None)
    docs = spark.createDataFrame([(1, "word " * 2000)], "doc_id long, text string")
    pii.train(docs)
    pii.train(docs, chars=1 << 30)
    assert seen == [[pii.TRAIN_CHARS], [10_000]]
