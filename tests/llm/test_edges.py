"""Empty tables, clashing columns and stray elements that the other tests leave out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from readloom.llm import chat, media, quality, simhash

DOCS = "doc_id long, text string"


def test_media_of_no_rows_repeated_rows_and_further_columns(spark):
    none = spark.createDataFrame([], DOCS)
    assert media.store_texts(none).collect() == []
    assert media.packet_table(none.withColumn("m", F.lit(None).cast("binary")), "m", "doc_id").collect() == []
    docs = spark.createDataFrame([(1, "a text"), (1, "a text"), (2, None), (3, "x" * 300_000)], DOCS)
    plain = sorted(map(tuple, media.store_texts(docs).collect()))
    clash = docs.selectExpr("'z' AS feature", "doc_id", "text", "7 AS n_bytes", "'y' AS media_sha256")
    assert sorted(map(tuple, media.store_texts(clash).collect())) == plain
    assert plain[0] == plain[1] and len(plain) == 4


def test_a_reference_outside_of_a_group_changes_no_packet():
    e = media.element
    single, stray = e(media.SIMPLE_BLOCK, b"\x81\x00\x00\x80ab"), e(media.REFERENCE, b"\x01")
    group = lambda *more: e(media.BLOCK_GROUP, e(media.BLOCK, b"\x81\x00\x01\x00cd") + b"".join(more))
    keys = lambda *parts: [p[4] for p in media.read(e(media.SEGMENT, e(media.CLUSTER, e(media.TIMESTAMP, b"\x00") + b"".join(parts)))).packets]
    assert keys(single, stray) == [True]
    assert keys(single, group(), stray) == keys(single, group()) == [True, True]
    assert keys(single, group(stray), single, stray) == [True, False, True]


def test_clashing_columns_of_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hello <|im_end|>"), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    clash = rows.selectExpr("*", "1 AS ids", "2 AS loss", "3 AS n_turns", "'x' AS turns_sha256")
    assert [tuple(r) for r in chat.digests(chat.format_turns(clash)).collect()] == [tuple(r) for r in chat.digests(chat.format_turns(rows)).collect()]
    assert chat.digests(chat.format_turns(rows.limit(0))).collect() == []


def test_clashing_columns_of_documents(spark):
    rows = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five"), (3, "other words are here now")], DOCS)
    clash = rows.selectExpr("*", "'f' AS fingerprint", "9L AS component_id", "3L AS fp", "'u' AS u", "'v' AS v", "4 AS node")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(simhash.groups(clash)) == key(simhash.groups(rows))
    kept = simhash.dedup(clash)
    assert kept.columns == clash.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    judged = quality.judge(rows.selectExpr("*", "'a' AS n_words", "'b' AS kept", "'c' AS probability", "'d' AS extra"), None)
    assert {r["extra"] for r in judged.collect()} == {"d"} and judged.schema["n_words"].dataType.simpleString() == "bigint"
    assert sorted((r["doc_id"], r["n_words"], r["kept"]) for r in judged.collect()) == [(1, 5, False), (2, 5, False), (3, 5, False)]


@pytest.mark.parametrize("text", ["", None])
def test_media_of_nothing(spark, text):
    got = media.store_texts(spark.createDataFrame([(1, text)], DOCS)).first()
    assert (got["n_bytes"], got["payload_bytes"]) == (0, 192)
