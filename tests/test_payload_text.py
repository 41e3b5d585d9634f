"""Payloads are rewritten in place: all text outside the references stays as it was written."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from spanferry.functions.payload import attachment_refs, compact_chars, count_attachment_refs
from spanferry.operators.payload import rewrite_attachments
from tests.test_functions import reference

COPY = "source_key string, dest_key string, filename string, content_type string"


def rewritten(spark, *rows):
    copies = spark.createDataFrame([("k", "new", "k.txt", "text/plain")], COPY)
    df = spark.createDataFrame(list(rows), "id string, payload string")
    return rewrite_attachments(df, copies, "payload").collect()


def test_only_references_change(spark):
    old, new = json.dumps(reference("k")), '{"type":"stored_attachment","key":"new","filename":"k.txt","content_type":"text/plain"}'
    deep = 100_000
    texts = [
        '{ "n" : 1e400, "m":1.10,  "big": ' + "9" * 5000 + ', "f": %s }',
        '{"half":"\\ud800", "a":[%s,\t%s], "a":1}',
        '[' * deep + '%s' + ']' * deep,
        '{"\\ud800":%s}',
    ]
    before = [t.replace("%s", old) for t in texts]
    got = rewritten(spark, *[(str(i), t) for i, t in enumerate(before)])
    assert {r["id"]: r["payload"] for r in got} == {str(i): t.replace("%s", new) for i, t in enumerate(texts)}
    assert {r["id"]: (r["attachments_copied"], r["payload_unread"]) for r in got} == {"0": (1, 0), "1": (2, 0), "2": (1, 0), "3": (1, 0)}


def test_rows_without_an_id_and_repeated_rows(spark):
    text = json.dumps({"a": reference("k")})
    got = rewritten(spark, (None, text), ("", text), ("", text), ("x", None), ("y", ""))
    assert len(got) == 5 and sum(r["attachments_copied"] for r in got) == 3
    assert all('"new"' in r["payload"] for r in got if r["id"] in (None, ""))


def test_text_that_is_not_json_stays_and_is_told(spark):
    broken = ['{"type":"stored_attachment",', '[1,] "stored_attachment"', '{"stored_attachment"}', "stored_attachment", '"stored_attachment" 1', '[01,"stored_attachment"]']
    got = rewritten(spark, *[(str(i), t) for i, t in enumerate(broken)])
    assert {r["id"]: r["payload"] for r in got} == {str(i): t for i, t in enumerate(broken)}
    assert all(r["payload_unread"] == 1 and r["attachments_copied"] == 0 for r in got)


def test_a_key_that_is_no_text_is_no_reference(spark):
    text = json.dumps(reference("k")).replace('"key": "k"', '"key": "\\ud800"')
    row = spark.createDataFrame([(text,)], "t string").select(attachment_refs(F.col("t")).alias("r"), count_attachment_refs(F.col("t")).alias("n")).first()
    assert row["r"] == [] and row["n"] == 0


def test_compact_size_of_any_text(spark):
    long = '{"a": "' + "x y\\\" " * 3_500_000 + '"}'
    rows = [(0, long), (1, '{"a": 1, "a": [2, "b c"]}'), (2, "[1,]"), (3, None), (4, ""), (5, "[" * 50_000 + " ]" * 50_000)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", compact_chars(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {0: len(long) - 1, 1: 21, 2: None, 3: None, 4: None, 5: 100_000}
