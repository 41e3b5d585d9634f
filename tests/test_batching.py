"""Packing against a plain greedy loop, however the stream is cut."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spanferry.operators import batching
from spanferry.operators.batching import _CapRule, _chain, _compose, _number, _ReachRule, _summarise


def greedy(sizes, max_items, max_bytes):
    out, batch, n, total = [], -1, 0, 0
    for size in sizes:
        if batch < 0 or n >= max_items or (max_bytes is not None and total + 1 + size > max_bytes):
            batch, n, total = batch + 1, 1, 14 + size
        else:
            n, total = n + 1, total + 1 + size
        out.append(batch)
    return out


def reach(pages, max_rows, max_bytes):
    out, batch, rows, total = [], 0, 0, 0
    for n, size in pages:
        if rows >= max_rows or total >= max_bytes:
            batch, rows, total = batch + 1, 0, 0
        rows, total = rows + n, total + size
        out.append(batch)
    return out


def tree_chain(rule, summaries, fold):
    """Entry states from summaries composed ``fold`` at a time; no group is larger."""
    levels = [summaries]
    while len(levels[-1]) > fold:
        grouped = levels[-1].assign(_group=levels[-1]["_seg"] // fold)
        assert grouped.groupby("_group").size().max() <= fold
        levels.append(pd.concat([_compose(["p"], rule, g) for _, g in grouped.groupby("_group")]))
    states = _chain(["p"], rule, levels.pop())
    for level in reversed(levels):
        handed = level.assign(_group=level["_seg"] // fold).merge(
            states.rename(columns={"_seg": "_group"}), on=["p", "_group"], how="left"
        )
        states = pd.concat([_chain(["p"], rule, g) for _, g in handed.groupby("_group")])
    return states


def packed(rule, items, sizes, cuts, fold=None):
    """Run the segment passes the way Spark does, with the stream cut at ``cuts``."""
    bounds = [0, *sorted(set(c for c in cuts if 0 < c < len(items))), len(items)]
    segments = []
    for seg, (a, b) in enumerate(zip(bounds, bounds[1:])):
        segments.append(pd.DataFrame({"p": 0, "k": range(a, b), "_items": items[a:b], "_size": sizes[a:b], "_seg": seg}))
    summaries = pd.concat([s for seg in segments for s in _summarise(["p"], rule, iter([seg]))])
    entered = _chain(["p"], rule, summaries) if fold is None else tree_chain(rule, summaries, fold)
    out = []
    for seg in segments:
        tagged = seg.merge(entered, on=["p", "_seg"], how="left")
        out += list(_number(["p"], ["p", "k"], rule, iter([tagged])))
    return pd.concat(out)["batch_no"].tolist()


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.integers(0, 60), min_size=1, max_size=60),
    st.integers(1, 8),
    st.one_of(st.none(), st.integers(1, 120)),
    st.lists(st.integers(1, 59), max_size=12),
)
def test_caps_match_the_greedy_loop(sizes, max_items, max_bytes, cuts):
    got = packed(_CapRule(max_items, max_bytes), [1] * len(sizes), sizes, cuts)
    assert got == greedy(sizes, max_items, max_bytes)


@settings(max_examples=300, deadline=None)
@given(
    st.integers(1, 5),
    st.lists(st.integers(0, 60), min_size=1, max_size=40),
    st.integers(1, 5),
    st.integers(1, 20),
    st.integers(1, 150),
    st.lists(st.integers(1, 39), max_size=10),
)
def test_flushes_match_the_loop(page_size, sizes, last, max_rows, max_bytes, cuts):
    pages = [page_size] * (len(sizes) - 1) + [min(last, page_size)]
    rule = _ReachRule(max_rows, max_bytes, -(-max_rows // page_size) + 1)
    assert packed(rule, pages, sizes, cuts) == reach(list(zip(pages, sizes)), max_rows, max_bytes)


def test_one_hot_stream_is_packed_in_parallel(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 400, 20_000).tolist()
    rows = pd.DataFrame({"stream": ["hot"] * 15_000 + ["cold"] * 4_999 + [None], "pos": range(20_000), "size": sizes})
    df = spark.createDataFrame(rows).repartition(8)
    got = batching.batch_by_count_and_bytes(df, ["stream"], ["pos"], "size", 40, 5_000).toPandas().sort_values("pos")
    expected = greedy(sizes[:15_000], 40, 5_000) + greedy(sizes[15_000:19_999], 40, 5_000) + [0]
    assert got["batch_no"].tolist() == expected


def test_without_stream_key(spark):
    sizes = [(i * 37) % 200 for i in range(3_000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "pos long, size long").repartition(5)
    got = batching.batch_by_count_and_bytes(df, [], ["pos"], "size", 7, None).orderBy("pos").toPandas()
    assert got["batch_no"].tolist() == greedy(sizes, 7, None)


def test_flush_groups_close_after_the_page(spark):
    # Two rows on one page exceed the byte cap together and stay one flush.
    df = spark.createDataFrame([("s", "a", 30), ("s", "b", 30)], "s string, id string, size long")
    rows = batching.flush_groups(df, ["s"], ["id"], "size", page_size=1000, max_rows=5000, max_bytes=50).collect()
    assert [(r["page_rows"], r["page_bytes"], r["batch_no"]) for r in rows] == [(2, 60, 0)]


def test_oversize_row_is_its_own_batch(spark):
    df = spark.createDataFrame([(1, 10), (2, 500), (3, 10), (4, 10)], "id long, size long")
    rows = batching.batch_by_count_and_bytes(df, [], ["id"], "size", 10, 60).orderBy("id").collect()
    assert [r["batch_no"] for r in rows] == [0, 1, 2, 2]


@pytest.mark.parametrize("items, size", [(0, 10), (-1, 10), (5, 0), (5, -2)])
def test_caps_must_be_positive(spark, items, size):
    df = spark.createDataFrame([(1, 10)], "id long, size long")
    with pytest.raises(ValueError):
        batching.batch_by_count_and_bytes(df, [], ["id"], "size", items, size)


def test_payload_bytes(spark):
    df = spark.createDataFrame([("a", 10), ("a", 5), ("b", 7)], "k string, size long")
    got = {r["k"]: r["payload_bytes"] for r in batching.payload_bytes(df, "size", ["k"]).collect()}
    assert got == {"a": 14 + 1 + 15, "b": 14 + 7}
    assert batching.payload_bytes(df.where("false"), "size").first()["payload_bytes"] == 14


def test_flush_needs_positive_caps(spark):
    df = spark.createDataFrame([(1, 10)], "id long, size long")
    for bad in ({"page_size": 0}, {"max_rows": 0}, {"max_bytes": -1}):
        with pytest.raises(ValueError):
            batching.flush_groups(df.withColumn("s", F.lit("s")), ["s"], ["id"], "size", **bad)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 9), st.integers(0, 60)), min_size=1, max_size=60),
    st.integers(1, 30),
    st.one_of(st.none(), st.integers(1, 200)),
    st.lists(st.integers(1, 59), max_size=40),
    st.integers(2, 5),
)
def test_composed_summaries_match_the_loops(pages, most, max_bytes, cuts, fold):
    items, sizes = [n for n, _ in pages], [s for _, s in pages]
    assert packed(_CapRule(most, max_bytes), [1] * len(sizes), sizes, cuts, fold) == greedy(sizes, most, max_bytes)
    room = max_bytes or 10**9
    assert packed(_ReachRule(most, room, len(pages)), items, sizes, cuts, fold) == reach(pages, most, room)


def test_five_thousand_segments_of_one_stream():
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 400, 10_000).tolist()
    rule = _CapRule(50, 9_000)
    segments = [pd.DataFrame({"p": 0, "k": range(i, i + 2), "_items": 1, "_size": sizes[i : i + 2], "_seg": i // 2}) for i in range(0, 10_000, 2)]
    summaries = pd.concat([s for seg in segments for s in _summarise(["p"], rule, iter([seg]))])
    entered = tree_chain(rule, summaries, batching.FOLD_SEGMENTS)
    pd.testing.assert_frame_equal(entered.sort_values("_seg", ignore_index=True), _chain(["p"], rule, summaries).sort_values("_seg", ignore_index=True), check_dtype=False)


def test_streams_folded_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(batching, "FOLD_SEGMENTS", 3)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(2)
        rows = [(s, k, int(rng.integers(0, 300))) for s, n in (("a", 700), (None, 150), ("b", 3)) for k in range(n)]
        df = spark.createDataFrame(rows, "s string, k long, size long")
        got = batching.batch_by_count_and_bytes(df, ["s"], ["k"], "size", 7, 1_000).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for stream in ("a", None, "b"):
        mine = [r["batch_no"] for r in sorted((r for r in got if r["s"] == stream), key=lambda r: r["k"])]
        assert mine == greedy([z for s, _, z in rows if s == stream], 7, 1_000)
