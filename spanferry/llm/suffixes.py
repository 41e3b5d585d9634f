"""Passages that repeat anywhere in a corpus, found with suffix arrays built by two-stage sorting.

A repeat is a string of ``least`` bytes that starts at more than one place. Every such window of a text is named by the
smallest hash among its ``GRAM``-byte grams, so equal windows have equal names wherever they stand, and consecutive
windows named by one gram form a segment. Segments whose name occurs once hold no repeat and stay where they are. The others
meet by name: equal segments are counted as one, and each block of different segments gets a suffix array. Two-stage sorting orders
only the suffixes smaller than their successors, places the rest by scanning the buckets of first bytes, and compares
adjacent suffixes; windows with a common prefix of ``least`` bytes are repeats.

A name with more segments than a block holds is dealt to several blocks. Each block still settles what repeats inside it; its
distinct windows then meet those of the other blocks by their digest, so nothing depends on the size of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanferry.llm.words import mixed
from spanferry.operators.joins import lookup
from spanferry.shared import scratch_path, settle

LEAST_BYTES = 400
GRAM = 32  # bytes of a gram; a window is named by the smallest of its grams
SLICE_BYTES = 1 << 20  # bytes of text hashed, or sorted, at once
BLOCK_SEGMENTS = 4_096  # segments of one name sorted in one block

_POSITION_BITS = np.uint64(22)  # a slice is below 2**22 bytes
_BASE = np.uint64(0xB5297A4D3F84D5B5)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- two-stage suffix sorting of one block -------------------------------------------------------------------------


def _smaller_than_next(data: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the one after it; the last one is not."""
    n = len(data)
    differs = np.full(n, n, np.int64)
    at = np.flatnonzero(data[:-1] != data[1:])
    differs[at] = at
    differs = np.minimum.accumulate(differs[::-1])[::-1]  # the next place where a byte differs from its successor
    out = np.zeros(n, bool)
    known = differs < n
    out[known] = data[differs[known]] < data[differs[known] + 1]
    return out


def _split(rank: np.ndarray, active: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Split groups of equal ``rank`` by ``keys`` in place; returns the members of ``active`` that still share a rank.

    A rank is the number of suffixes before its group, so splitting one group leaves the others alone.
    """
    order = np.lexsort((keys, rank[active])) if keys.dtype != np.uint64 or rank[active].any() else np.argsort(keys)
    return _ranked(rank, active[order], keys[order])


def _ranked(rank: np.ndarray, active: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(active):
        return active
    old = rank[active]
    place = np.arange(len(active))
    first = np.ones(len(active), bool)
    first[1:] = old[1:] != old[:-1]
    group = np.maximum.accumulate(np.where(first, place, 0))
    first[1:] |= keys[1:] != keys[:-1]
    part = np.maximum.accumulate(np.where(first, place, 0))
    rank[active] = old + part - group
    alone = first.copy()
    alone[:-1] &= first[1:]
    return active[~alone]


def _sorted_smaller(data: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """The suffixes at ``starts`` (all that are smaller than their successors) in order of their first ``limit`` bytes.

    The text between two of them is one phrase: it falls until the next one begins. Phrases are ranked by their bytes,
    suffixes by rank pairs of doubling reach.
    """
    n, m = len(data), len(starts)
    if not m:
        return starts
    bounds = np.append(starts, n)
    lengths = np.minimum(np.diff(bounds) + 1, n - starts)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    beyond = np.array([sum(0xFF << (56 - 8 * j) for j in range(k, 7)) for k in range(8)], np.uint64)
    rank, active, done = np.zeros(m, np.int64), np.arange(m), 0
    while len(active) and done < limit:
        at, left = starts[active] + done, np.minimum(lengths[active] - done, 8)
        keys = (255 - left).astype(np.uint64)  # of two phrases equal so far, the one that still falls is smaller
        ended = (active == m - 1) & (left < 8)  # nothing follows the last phrase, so it is smaller than any like it
        keys[ended] = 0
        for j in range(7):
            keys |= np.where(j < left, padded[np.minimum(at + j, n)], 0).astype(np.uint64) << np.uint64(56 - 8 * j)
        keys |= np.where(ended, np.uint64(0), beyond[np.minimum(left, 7)])
        active, done = _split(rank, active, keys), done + 7
        active = active[lengths[active] > done]
    order = np.argsort(rank, kind="stable")
    tied = rank[order][1:] == rank[order][:-1]
    active = order[np.append(tied, False) | np.append(False, tied)]
    reach = 1
    while True:
        # The last phrase is like no other, so whatever reaches it is alone in its group by then.
        active = active[bounds[active + reach] - starts[active] < limit]
        if not len(active):
            break
        after = rank[active + reach] + 1
        keys = rank[active].astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
        order = np.argsort(keys)
        active = _ranked(rank, active[order], keys[order])
        reach *= 2
    return starts[np.argsort(rank, kind="stable")]


def two_stage_order(data: np.ndarray, limit: int) -> np.ndarray:
    """All suffixes of ``data`` (bytes) in order of their first ``limit`` bytes.

    First stage: suffixes smaller than their successors are sorted directly. Second stage: the buckets of first bytes are
    scanned in order, and each suffix found puts its larger predecessor next in that one's bucket.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    direct = _sorted_smaller(data, np.flatnonzero(_smaller_than_next(data)), limit)
    cuts = np.searchsorted(data[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[data[n - 1]].append(np.array([n - 1]))
    done = []
    for byte in np.unique(data).tolist():
        falling = [np.concatenate(induced[byte])] if induced[byte] else []
        while falling and len(falling[-1]):  # a run of this byte: each suffix induces the one before it in the same bucket
            before = falling[-1] - 1
            falling.append(before[(before >= 0) & (data[before] == byte)])
        bucket = np.concatenate([*falling, direct[cuts[byte] : cuts[byte + 1]]])
        before = bucket[bucket > 0] - 1
        before = before[data[before] > byte]
        firsts = data[before]
        order = np.argsort(firsts, kind="stable")
        before, firsts = before[order], firsts[order]
        for piece in np.split(before, np.flatnonzero(firsts[1:] != firsts[:-1]) + 1) if len(before) else []:
            induced[data[piece[0]]].append(piece)
        done.append(bucket)
    return np.concatenate(done)


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` with the one after it, at most ``limit``."""
    n = len(data)
    wide = np.concatenate([data, np.zeros(16 + limit, np.uint8)]).astype(np.uint64)
    wide = wide[:-1] | wide[1:] << np.uint64(8)
    wide = wide[:-2] | wide[2:] << np.uint64(16)
    wide = wide[:-4] | wide[4:] << np.uint64(32)
    a, b = order[:-1], order[1:]
    most = np.minimum(limit, n - np.maximum(a, b))
    out, active, done = most.copy(), np.arange(len(a)), 0
    while len(active):
        apart = wide[a[active] + done] ^ wide[b[active] + done]
        found = apart != 0
        lowest = apart[found] & (~apart[found] + np.uint64(1))
        same = np.log2(lowest.astype(np.float64)).astype(np.int64) // 8
        out[active[found]] = np.minimum(done + same, most[active[found]])
        done += 8
        active = active[~found]
        active = active[most[active] > done]
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true values."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def sort_block(pieces: list[bytes], often: list[bool], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which places of ``pieces``, each followed by a zero byte, start a string of ``least`` bytes that repeats, and which
    stand for all places with the same string.

    ``often`` tells the pieces that occur more than once themselves.
    """
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    sizes = np.array([len(p) for p in pieces])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    starts = np.arange(len(data)) - begins[owner] <= (sizes - least)[owner]
    order = two_stage_order(data, least)
    order = order[starts[order]]
    repeats, chosen = np.zeros((2, len(data)), bool)
    if not len(order):
        return repeats, chosen
    same = common_prefixes(data, order, least) >= least
    group = np.concatenate([[0], np.cumsum(~same)])
    held = np.bincount(group)
    held += np.bincount(group, weights=np.array(often)[owner[order]].astype(float)).astype(np.int64)
    repeats[order] = held[group] > 1
    chosen[order[np.append(True, ~same)]] = True
    return repeats, chosen


# --- segments -------------------------------------------------------------------------------------------------------


def _segments(data: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Start, number of windows and name of each segment of one text (or part of one)."""
    n = len(data)
    steps = np.full(n + 1, _BASE)
    back = np.full(n + 1, np.uint64(pow(int(_BASE), -1, 2**64)))
    steps[0] = back[0] = 1
    steps, back = np.cumprod(steps), np.cumprod(back)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * steps[:n], out=sums[1:])
    hashes = mixed((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    width = least - gram + 1
    places = np.arange(len(hashes), dtype=np.uint64)
    keys = hashes >> _POSITION_BITS << _POSITION_BITS | places
    blocks = np.concatenate([keys, np.full(-len(keys) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - least + 1
    named = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & np.uint64((1 << int(_POSITION_BITS)) - 1)
    starts = np.concatenate([[0], np.flatnonzero(named[1:] != named[:-1]) + 1])
    return starts, np.diff(np.append(starts, windows)), hashes[named[starts].astype(np.int64)].view(np.int64)


def _raw(array: pa.Array) -> Iterator[memoryview]:
    array = array.cast(pa.large_binary())
    data, offsets = memoryview(array.buffers()[2] or b""), np.frombuffer(array.buffers()[1], np.int64)[array.offset :]
    for i in range(len(array)):
        yield data[offsets[i] : offsets[i + 1]]


_SEGMENT = "text_key binary, name long, digest_a long, digest_b long, at long, windows long"


def segments(texts: DataFrame, least: int) -> DataFrame:
    """Segments of every text of at least ``least`` bytes; ``texts`` holds ``text_key`` and ``text``."""
    gram = max(1, min(GRAM, least // 2))
    step = SLICE_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for key, text in zip(batch.column(0), _raw(batch.column(1))):
                for a in range(0, len(text) - least + 1, step):
                    part = text[a : a + step + least - 1]
                    starts, counts, names = _segments(np.frombuffer(part, np.uint8), least, gram)
                    digests = b"".join(
                        [blake2b(part[s : s + c + least - 1], digest_size=16).digest() for s, c in zip(starts.tolist(), counts.tolist())]
                    )
                    pairs = np.frombuffer(digests, np.int64)
                    rows[0].append(pa.repeat(key, len(starts)))
                    for into, values in zip(rows[1:], (names, pairs[::2], pairs[1::2], starts + a, counts)):
                        into.append(values)
                if sum(map(len, rows[1])) > 50_000:
                    yield _batch(rows)
                    rows = [[], [], [], [], [], []]
            if rows[0]:
                yield _batch(rows)

    def _batch(rows: list[list]) -> pa.RecordBatch:
        names = [c.split()[0] for c in _SEGMENT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(rows[0]), *(pa.array(np.concatenate(r)) for r in rows[1:])], names)

    return texts.select("text_key", "text").mapInArrow(cut, _SEGMENT)


_PIECE = "name long, block long, split boolean, digest_a long, digest_b long, often boolean, piece binary"


def _pieces(with_spans: DataFrame, least: int) -> DataFrame:
    """The bytes of each segment listed in ``spans`` next to its text."""
    columns = [c.split()[0] for c in _PIECE.split(", ")]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            held = 0
            for text, spans in zip(_raw(batch.column(0)), batch.column(1)):
                for span in spans.as_py():
                    at, windows = span.pop("at"), span.pop("windows")
                    span["piece"] = bytes(text[at : at + windows + least - 1])
                    rows.append(span)
                    held += len(span["piece"])
                    if held > SLICE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(c, kinds[t]) for c, t in (f.split() for f in _PIECE.split(", "))])
    return with_spans.select("text", "spans").mapInArrow(take, _PIECE).select(*columns)


_FOUND = (
    "name long, digest_a long, digest_b long, ranges array<struct<a:long,b:long>>, once array<struct<at:long,window:binary>>"
)


def _sorted_blocks(pieces: DataFrame, least: int) -> DataFrame:
    """Per segment the ranges of windows that repeat in its block and, for a split name, a digest of each distinct window.

    A task reads its blocks in order and sorts as many whole ones at a time as fill a slice.
    """
    kinds = {"long": pa.int64()}
    range_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    once_type = pa.list_(pa.struct([("at", pa.int64()), ("window", pa.binary())]))
    schema = pa.schema([*((c, kinds["long"]) for c in ("name", "digest_a", "digest_b")), ("ranges", range_type), ("once", once_type)])

    def found(rows: list[tuple]) -> pa.RecordBatch:
        repeats, chosen = sort_block([r[5] for r in rows], [r[4] for r in rows], least)
        out, base = [], 0
        for name, split, a, b, often, piece in rows:
            flags, shown = (x[base : base + len(piece) - least + 1] for x in (repeats, chosen))
            base += len(piece) + 1
            once = []
            if split:
                once = [{"at": i, "window": blake2b(piece[i : i + least], digest_size=16).digest()} for i in np.flatnonzero(shown).tolist()]
            spans = [{"a": s, "b": e} for s, e in zip(*(x.tolist() for x in _runs(flags)))]
            if spans or once:
                out.append({"name": name, "digest_a": a, "digest_b": b, "ranges": spans, "once": once})
        return pa.RecordBatch.from_pylist(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            for name, block, split, a, b, often, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if held > SLICE_BYTES and (name, block) != last:
                    yield found(rows)
                    rows, held = [], 0
                rows.append((name, split, a, b, often, piece))
                held, last = held + len(piece) + 1, (name, block)
        if rows:
            yield found(rows)

    dealt = pieces.repartition("name", "block").sortWithinPartitions("name", "block")
    return dealt.mapInArrow(run, _FOUND)


def _text_key(text: str) -> Column:
    return F.unhex(F.md5(F.col(text))).alias("text_key")


_SEGMENT_KEY = ["name", "digest_a", "digest_b"]


def repeated_spans(docs: DataFrame, text: str = "text", least: int = LEAST_BYTES, block: int = BLOCK_SEGMENTS) -> DataFrame:
    """``(text_key, spans)`` for each distinct text with a repeat: the maximal runs of bytes covered by repeats.

    ``text_key`` is the MD5 digest of the text. Spans are in order, ``start`` included, ``end`` not.
    """
    spark = docs.sparkSession
    long = docs.where(F.octet_length(text) >= least).select(
        _text_key(text), F.col(text).alias("text"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.lit(0)).alias("row_key")
    )
    path = scratch_path(spark, "segments")
    segments(long, least).write.parquet(path)
    every = spark.read.parquet(path)
    names = settle(every.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"))
    places = settle(
        lookup(every, names, ["name"], "left_semi", small=False)
        .groupBy(*_SEGMENT_KEY, "text_key", "at", "windows").agg(F.count(F.lit(1)).alias("n"))
    )
    distinct = settle(places.groupBy(*_SEGMENT_KEY).agg(F.sum("n").alias("n"), F.min(F.struct("text_key", "at", "windows")).alias("place")))
    members = settle(distinct.groupBy("name").agg(F.count(F.lit(1)).alias("members")))
    crowded = members.where(F.col("members") > block)
    named = lookup(distinct, members, ["name"], small=False)
    # All copies of one segment repeat; there is nothing else to compare them with.
    alone = named.where("members = 1").select(*_SEGMENT_KEY, F.struct(F.lit(0).cast("long").alias("a"), (F.col("place.windows") - 1).alias("b")).alias("r"))
    dealt = named.where("members > 1").select(
        "place.text_key",
        F.struct(
            "name", F.pmod(F.xxhash64("digest_a", "digest_b"), F.ceil(F.col("members") / F.lit(block))).alias("block"),
            (F.col("members") > block).alias("split"), "digest_a", "digest_b", (F.col("n") > 1).alias("often"), "place.at", "place.windows",
        ).alias("span"),
    )
    # One row of each text serves its segments; of equal texts, that with the smallest row key.
    one = long.groupBy("text_key").agg(F.min("row_key").alias("row_key"))
    wanted = settle(dealt.groupBy("text_key").agg(F.collect_list("span").alias("spans")).join(one, "text_key"))
    found = _sorted_blocks(_pieces(lookup(long, wanted, ["text_key", "row_key"], "inner", small=False), least), least)
    found = found.groupBy(*_SEGMENT_KEY).agg(F.max("ranges").alias("ranges"), F.max("once").alias("once"))  # rows equal in all columns
    if crowded.isEmpty():
        ranges = found.select(*_SEGMENT_KEY, F.explode("ranges").alias("r"))
    else:
        found = settle(found)
        once = found.select(*_SEGMENT_KEY, F.explode("once").alias("o")).select(*_SEGMENT_KEY, "o.at", "o.window")
        again = once.groupBy("name", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        met = once.join(again, ["name", "window"]).select(*_SEGMENT_KEY, F.struct(F.col("at").alias("a"), F.col("at").alias("b")).alias("r"))
        ranges = found.select(*_SEGMENT_KEY, F.explode("ranges").alias("r")).unionByName(met)
    ranges = settle(ranges.unionByName(alone).groupBy(*_SEGMENT_KEY).agg(F.collect_list("r").alias("ranges")))
    hit = lookup(places.select(*_SEGMENT_KEY, "text_key", "at"), ranges, _SEGMENT_KEY, "inner", small=False)
    hit = hit.select("text_key", F.transform("ranges", lambda r: F.struct((F.col("at") + r["a"]).alias("a"), (F.col("at") + r["b"]).alias("b"))).alias("r"))
    return _covered(hit.groupBy("text_key").agg(F.flatten(F.collect_list("r")).alias("r")), least)


_SPANS = "array<struct<start:long,end:long>>"


def _covered(windows: DataFrame, least: int) -> DataFrame:
    """Ranges of windows of one text, joined to the runs of bytes they cover."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ranges in batch.column(1).to_pylist():
                spans: list[dict] = []
                for first, last in sorted((r["a"], r["b"]) for r in ranges):
                    if spans and first <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], last + least)
                    else:
                        spans.append({"start": first, "end": last + least})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["text_key", "spans"])

    return windows.select("text_key", "r").mapInArrow(cover, f"text_key binary, spans {_SPANS}")


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_BYTES, block: int = BLOCK_SEGMENTS
) -> DataFrame:
    """Every row of ``docs`` as ``(doc_id, n_bytes, removed, kept)``: the spans of bytes that repeat and what is left.

    A byte goes when a string of ``least`` bytes over it starts anywhere else, in the same text too; overlaps count, and
    all strings are judged on the input. ``kept`` is binary, as a span can begin or end inside a character.

    A null text counts as empty and keeps nothing; ids may be null or repeat, each row is a document of its own (equal
    rows repeat each other). Texts are read whole, in slices, at any length. Other columns are ignored whatever their
    names. An empty table gives an empty one.
    """
    docs = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    spans = settle(repeated_spans(docs, "_text", least, block))
    kind = docs.schema["_id"].dataType.simpleString()
    removed = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, cuts = (batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_text", "spans"))
            kept, sizes = [], []
            for raw, spans in zip(_raw(texts), cuts.to_pylist()):
                at, left = 0, []
                for span in spans or ():
                    left.append(raw[at : span["start"]])
                    at = span["end"]
                kept.append(b"".join([*left, raw[at:]]))
                sizes.append(len(raw))
            listed = pa.array([s or [] for s in cuts.to_pylist()], removed)
            columns = [ids, pa.array(sizes, pa.int64()), listed, pa.array(kept, pa.large_binary()).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [doc_id, "n_bytes", "removed", "kept"])

    keyed = docs.withColumn("text_key", F.unhex(F.md5("_text")))
    joined = lookup(keyed, spans, ["text_key"], small=False).select("_id", "_text", "spans")
    return joined.mapInArrow(strip, f"`{doc_id}` {kind}, n_bytes long, removed {_SPANS}, kept binary")
