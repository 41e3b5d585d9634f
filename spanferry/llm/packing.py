"""Best-fit packing by minimum bin slack.

Only lengths matter for the plan, and a length is at most the size of a bin, so the plan is made from a histogram of at
most ``capacity`` rows however many documents there are: a bin is opened for the longest piece left, a bitset
subset-sum finds the fullest combination of the other lengths, and the combination is taken out as often as counts
allow, which is what filling one bin after another would do. Spark then ranks the pieces of each length and reads the
place of every rank from the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from spanferry.llm.tokens import word_ids
from spanferry.operators.joins import lookup
from spanferry.shared import settle, small_batches

CAPACITY = 4096
RANKED_ROWS = 20_000  # pieces of one length ranked by one group


def fullest(counts: dict[int, int], space: int) -> dict[int, int]:
    """The multiset of lengths that fills ``space`` best; ``counts`` says how many of each there are.

    Long lengths are tried first, so that short ones stay for later bins.
    """
    reach, mask, taken = 1, (1 << (space + 1)) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= space), reverse=True):
        left, chunk = min(counts[length], space // length), 1
        while left and not reach >> space & 1:
            chunk = min(chunk, left)
            wider = reach | reach << chunk * length & mask
            if wider != reach:
                taken.append((reach, length, chunk))
            reach, left, chunk = wider, left - chunk, chunk * 2
        if reach >> space & 1:
            break
    at, found = reach.bit_length() - 1, {}
    for before, length, chunk in reversed(taken):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + chunk
            at -= chunk * length
    return found


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Combinations of lengths and how many bins hold each: ``(bins, {length: pieces in a bin})``."""
    counts = {x: n for x, n in sorted(histogram.items(), reverse=True) if n}
    if counts and (max(counts) > capacity or min(counts) < 1):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    plan = []
    while counts:
        longest = next(iter(counts))
        counts[longest] -= 1
        combination = fullest(counts, capacity - longest)
        counts[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        bins = min(counts[x] // n for x, n in combination.items())
        for x, n in combination.items():
            counts[x] -= n * bins
            if not counts[x]:
                del counts[x]
        plan.append((bins, combination))
    return plan


class Places:
    """Where the pieces of each length go, by their rank within the length."""

    def __init__(self, plan: list[tuple[int, dict[int, int]]]) -> None:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        first = 0
        for bins, combination in plan:
            offset = 0
            for length, n in sorted(combination.items(), reverse=True):
                rows.setdefault(length, []).append((used.get(length, 0), n, first, offset))
                used[length] = used.get(length, 0) + n * bins
                offset += n * length
            first += bins
        self.rows = {x: np.array(r, np.int64) for x, r in rows.items()}

    def of(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset for pieces of ``length`` with these ranks (from 0)."""
        rows = self.rows[length]
        start, n, first, offset = rows[np.searchsorted(rows[:, 0], ranks, side="right") - 1].T
        return first + (ranks - start) // n, offset + (ranks - start) % n * length


def token_pieces(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    closing: int = 1, keep_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` per piece of each document, and ``ids`` when ``keep_ids``.

    A document is its text's ids, then the id ``closing``; only a longer one than ``capacity`` is cut. Null counts as
    empty, so every row gives at least one piece; repeated rows each give theirs.
    """
    fields = [
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, start, length, crc, kept = [], [], [], [], [], []
            known = word_ids(path)
            for row, value in enumerate(batch.column(1)):
                ids = np.append(known.ids(value.as_py() or ""), np.uint32(closing)).astype("<u4")
                for number, begin in enumerate(range(0, len(ids), capacity)):
                    part = ids[begin : begin + capacity]
                    at.append(row)
                    piece.append(number)
                    start.append(begin)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(cut, T.StructType(fields))


def pack(pieces: DataFrame, order_by: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless sequences of at most ``capacity``, as few as found.

    ``pieces`` is read more than once, so pass settled rows. Pieces of one length are interchangeable; they are ranked
    by ``order_by`` in groups by a hash of those columns, so a length that most pieces have is ranked in many tasks.
    No rows give no rows.
    """
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most `capacity` rows
    places = Places(plan_bins(histogram, capacity))
    groups = max(8, -(-max(histogram.values(), default=0) // RANKED_ROWS))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order_by), F.lit(groups)))
    earlier = Window.partitionBy(length).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        salted.groupBy(length, "_salt").count()
        .withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    )
    own = Window.partitionBy(length, "_salt").orderBy(*order_by)
    local = salted.withColumn("_row", F.row_number().over(own))
    ranked = lookup(local, settle(offsets), [length, "_salt"], keys_of=salted).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    ranked = ranked.select(*pieces.columns, "_rank")
    at = ranked.columns.index(length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(at).to_numpy()
            ranks = batch.column(batch.num_columns - 1).to_numpy()
            order = np.argsort(lengths, kind="stable")
            bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(rows):
                    bins[rows], offsets[rows] = places.of(int(lengths[rows[0]]), ranks[rows])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bins), pa.array(offsets)], schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    closing: int = 1, keep_ids: bool = False,
) -> DataFrame:
    """:func:`token_pieces` with their places: ``sequence_id`` and ``offset``; with ``keep_ids`` also the tokens.

    Extra columns of ``docs`` are ignored. Pieces, not texts, are settled on shared storage.
    """
    with small_batches(docs.sparkSession):
        pieces = settle(token_pieces(docs, path, doc_id, text, capacity, closing, keep_ids))
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], "length", capacity)
