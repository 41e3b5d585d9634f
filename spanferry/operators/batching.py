"""Batch planning by row count and payload bytes.

Greedy packing is sequential: where a batch starts depends on every batch before it. It is still
computed in parallel and exactly. The ordered stream is cut into segments, one per range partition; a segment
works out, for every row a batch could start at on entry, which batch is open when the segment ends.
Those small summaries are folded in segment order per stream, which yields the true state at the start
of each segment, and every segment then numbers its rows on its own. A stream of many segments is folded as a tree:
the summaries of neighbours are composed into one until few are left, and entry states are handed back down.

A batch never spans more than ``max_items`` rows, so a summary has at most ``max_items`` entries, and
only the first and last stream of a partition need one; no task ever sees a whole stream.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spanferry.operators.ordering import positions, segments
from spanferry.shared import settle

# Fixed values of the insert wire format: the bytes of an empty {"events": []} body, and one comma
# between two events. They must not change, or sizes no longer match the destination's limits.
EMPTY_BODY_BYTES = 14
COMMA_BYTES = 1

# Fixed default limits.
FLUSH_MAX_ROWS = 5_000
FLUSH_MAX_BYTES = 25 * 1024 * 1024
FETCH_PAGE_ROWS = 1_000

# Summaries of one stream that meet in one group.
FOLD_SEGMENTS = 64

_STATE_FIELDS = "_open_items long, _open_bytes long, _batches long"

_SUMMARY_FIELDS = (
    "_rows long, _head_items array<long>, _head_bytes array<long>, "
    "_exit_items array<long>, _exit_bytes array<long>, _exit_batches array<long>"
)


def payload_bytes(df: DataFrame, size_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Bytes of the insert body per group: wrapper, commas and row sizes; the bare wrapper when empty."""
    n = F.count(F.lit(1))
    commas = F.greatest(n - 1, F.lit(0)) * COMMA_BYTES
    total = F.lit(EMPTY_BODY_BYTES) + commas + F.coalesce(F.sum(F.col(size_col).cast("long")), F.lit(0))
    return df.groupBy(*keys).agg(n.alias("batch_rows"), total.cast("long").alias("payload_bytes"))


class _CapRule:
    """Close a batch before the row that would exceed a cap."""

    def __init__(self, max_items: int, max_bytes: int | None) -> None:
        self.max_items = max_items
        self.span = max_items
        # A batch of k rows weighs EMPTY_BODY + sum(size + comma) - comma.
        self.room = None if max_bytes is None else max_bytes - EMPTY_BODY_BYTES + COMMA_BYTES

    def weigh(self, items: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _prefix(items), _prefix(sizes + COMMA_BYTES)

    def absorbed(self, items: np.ndarray, weight: np.ndarray, open_items: int, open_bytes: int) -> int:
        """Rows of this segment that still fit the batch left open by the previous one."""
        taken = min(self.max_items - open_items, len(items) - 1)
        if self.room is not None:
            taken = min(taken, int(np.searchsorted(weight, self.room - open_bytes, side="right")) - 1)
        return max(taken, 0)

    def ends(self, items: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For a batch started at each row, the first row after it."""
        rows = len(items) - 1
        start = np.arange(rows)
        stop = np.minimum(start + self.max_items, rows)
        if self.room is not None:
            stop = np.minimum(stop, np.searchsorted(weight, weight[:-1] + self.room, side="right") - 1)
        return np.maximum(stop, start + 1)


class _ReachRule:
    """Close a batch after the page that reaches a cap."""

    def __init__(self, max_rows: int, max_bytes: int, span: int) -> None:
        self.max_rows = max_rows
        self.max_bytes = max_bytes
        self.span = span

    def weigh(self, items: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _prefix(items), _prefix(sizes)

    def absorbed(self, items: np.ndarray, weight: np.ndarray, open_items: int, open_bytes: int) -> int:
        by_rows = np.searchsorted(items, self.max_rows - open_items, side="left")
        by_bytes = np.searchsorted(weight, self.max_bytes - open_bytes, side="left")
        return int(min(by_rows, by_bytes, len(items) - 1))

    def ends(self, items: np.ndarray, weight: np.ndarray) -> np.ndarray:
        rows = len(items) - 1
        by_rows = np.searchsorted(items, items[:-1] + self.max_rows, side="left")
        by_bytes = np.searchsorted(weight, weight[:-1] + self.max_bytes, side="left")
        return np.maximum(np.minimum(np.minimum(by_rows, by_bytes), rows), np.arange(rows) + 1)


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=out[1:])
    return out


def _runs(pdf: pd.DataFrame, part: Sequence[str]) -> list[tuple[int, int]]:
    """Row ranges of the streams of a sorted partition; nulls form a stream of their own."""
    starts = np.zeros(len(pdf), dtype=bool)
    starts[:1] = True
    for name in part:
        codes = pd.factorize(pdf[name])[0]
        starts[1:] |= codes[1:] != codes[:-1]
    begin = np.flatnonzero(starts)
    return list(zip(begin.tolist(), [*begin[1:].tolist(), len(pdf)]))


def _partition(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """One range partition of narrow rows (keys and sizes), in order."""
    frames = [b for b in batches if len(b)]
    return pd.concat(frames, ignore_index=True) if frames else None


def _summary(rule, items: np.ndarray, sizes: np.ndarray) -> dict[str, object]:
    """What a run of rows does to any batch that may be open when it is entered."""
    items, weight = rule.weigh(items, sizes)
    rows = len(items) - 1
    entries = min(rows, rule.span)
    here = np.arange(rows)
    ends = rule.ends(items, weight)
    # Pointer doubling: jump to the last batch start inside the run, counting the batches passed.
    jump = np.where(ends < rows, ends, here)
    steps = (jump != here).astype(np.int64)
    while not np.array_equal(jump[jump], jump):
        steps, jump = steps + steps[jump], jump[jump]
    last = jump[:entries]
    return {
        "_rows": rows,
        "_head_items": items[: entries + 1],
        "_head_bytes": weight[: entries + 1],
        "_exit_items": items[-1] - items[last],
        "_exit_bytes": weight[-1] - weight[last],
        "_exit_batches": steps[:entries] + 1,
    }


def _summarise(part: Sequence[str], rule, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Summaries of the first and the last stream of a partition; the others lie wholly inside it."""
    pdf = _partition(batches)
    if pdf is None:
        return
    items, sizes = pdf["_items"].to_numpy(np.int64), pdf["_size"].to_numpy(np.int64)
    runs = _runs(pdf, part)
    for begin, end in dict.fromkeys([runs[0], runs[-1]]):
        row = {name: [pdf[name].iloc[begin]] for name in [*part, "_seg"]}
        row.update({k: [v] for k, v in _summary(rule, items[begin:end], sizes[begin:end]).items()})
        yield pd.DataFrame(row)


def _enter(rule, segment, open_items: int, open_bytes: int, batches: int) -> tuple[int, int, int]:
    """The state a summarised segment is left with when entered with an open batch (or none: ``open_items`` below 0)."""
    items, weight = np.asarray(segment["_head_items"]), np.asarray(segment["_head_bytes"])
    entry = 0 if open_items < 0 else rule.absorbed(items, weight, open_items, open_bytes)
    if entry >= segment["_rows"]:
        return open_items + int(items[-1]), open_bytes + int(weight[-1]), batches
    return int(segment["_exit_items"][entry]), int(segment["_exit_bytes"][entry]), batches + int(segment["_exit_batches"][entry])


def _composed(rule, first, second) -> dict[str, object]:
    """The summary of two neighbouring segments as if they were one."""
    rows = int(first["_rows"]) + int(second["_rows"])
    exits = np.stack([np.asarray(first[f"_exit_{c}"], np.int64) for c in ("items", "bytes", "batches")], axis=1)
    # Batches that start at different rows mostly meet in one state; each distinct state goes through the second segment once.
    states, which = np.unique(exits[:, :2], axis=0, return_inverse=True)
    left = np.array([_enter(rule, second, int(i), int(b), 0) for i, b in states], np.int64).reshape(-1, 3)[which.ravel()]
    left[:, 2] += exits[:, 2]
    entries = min(rows, rule.span)
    heads = {c: np.asarray(first[f"_head_{c}"], np.int64) for c in ("items", "bytes")}
    if len(exits) < entries:  # the first segment is short, so its heads are whole and batches may start in the second
        more = entries - len(exits)
        own = np.stack([np.asarray(second[f"_exit_{c}"], np.int64)[:more] for c in ("items", "bytes", "batches")], axis=1)
        left = np.concatenate([left, own])
        heads = {c: np.concatenate([h, h[-1] + np.asarray(second[f"_head_{c}"], np.int64)[1 : more + 1]]) for c, h in heads.items()}
    return {
        "_rows": rows, "_head_items": heads["items"], "_head_bytes": heads["bytes"],
        "_exit_items": left[:, 0], "_exit_bytes": left[:, 1], "_exit_batches": left[:, 2],
    }


def _compose(part: Sequence[str], rule, pdf: pd.DataFrame) -> pd.DataFrame:
    """One summary for the neighbours of a group, named by the number of the group."""
    ordered = [row for _, row in pdf.sort_values("_seg").iterrows()]
    whole = ordered[0]
    for nxt in ordered[1:]:
        whole = _composed(rule, whole, nxt)
    names = {k: [ordered[0][k]] for k in part}
    fields = [f.split()[0] for f in _SUMMARY_FIELDS.split(", ")]
    return pd.DataFrame({**names, "_seg": [int(ordered[0]["_group"])], **{f: [whole[f]] for f in fields}})


def _chain(part: Sequence[str], rule, pdf: pd.DataFrame) -> pd.DataFrame:
    """Fold a group of summaries in order; emits the state each segment is entered with, where a batch is open.

    The state the group itself is entered with stands in its rows, null where none is.
    """
    out = []
    state = (-1, 0, 0)  # no batch yet
    if "_open_items" in pdf and pdf["_open_items"].notna().any():
        state = tuple(int(pdf[c].iloc[0]) for c in ("_open_items", "_open_bytes", "_batches"))
    for _, seg in pdf.sort_values("_seg").iterrows():
        if state[0] >= 0:
            out.append([*[seg[k] for k in part], seg["_seg"], *state])
        state = _enter(rule, seg, *state)
    return pd.DataFrame(out, columns=[*part, "_seg", "_open_items", "_open_bytes", "_batches"])


def _number(part: Sequence[str], kept: Sequence[str], rule, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batch number of every row of a partition; a continued stream resumes from its entry state."""
    pdf = _partition(batches)
    if pdf is None:
        return
    all_items, all_sizes = pdf["_items"].to_numpy(np.int64), pdf["_size"].to_numpy(np.int64)
    entered = pdf["_open_items"].notna().to_numpy()
    numbers = np.zeros(len(pdf), dtype=np.int64)
    for begin, end in _runs(pdf, part):
        items, weight = rule.weigh(all_items[begin:end], all_sizes[begin:end])
        rows, start, first = end - begin, 0, 0
        if entered[begin]:
            state = pdf.iloc[begin]
            start = rule.absorbed(items, weight, int(state["_open_items"]), int(state["_open_bytes"]))
            first = int(state["_batches"])
        ends = rule.ends(items, weight).tolist()
        begins = np.zeros(rows, dtype=np.int64)
        while start < rows:
            begins[start] = 1
            start = ends[start]
        numbers[begin:end] = first - 1 + np.cumsum(begins)
    yield pdf[list(kept)].assign(batch_no=numbers)


def _pack(df: DataFrame, part: Sequence[str], order_by: Sequence[str], items: Column, size: Column, rule) -> DataFrame:
    part = list(part)
    kept = list(dict.fromkeys([*part, *order_by]))
    narrow = df.select(*kept, items.cast("long").alias("_items"), size.cast("long").alias("_size"))
    cut, _ = segments(narrow, order_by, part)
    kept_schema = T.StructType([df.schema[c] for c in kept])
    key_schema = T.StructType([*[df.schema[c] for c in part], T.StructField("_seg", T.IntegerType())])

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _summarise(part, rule, batches)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _number(part, kept, rule, batches)

    # The cut is settled, so its partitions are the segments and both passes below run without a shuffle.
    summaries = cut.select(*part, "_seg", "_items", "_size").mapInPandas(summarise, _schema(key_schema, _SUMMARY_FIELDS))
    entered = _entered(summaries, part, rule, key_schema, cut.rdd.getNumPartitions())
    condition = F.col("l._seg") == F.col("e._seg")
    for name in part:
        condition = condition & F.col(f"l.{name}").eqNullSafe(F.col(f"e.{name}"))
    # Broadcast bound: only the first stream of a partition can be entered, so one row per partition.
    tagged = cut.alias("l").join(F.broadcast(entered.alias("e")), condition, "left")
    resumed = tagged.select("l.*", "_open_items", "_open_bytes", "_batches").drop("_row")
    return resumed.mapInPandas(number, _schema(kept_schema, "batch_no long"))


def _entered(summaries: DataFrame, part: list[str], rule, key_schema: T.StructType, parts: int) -> DataFrame:
    """The state each segment is entered with. No group holds more than ``FOLD_SEGMENTS`` summaries."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        return _chain(part, rule, pdf)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        return _compose(part, rule, pdf)

    stream = part or [F.lit(0).alias("_stream")]
    state_schema = _schema(key_schema, _STATE_FIELDS)
    # A stream has at most one summary per range partition.
    if parts <= FOLD_SEGMENTS:
        return summaries.groupBy(*stream).applyInPandas(chain, state_schema)
    levels = [settle(summaries)]
    while parts > FOLD_SEGMENTS:
        grouped = levels[-1].withColumn("_group", F.floor(F.col("_seg") / FOLD_SEGMENTS).cast("int"))
        levels.append(settle(grouped.groupBy(*stream, "_group").applyInPandas(compose, summaries.schema)))
        parts = -(-parts // FOLD_SEGMENTS)
    states = levels.pop().groupBy(*stream).applyInPandas(chain, state_schema)
    for level in reversed(levels):
        grouped = level.withColumn("_group", F.floor(F.col("_seg") / FOLD_SEGMENTS).cast("int"))
        same = F.col("l._group") == F.col("s._seg")
        for name in part:
            same = same & F.col(f"l.`{name}`").eqNullSafe(F.col(f"s.`{name}`"))
        handed = grouped.alias("l").join(states.alias("s"), same, "left").select("l.*", "s._open_items", "s._open_bytes", "s._batches")
        states = handed.groupBy(*stream, "_group").applyInPandas(chain, state_schema)
    return states


def _schema(head: T.StructType, ddl: str) -> T.StructType:
    return T.StructType([*head.fields, *T.StructType.fromDDL(ddl).fields])


def batch_by_count_and_bytes(
    df: DataFrame,
    part: Sequence[str],
    order_by: Sequence[str],
    size: str,
    max_items: int,
    max_bytes: int | None = FLUSH_MAX_BYTES,
) -> DataFrame:
    """Greedy ordered packing of each stream; returns ``(part, order_by, batch_no)``, numbered from 0.

    A batch closes when it holds ``max_items`` rows or when the next row would push the insert body
    over ``max_bytes``. A row larger than the cap is a batch of its own.
    """
    if max_items <= 0:
        raise ValueError(f"max_items must be positive; got {max_items}")
    if max_bytes is not None and max_bytes <= 0:
        raise ValueError(f"max_bytes must be positive; got {max_bytes}")
    return _pack(df, part, order_by, F.lit(1), F.col(size), _CapRule(max_items, max_bytes))


def flush_groups(
    df: DataFrame,
    part: Sequence[str],
    order_by: Sequence[str],
    size: str,
    page_size: int = FETCH_PAGE_ROWS,
    max_rows: int = FLUSH_MAX_ROWS,
    max_bytes: int = FLUSH_MAX_BYTES,
) -> DataFrame:
    """Flush number of every page of a stream: ``(part, page_no, page_rows, page_bytes, batch_no)``.

    Rows arrive in pages of ``page_size``; a flush closes after the page with which it reaches
    ``max_rows`` or ``max_bytes``, so the caps can be exceeded by less than one page.
    """
    for name, value in (("page_size", page_size), ("max_rows", max_rows), ("max_bytes", max_bytes)):
        if value <= 0:
            raise ValueError(f"{name} must be positive; got {value}")
    columns = list(dict.fromkeys([*part, *order_by, size]))
    placed = positions(df.select(*columns), order_by, part, name="_pos")
    pages = (
        placed.withColumn("page_no", F.floor((F.col("_pos") - 1) / F.lit(page_size)).cast("long"))
        .groupBy(*part, "page_no")
        .agg(F.count(F.lit(1)).alias("page_rows"), F.sum(F.col(size).cast("long")).alias("page_bytes"))
    )
    # Every page but a stream's last is full, so this many pages always reach max_rows.
    span = -(-max_rows // page_size) + 1
    rule = _ReachRule(max_rows, max_bytes, span)
    numbered = _pack(pages, part, ["page_no"], F.col("page_rows"), F.col("page_bytes"), rule)
    # Null-safe: a stream without a name is a stream, too.
    same = F.col("p.page_no") == F.col("n.page_no")
    for c in part:
        same = same & F.col(f"p.`{c}`").eqNullSafe(F.col(f"n.`{c}`"))
    others = [c for c in numbered.columns if c not in (*part, "page_no")]
    return pages.alias("p").join(numbered.alias("n"), same).select(
        *[F.col(f"p.`{c}`") for c in (*part, "page_no")],
        *[F.col(f"p.`{c}`") for c in pages.columns if c not in (*part, "page_no")],
        *[F.col(f"n.`{c}`") for c in others],
    )
