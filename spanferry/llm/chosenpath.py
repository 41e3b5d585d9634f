"""Near-duplicate classes by a chosen-path set similarity join.

Each distinct shingle set has a signature of minwise values. Trees branch every set into nodes named by the values at a
few chosen coordinates (the first two steps at once), so sets that are alike keep meeting while others part. In every node
all sets are compared with one pivot, in turns with other pivots, as long as that closes nodes: a node whose sets are known to be in one
class cannot change the result. What stays open meets in groups: a set is in much the same company in many of its nodes, so
nodes with one first set are put together, and their sets compared once, exhaustively. A group that is too large for that falls back into its
nodes, of which the small ones are compared and the others branch again. Independent trees bring the recall to its target. What the signatures
suggest is confirmed on full sets, and only confirmed links join classes.

Work on a group of copies grows in proportion: equal sets are one from the start, near copies meet their pivots and close
their nodes. Memberships are pairs of numbers; sketches are fetched for the sets of a comparison alone, and texts move once for
each pair to be confirmed: first each set with its likeliest partner, then whatever still lies between two classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spanferry.llm.components import components, merged
from spanferry.llm.words import Folding, flat_texts, mixed, owners, slices
from spanferry.operators.joins import DEFAULT_LIMITS, fits_broadcast, lookup
from spanferry.shared import settle, small_batches

SHINGLE_WORDS = 5
TREES, CHOICES = 16, 2  # independent trees; coordinates a node branches by
FIRST_STEPS = 2  # coordinates that name a first node, so that sets with one passage in common seldom meet
COORDINATES = 64  # minwise values a set branches by
BINS = 384  # bins of the sketch by which likeness is estimated
SMALL_NODE = 4_096  # sets compared exhaustively, by sketch; grows with depth, so every tree ends
PAIRS_A_BATCH = 4_096  # pairs that leave a task at once, but for those of one set
ROWS_A_PARTITION = 10_000  # rows of numbers or sketches that are worth a task of their own
PAIRS_A_GROUP = 256  # partners of a set that are confirmed in one group; a set with more has several
SLICE_BYTES = 1 << 20  # text worked on at once
SEPARATORS = b"\t\n\x0b\x0c\r "

_draw = np.random.Generator(np.random.PCG64(7))
_FACTORS = _draw.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_BIN_EDGES = np.array([(k << 64) // BINS for k in range(BINS)], np.uint64)


def _stored(df: DataFrame) -> DataFrame:
    """``df``, settled, in no more partitions than its rows need: every later step has a task, and files, for each."""
    df = settle(df)
    return merged(df, df.count(), ROWS_A_PARTITION)


def _measured(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` of numbers, stored, and whether it is within the broadcast bound, which its number of rows tells."""
    df = settle(df)
    rows = df.count()
    fits = rows <= DEFAULT_LIMITS.max_rows and 16 * len(df.columns) * rows <= DEFAULT_LIMITS.max_bytes
    return merged(df, rows, ROWS_A_PARTITION), fits


def shingle_sets(texts: pa.Array, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct ``k``-word shingles as 64-bit hashes; fewer words make one shingle, none make none."""
    folding = Folding(SEPARATORS)
    data, offsets = flat_texts(texts)
    begins, ends = folding.spans(data, offsets)
    words, bounds = folding.hashes(data, begins, ends), owners(offsets, begins)
    rolled = np.full(max(len(words) - k + 1, 0), np.uint64(k))
    for j in range(k):
        rolled = mixed(rolled * np.uint64(0xD6E8FEB86659FD93) + words[j : j + len(rolled)])
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            sets.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            short = np.full(1, np.uint64(b - a))
            for w in words[a:b]:
                short = mixed(short * np.uint64(0xD6E8FEB86659FD93) + w)
            sets.append(short)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _summary(found: np.ndarray) -> tuple[bytes, list[int], bytes, bytes]:
    """Name of a set, its first nodes in all trees, its signature and its sketch."""
    with np.errstate(over="ignore"):
        name = np.array([mixed(found).sum(), mixed(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], ">u8").tobytes()
        least = np.full(COORDINATES, np.uint64(2**64 - 1))
        for part in range(0, len(found), 4096):
            values = found[None, part : part + 4096] * _FACTORS[:, None]
            values += _SHIFTS[:, None]
            least = np.minimum(least, values.min(axis=1))
    roots = np.arange(1, TREES * CHOICES + 1, dtype=np.uint64)
    for step in least[: FIRST_STEPS * TREES * CHOICES].reshape(FIRST_STEPS, -1):
        roots = mixed(roots * np.uint64(0x632BE59BD9B4E019) ^ step)
    # The least hash of each bin, as one byte; 0 for an empty bin. A set is sorted, so that is the bin's first.
    low = np.searchsorted(found, _BIN_EDGES)
    sketch = np.zeros(BINS, np.uint8)
    full = np.flatnonzero(np.diff(np.append(low, len(found))))
    sketch[full] = 1 + mixed(found[low[full]]) % np.uint64(255)
    return name, roots.view(np.int64).tolist(), mixed(least).astype("<u2").tobytes(), sketch.tobytes()


def _true(bins: np.ndarray) -> np.ndarray:
    """How many of each sketch's bins are true."""
    return np.bitwise_count(np.packbits(bins, axis=-1).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _likeness(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Estimated Jaccard likeness of sketches: equal bins among those that either set fills; 0 where it rules the pair out.

    Filled bins are a sample, without replacement, of the union. ``sizes``, those of both sets together, tell how large a
    union at the bound is; what is four standard errors below the bound is ruled out.
    """
    bound = percent / 100
    filled = np.maximum(_true((a | b) != 0), 1)
    found = _true((a == b) & (a != 0)) / filled
    missed = np.maximum(1 - filled * (1 + bound) / np.maximum(sizes, 1), 0)
    return np.where(found >= bound - 4 * np.sqrt(bound * (1 - bound) / filled * missed) - 1e-9, found, 0.0)


_SUMMARY = "doc_id {id}, row_key long, n_shingles long, sid binary, roots array<long>, sig binary, sketch binary"


def summaries(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per row of ``docs``: set size, set name, root nodes and signature (null without words)."""
    names = [p.split()[0] for p in _SUMMARY.split(", ")]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, to in slices(whole.column(2), SLICE_BYTES):
                batch = whole.slice(at, to - at)
                sets = shingle_sets(batch.column(2))
                made = [_summary(s) if len(s) else (None,) * 4 for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64())]
                kinds = (pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary())
                columns += [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), _row_key(doc_id, text), F.col(text)).mapInArrow(summarise, _SUMMARY.format(id=kind))


def _row_key(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id), F.col(text)).alias("row_key")


@F.pandas_udf(T.DoubleType())
def _alike(a: pd.Series, b: pd.Series, sizes: pd.Series, percent: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    left, right = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (a, b))
    return pd.Series(_likeness(left, right, sizes.to_numpy(), int(percent.iloc[0])))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each group, in arrays; its rows ``(meet, id, root, n_shingles, sketch, meets)`` follow one another."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(4)]
        columns.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, BINS))
        columns.append(np.empty(batch.num_rows, object))
        columns[5][:] = [frozenset(meets) for meets in batch.column(5).to_pylist()]
        cuts = np.flatnonzero(np.diff(columns[0])) + 1
        for part in zip(*(np.split(c, cuts) for c in columns)):
            if held and len(part[0]) and held[0][0][0] != part[0][0]:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            if len(part[0]):
                held.append(part)
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _compared(at: int, others: np.ndarray, root: np.ndarray, size: np.ndarray, signs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``others`` that may be linked with set ``at`` and are of another class, and their likenesses."""
    fits = 100 * np.minimum(size[others], size[at]) >= percent * np.maximum(size[others], size[at])
    others = others[fits & (root[others] != root[at])]
    likeness = _likeness(signs[others], signs[at], size[others] + size[at], percent)
    likely = np.flatnonzero(likeness)
    return others[likely], likeness[likely]


def _spanning(root: np.ndarray, size: np.ndarray, signs: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], bool]:
    """Likely pairs, the likeliest, that span what a group's likely pairs and known classes connect; whether there are more.

    A forest grows by one set at a time, the likeliest next, so no more than one likeness a set is held.
    """
    best, near, left = np.zeros(len(root)), np.zeros(len(root), int), np.arange(1, len(root))
    chosen, likely, at = [], 0, 0
    while len(left):
        others, likeness = _compared(at, left, root, size, signs, percent)
        likely += len(others)
        better = likeness > best[others]
        best[others[better]], near[others[better]] = likeness[better], at
        best[left[root[left] == root[at]]] = 2.0  # of the same class, so it comes next and needs no pair
        k = int(np.argmax(best[left]))
        at, left = int(left[k]), np.delete(left, k)
        if 0 < best[at] < 2:
            chosen.append((int(near[at]), at))
    return chosen, likely > len(chosen)


def _pairs_of_small(groups: DataFrame, percent: int, forest: bool) -> DataFrame:
    """``(meet, a, b)`` within groups of a bounded number of sets, by sketch and size, for sets of different classes.

    A set's row names all its groups, ``meets``; a pair is given in the first of those that both sets are in.
    With ``forest`` only pairs that span what a group's likely pairs connect, so a group of copies gives one pair a set; a
    row without a pair then names each group, ``meet``, that has more.
    """

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], ["meet", "a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for meet, ids, root, size, signs, meets in _groups(batches):
            name = int(meet[0])
            if forest:
                chosen, more = _spanning(root, size, signs, percent)
                found += [(name, *sorted((int(ids[i]), int(ids[j])))) for i, j in chosen]
                if more:
                    found.append((name, None, None))
            elif (root != root[0]).any():
                for i in range(1, len(ids)):
                    if len(found) >= PAIRS_A_BATCH:
                        yield batch_of(found)
                        found = []
                    others, _ = _compared(i, np.arange(i), root, size, signs, percent)
                    found += [(name, *sorted((int(ids[i]), int(ids[j])))) for j in others if min(meets[i] & meets[j]) == name]
            if len(found) >= PAIRS_A_BATCH:
                yield batch_of(found)
                found = []
        yield batch_of(found)

    columns = groups.select("meet", "id", "root", "n_shingles", "sketch", F.array().cast("array<long>").alias("meets") if forest else "meets")
    return columns.repartition("meet").sortWithinPartitions("meet", "id").mapInArrow(compare, "meet long, a long, b long")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(a, part, role, id, text)`` without those that repeat one of this task."""
    seen = set()
    for batch in batches:
        kept = []
        for key in zip(*(batch.column(i).to_pylist() for i in range(4))):
            kept.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(kept, pa.bool_()))


def _confirmed(pairs: DataFrame, docs: DataFrame, keys: DataFrame, doc_id: str, text: str, percent: int, repeats: bool) -> DataFrame:
    """The ``pairs(a, b)`` of sets whose Jaccard likeness is ``percent`` or more, on their full sets.

    The text of ``b`` moves to that of ``a`` once; a set with many partners has its own text in as many groups as they need.
    """
    parts = pairs.groupBy("a").agg((1 + F.count(F.lit(1)) / PAIRS_A_GROUP).cast("int").alias("parts"))
    dealt = lookup(pairs, parts, ["a"], how="inner").select("a", F.expr("pmod(xxhash64(b), parts)").cast("int").alias("part"), "b")
    owners_ = dealt.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("id")).distinct()
    asked = dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("id")).unionByName(owners_)
    asked = _stored(asked.join(keys, "id").select("row_key", "a", "part", "role", "id"))
    asked = F.broadcast(asked) if fits_broadcast(asked) else asked
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), _row_key(doc_id, text)).join(asked, "row_key")
    rows = rows.select("a", "part", "role", "id", "text")
    if repeats:
        rows = rows.mapInArrow(_once, rows.schema)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own, last = None, None, None
        for whole in batches:
            for at, to in slices(whole.column(4), SLICE_BYTES):
                batch, found = whole.slice(at, to - at), []
                a, part, role, ids = (batch.column(i).to_pylist() for i in range(4))
                for i, content in enumerate(shingle_sets(batch.column(4))):
                    if role[i] == 0:
                        group, own, last = (a[i], part[i]), content, None
                    elif (a[i], part[i]) == group and ids[i] != last:
                        # A row repeated in the table follows its twin.
                        last = ids[i]
                        shared = len(np.intersect1d(own, content, assume_unique=True))
                        if 100 * shared >= percent * (len(own) + len(content) - shared):
                            found.append((a[i], ids[i]))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "role", "id").mapInArrow(confirm, "a long, b long")


def _open(paths: DataFrame, linked: tuple[DataFrame, bool] | None, every: bool = False) -> DataFrame:
    """``(node, id, root, count, meet, own)`` of the sets in nodes that hold more than one class.

    Of nodes with equal sets one stays, since comparisons in the others would be the same, or ``every`` one, as each branches in its own way.
    ``meet`` is a node's first set in an order that all nodes share, so most nodes of one group of copies have the same, and ``own`` its class.
    """
    if linked is None:
        rooted = paths.select("id", F.col("id").alias("root"), "nodes")
    else:
        rooted = lookup(paths, linked[0], ["id"], small=linked[1]).select("id", F.coalesce("root", "id").alias("root"), "nodes")
    members = rooted.select(F.explode("nodes").alias("node"), "id", "root")
    first = [F.expr(f"min_by({c}, xxhash64(id, 0))").alias(name) for c, name in (("id", "meet"), ("root", "own"))]
    digests = [F.expr(f"bit_xor(xxhash64(id, {k}))").alias(f"d{k}") for k in (1, 2)]
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("count"), F.min("root").alias("x"), F.max("root").alias("y"), *first, *digests)
    sizes = sizes.where("x <> y")
    if not every:
        sizes = sizes.groupBy("count", "d1", "d2", "meet", "own").agg(F.min("node").alias("node"))
    sizes, few = _measured(sizes.select("node", "count", "meet", "own"))
    return _stored(lookup(members, sizes, ["node"], how="inner", small=few))


def _groups_of(members: DataFrame, limit: int) -> DataFrame:
    """``(meet, id, root)`` of the groups in which sets are compared, none of more than ``limit`` sets.

    Nodes with one first set are a group. Where that holds more sets, each of its nodes within the limit is a group by itself.
    """
    together = _stored(members.select("meet", "id", "root").distinct())
    wide, few = _measured(together.groupBy("meet").count().where(F.col("count") > limit).select("meet"))
    if wide.isEmpty():
        return together
    alone = lookup(members.where(F.col("count") <= limit), wide, ["meet"], how="left_semi", small=few)
    alone = alone.select(F.col("node").alias("meet"), "id", "root")
    return _stored(lookup(together, wide, ["meet"], how="left_anti", small=few).unionByName(alone))


def _some_signs(signs: DataFrame, ids: DataFrame) -> DataFrame:
    """Sketches and sizes of the sets in ``ids(id)``."""
    wanted, few = _measured(ids.distinct())
    return _stored(lookup(signs.select("id", "n_shingles", "sketch"), wanted, ["id"], how="left_semi", small=few))


def _with_pivots(members: DataFrame, signs: DataFrame, turn: int, percent: int) -> DataFrame:
    """``(a, b, alike)`` of sets ``b`` and the likely pivots ``a`` of other classes that they meet in their nodes.

    A node's pivot is its first set in an order that all nodes share in a turn, so nodes of one group of copies mostly have one pivot.
    """
    if turn == 1:
        met = members.select(F.col("meet").alias("a"), "own", F.col("id").alias("b"), "root")
    else:
        order = f"xxhash64(id, {turn})"
        pivots, few = _measured(members.groupBy("node").agg(F.expr(f"min_by(id, {order})").alias("a"), F.expr(f"min_by(root, {order})").alias("own")))
        met = lookup(members.select("node", F.col("id").alias("b"), "root"), pivots, ["node"], how="inner", small=few)
    met = _stored(met.where("root <> own").select("a", "b").distinct())
    some = _some_signs(signs, met.select(F.explode(F.array("a", "b")).alias("id")))
    first, second = (some.select(F.col("id").alias(x), F.struct("n_shingles", "sketch").alias(f"of_{x}")) for x in "ab")
    both = lookup(met.join(second, "b"), first, ["a"], how="inner", small=False, keys_of=met)
    sizes = F.col("of_a.n_shingles"), F.col("of_b.n_shingles")
    both = both.where(100 * F.least(*sizes) >= percent * F.greatest(*sizes)).withColumn(
        "alike", _alike("of_a.sketch", "of_b.sketch", sizes[0] + sizes[1], F.lit(percent))
    )
    return _stored(both.where("alike > 0").select("a", "b", "alike"))


def _apart(pairs: DataFrame, linked: tuple[DataFrame, bool] | None) -> DataFrame:
    """The ``pairs(a, b)`` whose ends are not known to be in one class."""
    if linked is None:
        return pairs
    for x in "ab":
        pairs = lookup(pairs, linked[0].select(F.col("id").alias(x), F.col("root").alias(f"of_{x}")), [x], small=linked[1])
    return pairs.where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """``doc_id, row_key, n_shingles, class, component_id`` per row of ``docs``; see :func:`near_duplicates`.

    ``class`` is the same number for all rows whose sets links connect, and null for rows without words.
    """
    with small_batches(docs.sparkSession):
        return _classes(docs, doc_id, text, percent)


def _classes(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    # Once stored, a row's number is fixed; a set is known by the number of its first row.
    summary = settle(summaries(docs, doc_id, text).withColumn("id", F.monotonically_increasing_id()))
    rows = summary.where("sid is not null")
    repeats = not summary.groupBy("row_key").count().where("count > 1").isEmpty()
    sets = _stored(
        rows.groupBy("sid")
        .agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("row_key").alias("row_key"), F.first("roots").alias("roots"))
    )
    keys = sets.select("id", "row_key")
    branched = sets.select("id", F.explode("roots").alias("node"))
    crowded, few = _measured(branched.groupBy("node").count().where("count > 1").select("node"))
    paths = _stored(lookup(branched, crowded, ["node"], how="left_semi", small=few).groupBy("id").agg(F.collect_list("node").alias("nodes")))
    signs = _stored(lookup(rows.select("id", "sig", "sketch", "n_shingles"), paths.select("id"), ["id"], how="left_semi"))
    linked, tried = None, None

    def join_classes(found: DataFrame) -> bool:
        """Confirm the pairs that were not tried before; whether links came of them."""
        nonlocal linked, tried
        chosen = settle(found if tried is None else found.join(tried, ["a", "b"], "left_anti"))
        pairs = chosen.count()
        if not pairs:
            return False
        chosen = merged(chosen, pairs, ROWS_A_PARTITION)
        tried = chosen if tried is None else tried.unionByName(chosen)
        sure = _stored(_confirmed(chosen, docs, keys, doc_id, text, percent, repeats))
        if sure.isEmpty():
            return False
        # Stars stand for all links before.
        linked = _measured(components(sure if linked is None else sure.unionByName(linked[0].select(F.col("id").alias("a"), F.col("root").alias("b")))))
        return True

    level = turn = 0
    while True:
        limit = SMALL_NODE * (1 + level // 4)
        before, unsettled = None, paths
        while True:
            # A node that was closed stays closed, so a pass looks at those alone that the pass before it left open.
            members = _open(unsettled, linked)
            left = members.count()
            if not left or (before is not None and 2 * left > before):
                break
            before, turn = left, turn + 1
            unsettled = members.groupBy("id").agg(F.collect_list("node").alias("nodes"))
            # Each set's likeliest pivot first, then the others that still lie in another class.
            likely = _with_pivots(members, signs, turn, percent)
            best = join_classes(_ordered(likely.groupBy("b").agg(F.max_by("a", "alike").alias("a"))))
            others = join_classes(_ordered(_apart(likely.select("a", "b"), linked)))
            if not (best or others):
                break
        if not left:
            break
        # First pairs that span the groups, each set's likeliest one; then all that still lie between two classes.
        small = _groups_of(members, limit)
        if not small.isEmpty():
            some = _some_signs(signs, small.select("id"))
            found = _stored(_pairs_of_small(small.join(some, "id"), percent, True))
            join_classes(found.where("a is not null").select("a", "b").distinct())
            more = found.where("a is null").select("meet")
            if not more.isEmpty():
                again = lookup(small, more, ["meet"], how="left_semi").groupBy("id").agg(F.collect_list("meet").alias("meets"))
                again = again.select("id", "meets", F.explode("meets").alias("meet"))
                again = again if linked is None else lookup(again, linked[0], ["id"], small=linked[1])
                again = again.withColumn("root", F.coalesce("root", "id") if linked is not None else F.col("id"))
                found = _pairs_of_small(again.join(some, "id"), percent, False)
                join_classes(found.select("a", "b").distinct())
        if members.where(F.col("count") > limit).isEmpty():
            break
        level += 1
        # A signature is joined once a set, to all nodes the set is in.
        going = _open(paths, linked, every=True).where(F.col("count") > limit).groupBy("id").agg(F.collect_list("node").alias("nodes"))
        lane = f"pmod(xxhash64(node, c, {level}), {COORDINATES // CHOICES}) + c * {COORDINATES // CHOICES}"
        child = f"xxhash64(node, {lane}, substring(sig, 2 * cast({lane} as int) + 1, 2))"
        children = F.expr(f"flatten(transform(nodes, node -> transform(sequence(0, {CHOICES - 1}), c -> {child})))")
        paths = _stored(going.join(signs.select("id", "sig"), "id").select("id", children.alias("nodes")))
    grouped = sets.where("n > 1").select("id")
    if linked is None:
        labelled = sets.where("n > 1").withColumn("root", F.col("id"))
    else:
        grouped, few = _measured(grouped.unionByName(linked[0].select("id")).distinct())
        labelled = lookup(lookup(sets, grouped, ["id"], how="left_semi", small=few), linked[0], ["id"], small=linked[1])
        labelled = labelled.withColumn("root", F.coalesce("root", "id"))
    labelled = _stored(labelled.select("sid", "least", "root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = _stored(lookup(labelled, _stored(smallest), ["root"], how="inner").select("sid", "root", "component_id"))
    found = lookup(summary.select("doc_id", "row_key", "n_shingles", "sid", "id"), named, ["sid"])
    own = F.when(F.col("sid").isNotNull(), F.col("id"))
    return found.select(
        "doc_id", "row_key", "n_shingles", F.coalesce("root", own).alias("class"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    Words are runs without white space, A-Z in lower case; documents are linked when the Jaccard likeness of their
    distinct 5-word shingles is at least ``percent`` hundredths. ``component_id`` is the smallest ``doc_id`` that links
    reach, ``kept`` says whether that is the row's own. Rows without words (or null texts) have an empty set and only
    themselves; a null ``doc_id`` counts only where its component has no other. Repeated rows share a component, and
    each row with the smallest id is kept. An empty table gives no rows; extra columns are ignored.

    Recall: sets at the bound share one of the 32 first nodes but for 3 in 10^12. A node that pivots leave open and that
    holds more than 4,096 sets branches, and such a level keeps 15 in 16 of the nodes a pair shares. A sketch within four
    standard errors of the bound passes (of bins filled by a union of that size), which leaves out about 1 in 30,000 pairs at
    the bound itself, and ever fewer above.
    """
    found = classes(docs, doc_id, text, percent)
    kept = F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept")
    return found.select("doc_id", "n_shingles", "component_id", kept)


def one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` with one row of each class: the smallest ``doc_id``, of rows that repeat it the one with the least key.

    Rows without words all stay. Only keys of rows to drop are joined to the documents.
    """
    found = settle(classes(docs, doc_id, text, percent).where("class is not null").select("doc_id", "row_key", "class"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key"))
    crowded = found.groupBy("class").agg(first.alias("w"), F.count(F.lit(1)).alias("c")).where("c > 1").select("class", F.col("w.row_key").alias("winner"))
    members = settle(lookup(found, crowded, ["class"], how="inner"))
    losers = members.where("row_key <> winner").select(F.col("row_key").alias("_key")).distinct()
    twice = members.where("row_key = winner").groupBy(F.col("row_key").alias("_key")).count().where("count > 1").select("_key")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _row_key(doc_id, text).alias("_key"))
    left = lookup(keyed, settle(losers), ["_key"], how="left_anti", keys_of=found.select(F.col("row_key").alias("_key")))
    twice = settle(twice)
    once = left.join(F.broadcast(twice) if fits_broadcast(twice) else twice, "_key", "left_anti")
    again = left.join(F.broadcast(twice) if fits_broadcast(twice) else twice, "_key", "left_semi").dropDuplicates(["_key"])
    return once.unionByName(again).select("_row.*")
