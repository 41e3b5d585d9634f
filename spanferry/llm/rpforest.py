"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Trees are grown on the driver from a bounded sample and hold nothing but hyperplanes; every row is then routed to its
leaf in every tree. A query walks all trees through one priority queue, best margin first, until the leaves it has
reached hold enough rows. Leaves meet the queries that reached them in cogroups of bounded size, and what they hold is
scored exactly; the first tree's leaves come first, and the others send only what beats a query's k best of those. How many rows are enough is measured: a few queries are compared with every row, and the effort is the
least at which the forest finds the wanted share of their neighbours. Rows with equal vectors are one candidate until
the end.

Inner products become distances by one more coordinate, ``sqrt(M^2 - |x|^2)``, which is 0 for a query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanferry.llm.shipping import Shared
from spanferry.shared import settle

SAMPLE_ROWS = 16_384  # rows the trees are grown from, at most about this many
TREES = 12
LEAF_ROWS = 128  # sample rows at which a node is split no further
RECALL = 0.95  # recall the search effort is set for, on queries compared with every row
TRIED_QUERIES = 96  # how many queries that are
BOUND_ROWS = 2_048  # sample rows that give each query a lower bound for its k-th best score
GROUP_ROWS, GROUP_QUERIES = 4_096, 8_192  # rows and queries of a leaf that meet in one group
SEED = 11


@dataclass
class Forest:
    """Hyperplanes of all trees. Node ``i`` sends rows above its plane to ``up[i]``, others to ``down[i]``; ``~leaf`` marks leaves."""

    planes: np.ndarray
    offsets: np.ndarray
    up: np.ndarray
    down: np.ndarray
    roots: list[int]
    leaves: int
    norm: float
    first: int = 0  # leaves of the first tree, which are numbered before all others

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0))
        return np.concatenate([vectors, rest[:, None]], axis=1).astype(np.float32)

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree: ``rows x trees``."""
        x, out = self.lifted(vectors), np.empty((len(vectors), len(self.roots)), np.int64)
        for tree, root in enumerate(self.roots):
            at = np.full(len(x), root, np.int64)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                above = np.einsum("ij,ij->i", x[inner], self.planes[node]) > self.offsets[node]
                at[inner] = np.where(above, self.up[node], self.down[node])
            out[:, tree] = ~at
        return out

    def reach(self, vectors: np.ndarray, held: np.ndarray, enough: int) -> list[list[int]]:
        """Per query the leaves to look into, best first, until they hold ``enough`` rows (``held`` per leaf)."""
        x = np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1).astype(np.float32)
        found = []
        for margins in x @ self.planes.T - self.offsets if len(self.planes) else np.zeros((len(x), 0)):
            margin = margins.tolist()
            queue = [(-np.inf, root) for root in self.roots]
            heapq.heapify(queue)
            leaves, rows = [], 0
            while queue and rows < enough:
                worst, node = heapq.heappop(queue)
                if node < 0:
                    leaves.append(~node)
                    rows += held[~node]
                    continue
                m = margin[node]
                heapq.heappush(queue, (max(worst, -m), int(self.up[node])))
                heapq.heappush(queue, (max(worst, m), int(self.down[node])))
            found.append(leaves)
        return found


def grow(sample: np.ndarray, norm: float, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = SEED) -> Forest:
    """A forest over ``sample``; each node splits midway between two random rows, or at the median if that is lopsided."""
    draw = np.random.Generator(np.random.PCG64(seed))
    forest = Forest(np.zeros((0, 0)), np.zeros(0), np.zeros(0), np.zeros(0), [], 0, norm)
    x = forest.lifted(sample) if len(sample) else np.zeros((0, 1), np.float32)
    planes, offsets, links = [], [], []

    def split(rows: np.ndarray) -> int:
        if len(rows) > leaf_rows:
            for _ in range(3):
                a, b = x[draw.choice(rows, 2, replace=False)]
                plane = a - b
                length = float(np.linalg.norm(plane))
                if length == 0:
                    continue
                plane = plane / length
                places = x[rows] @ plane
                offset = float(plane @ (a + b)) / 2
                share = (places > offset).mean()
                if not 0.1 <= share <= 0.9:
                    offset = float(np.median(places))
                above = places > offset
                if 0 < above.sum() < len(rows):
                    node = len(planes)
                    planes.append(plane)
                    offsets.append(offset)
                    links.append([0, 0])
                    links[node][0] = split(rows[above])
                    links[node][1] = split(rows[~above])
                    return node
        forest.leaves += 1
        return -forest.leaves

    for tree in range(trees):
        forest.roots.append(split(np.arange(len(x))))
        if not tree:
            forest.first = forest.leaves
    if planes:
        forest.planes, forest.offsets = np.array(planes, np.float32), np.array(offsets, np.float32)
        forest.up, forest.down = np.array(links, np.int64).T
    return forest


def _matrix(values: pa.Array, kind: str) -> np.ndarray:
    held = values.to_pylist()
    return np.frombuffer(b"".join(held), kind).reshape(len(held), -1).astype(np.float64)


def _packed(vectors: pa.Array, kind: str) -> pa.Array:
    # Vectors travel as bytes, exactly as they are.
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)
    size = len(flat) // max(len(vectors), 1)
    return pa.array([flat[i : i + size].tobytes() for i in range(0, len(flat), max(size, 1))], pa.binary())


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not zero, every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _exact_best(rows: DataFrame, queries: np.ndarray, k: int, kind: str) -> pa.Table:
    """The ``k`` nearest of all ``rows(rep, vector)`` for a few queries: ``query, vector``; each task sends k a query."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[float, bytes]]] = [[] for _ in queries]
        for batch in batches:
            x = _matrix(batch.column(0), kind)
            scores = queries @ x.T
            for i, row in enumerate(scores):
                top = np.argpartition(-row, min(k, len(row)) - 1)[:k]
                held[i] = heapq.nlargest(k, held[i] + [(float(row[j]), batch.column(0)[int(j)].as_py()) for j in top], key=lambda t: t[0])
        found = [(i, s, v) for i, h in enumerate(held) for s, v in h]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.binary())],
            ["query", "score", "vector"],
        )

    mine = rows.select("vector").mapInArrow(best, "query int, score double, vector binary")
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    return mine.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("query", "vector").toArrow()


def effort(forest: Forest, queries: np.ndarray, near: list[np.ndarray], held: list[int], recall: float) -> tuple[int, float]:
    """The least number of rows to reach at which the leaves hold ``recall`` of the queries' neighbours, and that recall."""
    total = sum(held)
    wanted = [forest.route(n) for n in near]
    rows, found = 1_000, 0.0
    while True:
        reached = forest.reach(queries, np.array(held), rows)
        hits = [np.isin(w, leaves).any(axis=1) for w, leaves in zip(wanted, reached)]
        found = float(np.concatenate(hits).mean()) if hits else 1.0
        if found >= recall or rows >= total:
            return rows, found
        rows = min(total, int(rows * 1.3) + 1)


def nearest(
    vectors: DataFrame, k: int = 20, is_query: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding",
    recall: float = RECALL, trees: int = TREES, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query, its own row left out.

    ``is_query`` picks the queries (all rows by default); every other row is a candidate. Nearness is the inner product
    in double precision, ties go to the smaller id; fewer candidates than ``k`` are all returned. Rows take no part when
    their id is null or their vector is null, zero, holds a null or non-finite component, or has another length than
    most. Of rows that repeat an id, the one with the least vector counts. Extra columns are ignored.

    Of equal vectors only the ``k + 1`` smallest ids can be among the ``k`` nearest of any query, so no more are kept.
    """
    is_query = F.lit(True) if is_query is None else is_query
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    valid = vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), F.size(vector).alias("d"), is_query.alias("q")
    )
    lengths = valid.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    base = valid.where(F.col("d") == (lengths["d"] if lengths else 0)).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    base = settle(base)
    order = Window.partitionBy("v").orderBy("vec_id")
    kept = base.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    grouped = kept.groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _packed(b.column(2), kind)], ["rep", "ids", "vector"])

    id_kind = vectors.schema[vec_id].dataType.simpleString()
    reps = settle(grouped.select("rep", "ids", "v").mapInArrow(pack, f"rep {id_kind}, ids array<{id_kind}>, vector binary"))
    asked = settle(base.where("q").join(grouped.select("v", "rep"), "v").select(F.col("vec_id").alias("query_id"), "rep"))
    query_reps = asked.select("rep").distinct().join(reps.select("rep", "vector"), "rep")

    norm_of = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    total = base.agg(F.count(F.lit(1)).alias("n"), F.max(norm_of).alias("norm")).first()
    share = min(1.0, sample_rows / max(total["n"], 1))
    picked = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("rep", "vector").orderBy("rep")
    drawn = picked.toArrow()
    sample = _matrix(drawn["vector"], kind) if drawn.num_rows else np.zeros((0, 1))
    forest = Shared(spark, grow(sample, float(total["norm"] or 0), trees))
    bound = Shared(spark, sample[np.random.Generator(np.random.PCG64(SEED)).permutation(len(sample))[:BOUND_ROWS]])
    leaves = forest.value.leaves

    def leaf_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(leaves, np.int64)
        for b in batches:
            counts += np.bincount(forest.value.route(_matrix(b.column(0), kind)).ravel(), minlength=leaves)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts)), pa.array(counts[counts > 0])], ["leaf", "n"])

    held = np.zeros(leaves, np.int64)  # bounded by the sample, like the trees
    for r in reps.select("vector").mapInArrow(leaf_rows, "leaf long, n long").groupBy("leaf").agg(F.sum("n")).collect():
        held[r[0]] = r[1]

    tried = query_reps.orderBy(F.xxhash64("rep", F.lit(SEED))).limit(TRIED_QUERIES).toArrow()
    rows = 1_000
    if tried.num_rows:
        tried_queries = _matrix(tried["vector"], kind)
        best = _exact_best(reps, tried_queries, k + 1, kind)
        which, near = np.array(best["query"].to_pylist()), _matrix(best["vector"], kind)
        rows, _ = effort(forest.value, tried_queries, [near[which == i] for i in range(len(tried_queries))], held.tolist(), recall)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                x = _matrix(b.column(1), kind)
                found = forest.value.reach(x, held, rows)
                least = np.full(len(x), -np.inf)
                if len(bound.value) > k:
                    # The query may be in the sample itself: the (k+1)-th best, less what rounding may do.
                    scores = x @ bound.value.T
                    least = -np.partition(-scores, k, axis=1)[:, k] - 1e-9 * forest.value.norm**2
                n = np.array([len(f) for f in found])
                at = np.repeat(np.arange(len(x)), n)
                leaf = np.array([i for f in found for i in f], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(leaf), pa.array(least[at])], ["q", "leaf", "least"])

    probes = settle(query_reps.select("rep", "vector").mapInArrow(reach, f"q {id_kind}, leaf long, least double"))

    def found_among(probes: DataFrame) -> DataFrame:
        arriving = np.zeros(leaves, np.int64)
        for r in probes.groupBy("leaf").count().collect():
            arriving[r[0]] = r[1]
        row_parts, query_parts = np.maximum(-(-held // GROUP_ROWS), 1), -(-arriving // GROUP_QUERIES)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                    leaf = forest.value.route(_matrix(b.column(1), kind))
                    part = b.column(2).to_numpy()[:, None] % row_parts[leaf]
                    at = np.repeat(np.arange(len(leaf)), leaf.shape[1])
                    leaf, part = leaf.ravel(), part.ravel()
                    times = query_parts[leaf]
                    at, leaf, part = (np.repeat(z, times) for z in (at, leaf, part))
                    other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf), pa.array(part), pa.array(other), b.column(0).take(take), b.column(1).take(take)],
                        ["leaf", "part", "other", "rep", "vector"],
                    )

        spread = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)).alias("h")
        index = reps.select("rep", "vector", spread).mapInArrow(placed, f"leaf long, part long, other long, rep {id_kind}, vector binary")
        parts = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(query_parts, row_parts)) if a]
        parts = spark.createDataFrame(parts, "leaf long, _queries long, _rows long")
        # Broadcast bound: one row a leaf.
        asks = probes.join(F.broadcast(parts), "leaf").join(query_reps.withColumnRenamed("rep", "q"), "q").select(
            "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)).alias("part"),
            F.pmod(F.xxhash64("q"), F.col("_queries")).alias("other"), "q", "least", "vector",
        )

        def meet(_, left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["q", "rep", "score"]
            kinds = [right.schema.field("q").type, left.schema.field("rep").type, pa.float64()]
            if not left.num_rows or not right.num_rows:
                return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
            x, q = _matrix(left["vector"], kind), _matrix(right["vector"], kind)
            floor = right["least"].to_numpy()
            slack = 1e-9 * forest.value.norm**2
            at_q, at_x, out = [], [], []
            for a in range(0, len(q), 512):
                scores = q[a : a + 512] @ x.T
                if len(x) > k + 1:
                    top = -np.partition(-scores, k, axis=1)[:, k] - slack
                    rough = scores >= np.maximum(floor[a : a + 512], top)[:, None]
                else:
                    rough = scores >= floor[a : a + 512, None]
                i, j = np.nonzero(rough)
                # Sums in a fixed order, whatever else is in the group: equal pairs get equal scores everywhere.
                at_q.append(i + a)
                at_x.append(j)
                out.append((q[i + a] * x[j]).sum(axis=1))
            take_q, take_x = pa.array(np.concatenate(at_q)), pa.array(np.concatenate(at_x))
            return pa.Table.from_arrays([right["q"].take(take_q), left["rep"].take(take_x), pa.array(np.concatenate(out))], names)

        keys = ["leaf", "part", "other"]
        hits = index.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(meet, f"q {id_kind}, rep {id_kind}, score double")
        return nearest_of(hits)

    def nearest_of(hits: DataFrame) -> DataFrame:
        best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
        return hits.dropDuplicates(["q", "rep"]).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r")

    # What the first tree's leaves hold bounds what the other trees have to send: the sample's bound alone lets through
    # as many rows a query as the table grows.
    in_first = F.col("leaf") < forest.value.first
    early = settle(found_among(probes.where(in_first)))
    bars = early.groupBy("q").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
    raised = F.greatest("least", F.col("bar") - 1e-9 * forest.value.norm**2).alias("least")
    later = settle(probes.where(~in_first).join(bars, "q", "left").select("q", "leaf", raised))
    found = settle(nearest_of(early.unionByName(found_among(later))))
    # Queries whose bound left fewer than k although there are more: once again without a bound, in every leaf.
    enough = min(k + 1, reps.count())
    short = query_reps.select(F.col("rep").alias("q")).join(
        found.groupBy("q").count().where(F.col("count") >= enough), "q", "left_anti"
    )
    if not short.isEmpty():
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(leaves - 1).cast("long")))
        again = settle(short.select("q", every.alias("leaf"), F.lit(float("-inf")).alias("least")))
        found = settle(found.join(short, "q", "left_anti").unionByName(found_among(again)))

    named = found.join(reps.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    leading = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("_r", F.row_number().over(leading)).where(F.col("_r") <= k + 1)
    each = asked.join(named.withColumnRenamed("q", "rep"), "rep").where("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
