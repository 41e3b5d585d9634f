"""Connected components of a graph of links.

Each task first joins what its own links connect (union by the smaller id), which leaves a star for each group it saw.
Where one task held all links, that is the answer; otherwise alternating large-star and small-star steps join the stars of
all tasks in a few rounds of grouping and joining. A task holds a bounded number of links, lineage is cut on
shared storage each round, and only one checksum a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanferry.operators.joins import lookup
from spanferry.shared import settle

ROWS_A_PARTITION = 2_000
LINKS_A_TASK = 100_000  # links joined in one task, at most about this many


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def merged(df: DataFrame, rows: int, a_partition: int = ROWS_A_PARTITION) -> DataFrame:
    """``df`` in no more partitions than its number of rows needs, without a shuffle.

    Links are far fewer than documents; in as many partitions, most would be empty, and each would still write files.
    """
    return df.coalesce(1 + rows // a_partition)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A link ``(a, b)`` from each id to the smallest that this task's links reach, itself included."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], ["a", "b"])


def components(links: DataFrame, links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """``(id, root)`` for every id in ``links(a, b)``, two longs: the smallest id its links reach.

    Links with a null end are ignored; ids linked only with themselves are their own root; an empty table gives no rows.
    """
    links = settle(links.select("a", "b").where("a is not null and b is not null"))
    tasks = 1 + links.count() // links_a_task
    stars = (links.coalesce(1) if tasks == 1 else links.repartition(tasks)).mapInArrow(_stars, "a long, b long")
    if tasks == 1:
        return stars.select(F.col("a").alias("id"), F.col("b").alias("root"))
    stars = settle(stars)
    everyone = stars.select(F.col("a").alias("id")).distinct()
    links = settle(stars.where("a <> b").distinct())
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        large = settle(lookup(both.where("b > a"), least, ["a"], how="inner").select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = settle(large.groupBy("a").agg(F.min("b").alias("m")))
        small = lookup(large, down, ["a"], how="inner").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = settle(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        found = _mark(links)
        if found == mark:
            break
        mark = found
    roots = links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return lookup(everyone, roots, ["id"]).select("id", F.coalesce("root", "id").alias("root"))
