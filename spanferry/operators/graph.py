"""Dependencies between rows: reference edges, levels and failure closure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanferry.operators.joins import DEFAULT_LIMITS, JoinLimits, lookup
from spanferry.operators.resolve import is_set
from spanferry.shared import settle

EDGE_COLUMNS = ("src_type", "src_id", "dep_type", "dep_id")


def edges_from(
    df: DataFrame, src_type: str, src_id: str, dep: Column, dep_type: Column | str, where: Column | None = None
) -> DataFrame:
    """Edges of one scalar reference column."""
    kind = F.lit(dep_type) if isinstance(dep_type, str) else dep_type
    chosen = df if where is None else df.where(where)
    edges = chosen.select(
        F.lit(src_type).alias("src_type"),
        F.col(src_id).cast("string").alias("src_id"),
        kind.alias("dep_type"),
        dep.cast("string").alias("dep_id"),
    )
    return edges.where(is_set(edges, "dep_id"))


def edges_from_array(df: DataFrame, src_type: str, src_id: str, ids: Column, dep_type: str) -> DataFrame:
    """Edges of an array of ids."""
    return edges_from(df.select(src_id, F.explode(ids).alias("_dep")), src_type, src_id, F.col("_dep"), dep_type)


def _functions(df: DataFrame) -> list[DataFrame]:
    kind = F.col("origin.object_type")
    migratable = kind.isin("prompt", "dataset", "experiment", "project")
    return [edges_from(df, "function", "id", F.col("origin.object_id"), kind, migratable)]


def _scores(df: DataFrame) -> list[DataFrame]:
    scorers = F.filter("config.online.scorers", lambda s: s["type"] == "function")
    return [
        edges_from(df, "project_score", "id", F.col("project_id"), "project"),
        edges_from_array(df, "project_score", "id", F.transform(scorers, lambda s: s["id"]), "function"),
    ]


# The references each kind of object makes. Tags and iframes make none; saved parameters of an
# experiment are remapped but are not an edge.
_REFERENCES = {
    "experiment": lambda df: [
        edges_from(df, "experiment", "id", F.col("dataset_id"), "dataset"),
        edges_from(df, "experiment", "id", F.col("base_exp_id"), "experiment"),
    ],
    "function": _functions,
    "prompt": lambda df: [edges_from(df, "prompt", "id", F.col("prompt_data.origin.prompt_id"), "prompt")],
    "project_score": _scores,
    "view": lambda df: [
        edges_from(df, "view", "id", F.col("object_id"), F.col("object_type"), F.col("object_type") != "project")
    ],
    "role": lambda df: [edges_from_array(df, "role", "id", F.col("member_roles"), "role")],
    "group": lambda df: [edges_from_array(df, "group", "id", F.col("member_groups"), "group")],
    "acl": lambda df: [
        edges_from(df, "acl", "id", F.col("object_id"), F.col("object_type")),
        edges_from(df, "acl", "id", F.col("role_id"), "role"),
        edges_from(df, "acl", "id", F.col("group_id"), "group"),
    ],
}


def union_edges(parts: Sequence[DataFrame]) -> DataFrame:
    """One edge table from several."""
    if not parts:
        raise ValueError("no edges to union")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reference_edges(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All reference edges ``(src_type, src_id, dep_type, dep_id)`` of the given object tables."""
    return union_edges([part for kind, df in tables.items() for part in _REFERENCES.get(kind, lambda _: [])(df)])


def _inner_edges(nodes: DataFrame, edges: DataFrame, limits: JoinLimits) -> DataFrame:
    """Distinct ``(src, dep)`` pairs with both ends among the nodes."""
    pairs = edges.select(F.col("src").alias("src"), F.col("dep").alias("dep")).distinct()
    known = nodes.select(F.col("id").alias("dep")).distinct()
    inside = lookup(pairs, known, ["dep"], "left_semi", limits)
    return lookup(inside, known.withColumnRenamed("dep", "src"), ["src"], "left_semi", limits)


def dependency_levels(nodes: DataFrame, edges: DataFrame, limits: JoinLimits = DEFAULT_LIMITS) -> DataFrame:
    """``(id, tier)`` for ``nodes(id)``: 0 without dependencies, else one more than its latest dependency.

    ``edges`` is ``(src, dep)``; edges to other nodes are ignored. Nodes on a cycle, or behind one, get
    null. Each round resolves the edges into the newest tier and keeps only the others, so the work
    shrinks with the open edges, and there are as many rounds as the longest chain has nodes.
    """
    ids = settle(nodes.select("id").distinct())
    open_edges = settle(_inner_edges(ids, edges, limits))
    blocked = open_edges.select(F.col("src").alias("id")).distinct()
    ready = settle(lookup(ids, blocked, ["id"], "left_anti", limits))
    placed, tier = ready.withColumn("tier", F.lit(0)), 0
    while not ready.isEmpty():
        newest = ready.select(F.col("id").alias("dep"), F.lit(True).alias("_done"))
        tagged = settle(
            lookup(open_edges, newest, ["dep"], "left", limits).select("src", "dep", F.coalesce("_done", F.lit(False)).alias("_done"))
        )
        # Edges resolved in earlier rounds are gone, so a node is ready when all its rows are done.
        ready = settle(
            tagged.groupBy(F.col("src").alias("id")).agg(F.bool_and("_done").alias("_all")).where("_all").select("id")
        )
        tier += 1
        placed = placed.unionByName(ready.withColumn("tier", F.lit(tier)))
        open_edges = tagged.where(~F.col("_done")).select("src", "dep")
    stuck = open_edges.select(F.col("src").alias("id")).distinct().withColumn("tier", F.lit(None).cast("int"))
    return placed.unionByName(stuck)


def blocked_by_failure(edges: DataFrame, failed: DataFrame, limits: JoinLimits = DEFAULT_LIMITS) -> DataFrame:
    """Every direct or transitive dependent of a failed node: ``(id)``; the failed nodes are not included.

    ``edges`` is ``(src, dep)`` and ``failed`` is ``(id)``. Each round follows only the newest nodes.
    """
    pairs = settle(edges.select("src", "dep").distinct())
    failures = settle(failed.select("id").distinct())
    reached, frontier = failures, failures
    found = None
    while True:
        hop = frontier.withColumnRenamed("id", "dep")
        dependents = lookup(pairs, hop, ["dep"], "left_semi", limits).select(F.col("src").alias("id")).distinct()
        frontier = settle(lookup(dependents, reached, ["id"], "left_anti", limits))
        if frontier.isEmpty():
            break
        found = frontier if found is None else found.unionByName(frontier)
        reached = reached.unionByName(frontier)
    return failures.where(F.lit(False)) if found is None else found
