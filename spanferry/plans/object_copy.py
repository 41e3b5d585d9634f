"""Object copy: every kind of metadata object rewritten for the destination, in dependency order.

Each ``prepare_*`` function turns source objects into create rows: allow-list, destination scope, and
references remapped through ``id_map`` ``(resource_type, source_id, dest_id)``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from spanferry.functions.predicates import is_code_bundle
from spanferry.operators.dedup import skip_migrated
from spanferry.operators.joins import DEFAULT_LIMITS, JoinLimits
from spanferry.operators.project import project_allowed, stamp_destination, strip_readonly
from spanferry.operators.remap import (
    TypeRule,
    classify_acl,
    remap_array,
    remap_fk,
    remap_function_refs,
    remap_nested,
    remap_polymorphic,
    remap_scope,
)
from spanferry.operators.resolve import match_by_name, merge_mappings
from spanferry.shared import settle

CODE_BUNDLE = "code_bundle_not_migratable"

# Create columns known from the service's published schema. Other kinds fall back to
# dropping the read-only columns.
CREATE_COLUMNS: dict[str, tuple[str, ...]] = {
    "prompt": ("project_id", "name", "slug", "description", "prompt_data", "tags", "function_type"),
    "acl": (
        "object_type", "object_id", "user_id", "group_id", "permission", "restrict_object_type", "role_id",
    ),
}

# Organisation-wide kinds first, then project kinds in dependency order, grants last.
COPY_ORDER = (
    "role", "group", "dataset", "project_tag", "span_iframe", "function", "prompt", "project_score",
    "experiment", "view", "acl",
)


@dataclass(frozen=True)
class Scope:
    """Where objects go."""

    project_id: str | None = None
    org_id: str | None = None
    map_users: bool = False
    projects: DataFrame | None = None
    create_columns: Mapping[str, Sequence[str]] = field(default_factory=lambda: CREATE_COLUMNS)
    limits: JoinLimits = DEFAULT_LIMITS


def of_type(id_map: DataFrame, kind: str) -> DataFrame:
    """The ``(source_id, dest_id)`` pairs of one kind."""
    return id_map.where(F.col("resource_type") == kind).select("source_id", "dest_id")


def create_row(df: DataFrame, kind: str, scope: Scope) -> DataFrame:
    """Columns a create call sends, next to ``source_id``."""
    tagged = df.withColumn("source_id", F.col("id"))
    allowed = scope.create_columns.get(kind)
    if allowed is None:
        return strip_readonly(tagged)
    return project_allowed(tagged, [*allowed, "source_id"])


def _in_project(df: DataFrame, scope: Scope) -> DataFrame:
    return stamp_destination(df, project_id=scope.project_id)


def _by_project_map(df: DataFrame, scope: Scope) -> DataFrame:
    if scope.projects is None:
        return _in_project(df, scope)
    return remap_scope(df, scope.projects, "project_id", scope.project_id, scope.limits)


def prepare_experiments(df: DataFrame, id_map: DataFrame, scope: Scope) -> DataFrame:
    """Base experiment, dataset and saved parameters; a miss clears the reference."""
    table = out = _in_project(create_row(df, "experiment", scope), scope)
    for col, kind, paired in (
        ("base_exp_id", "experiment", ()),
        ("dataset_id", "dataset", ()),
        ("parameters_id", "prompt", ("parameters_version",)),
    ):
        if col in out.columns:
            paired = [p for p in paired if p in out.columns]
            out = remap_fk(out, of_type(id_map, kind), col, "null", paired, scope.limits, table)
    return out


def prepare_datasets(df: DataFrame, id_map: DataFrame, scope: Scope) -> DataFrame:
    """Datasets refer to nothing but their project."""
    return _in_project(create_row(df, "dataset", scope), scope)


def prepare_functions(df: DataFrame, id_map: DataFrame, scope: Scope) -> DataFrame:
    """The origin points at a prompt, dataset, experiment or project; a miss drops it."""
    out = _in_project(create_row(df, "function", scope), scope)
    return remap_nested(
        out,
        id_map,
        "origin.object_id",
        "drop_struct",
        type_field="object_type",
        types=("prompt", "dataset", "experiment", "project"),
        constants={"project": scope.project_id},
        limits=scope.limits,
    )


def prepare_prompts(df: DataFrame, id_map: DataFrame, scope: Scope) -> DataFrame:
    """Tool functions by id (other references stay) and the prompt a prompt was derived from."""
    out = _in_project(create_row(df, "prompt", scope), scope)
    tools = remap_function_refs(
        out.withColumn("_tools", F.col("prompt_data.tool_functions")),
        of_type(id_map, "function"), "_tools", ["source_id"], "keep", scope.limits,
    )
    out = tools.withColumn(
        "prompt_data",
        F.when(F.col("prompt_data").isNotNull(), F.col("prompt_data").withField("tool_functions", F.col("_tools"))),
    ).drop("_tools")
    return remap_nested(
        out,
        of_type(id_map, "prompt"),
        "prompt_data.origin.prompt_id",
        "drop_struct",
        also={"project_id": scope.project_id},
        limits=scope.limits,
    )


def prepare_scores(df: DataFrame, id_map: DataFrame, scope: Scope) -> DataFrame:
    """Online scorers by id; references of unknown kind are dropped."""
    out = _by_project_map(create_row(df, "project_score", scope), scope)
    scorers = remap_function_refs(
        out.withColumn("_scorers", F.col("config.online.scorers")),
        of_type(id_map, "function"), "_scorers", ["source_id"], "drop", scope.limits,
    )
    config = F.col("config")
    rewritten = F.when(config["online"].isNotNull(), config.withField("online.scorers", F.col("_scorers"))).otherwise(config)
    return scorers.withColumn("config", rewritten).drop("_scorers")


def prepare_tags(df: DataFrame, id_map: DataFrame, scope: Scope) -> DataFrame:
    """Tags belong to a project only."""
    return _by_project_map(create_row(df, "project_tag", scope), scope)


def prepare_iframes(df: DataFrame, id_map: DataFrame, scope: Scope) -> DataFrame:
    """Span iframes belong to a project only."""
    return _in_project(create_row(df, "span_iframe", scope), scope)


def prepare_views(df: DataFrame, id_map: DataFrame, scope: Scope) -> DataFrame:
    """The viewed object: the destination project, a mapped experiment or dataset, else the source id."""
    out = create_row(df, "view", scope)
    rules = {
        "project": TypeRule(constant=scope.project_id),
        "experiment": TypeRule(resource_type="experiment"),
        "dataset": TypeRule(resource_type="dataset"),
    }
    return remap_polymorphic(out, id_map, rules, "object_type", "object_id", limits=scope.limits)


def prepare_roles(df: DataFrame, id_map: DataFrame, scope: Scope) -> DataFrame:
    """Inherited roles; when none maps the source list stays."""
    out = create_row(df, "role", scope)
    return remap_array(out, of_type(id_map, "role"), "member_roles", ["source_id"], on_empty="keep", limits=scope.limits)


def prepare_groups(df: DataFrame, id_map: DataFrame, scope: Scope) -> DataFrame:
    """Inherited groups as for roles; members by matched user, or no members at all."""
    out = create_row(df, "group", scope)
    out = remap_array(out, of_type(id_map, "group"), "member_groups", ["source_id"], on_empty="keep", limits=scope.limits)
    if not scope.map_users:
        return out.withColumn("member_users", F.lit(None).cast(out.schema["member_users"].dataType))
    return remap_array(
        out, of_type(id_map, "user"), "member_users", ["source_id"], distinct=True, on_empty="drop", limits=scope.limits
    )


def prepare_acls(df: DataFrame, id_map: DataFrame, scope: Scope) -> DataFrame:
    """Rewritten grants with ``skip_reason`` set on those that cannot be carried over."""
    out = create_row(df, "acl", scope)
    return classify_acl(out, id_map, scope.org_id, scope.map_users, limits=scope.limits)


PREPARE: dict[str, Callable[[DataFrame, DataFrame, Scope], DataFrame]] = {
    "role": prepare_roles,
    "group": prepare_groups,
    "dataset": prepare_datasets,
    "project_tag": prepare_tags,
    "span_iframe": prepare_iframes,
    "prompt": prepare_prompts,
    "function": prepare_functions,
    "experiment": prepare_experiments,
    "project_score": prepare_scores,
    "view": prepare_views,
    "acl": prepare_acls,
}


def new_id(kind: str, source_id: Column, scope_id: str | None) -> Column:
    """Id of an object to create: the same whenever the copy is run again."""
    return F.sha2(F.concat_ws("|", F.lit(kind), F.lit(scope_id or ""), source_id.cast("string")), 256)


@dataclass(frozen=True)
class TypeCopy:
    """One kind of object: rows to create, one result per source object, and the mapping afterwards."""

    create: DataFrame
    results: DataFrame
    id_map: DataFrame


def copy_type(df: DataFrame, kind: str, id_map: DataFrame, scope: Scope, project: str | None = None) -> TypeCopy:
    """Copy the objects of one kind that have no destination yet.

    Objects already in the mapping and code bundles are skipped, with a reason.
    """
    tagged = skip_migrated(df, of_type(id_map, kind), "id", scope.limits)
    if kind == "function":
        bundle = is_code_bundle(F.col("function_data.type"), F.col("function_data.data.type"))
        tagged = tagged.withColumn("skip_reason", F.when(bundle, F.coalesce("skip_reason", F.lit(CODE_BUNDLE))).otherwise(F.col("skip_reason")))
    elif kind == "acl":
        reasons = prepare_acls(df, id_map, scope).select(F.col("source_id").alias("id"), F.col("skip_reason").alias("_why"))
        tagged = tagged.join(reasons, ["id"]).withColumn("skip_reason", F.coalesce("skip_reason", "_why")).drop("_why")
    skipped = F.col("skip_reason").isNotNull()
    wanted = tagged.where(~skipped).select(*df.columns)
    assigned = new_id(kind, F.col("id"), scope.project_id or scope.org_id)
    names = F.col("name") if "name" in df.columns else F.lit(None).cast("string")
    results = tagged.select(
        F.lit("organization" if project is None else "project").alias("scope"),
        F.lit(project).cast("string").alias("project"),
        F.lit(kind).alias("resource_type"),
        F.col("id").alias("source_id"),
        F.coalesce("dest_id", F.when(~skipped, assigned)).alias("dest_id"),
        names.alias("name"),
        F.lit(True).alias("success"),
        skipped.alias("skipped"),
        "skip_reason",
        F.lit(None).cast("string").alias("error"),
    )
    created = wanted.select(F.lit(kind).alias("resource_type"), F.col("id").alias("source_id"), assigned.alias("dest_id"))
    merged = merge_mappings(id_map, created, keys=("resource_type", "source_id"))
    # References among objects of the same kind resolve to the ids assigned in this very run.
    ready = PREPARE[kind](wanted, merged, scope)
    if "skip_reason" in ready.columns:
        ready = ready.drop("skip_reason")
    create = ready.withColumn("id", new_id(kind, F.col("source_id"), scope.project_id or scope.org_id))
    return TypeCopy(create, results, merged)


def copy_objects(
    sources: Mapping[str, DataFrame],
    destinations: Mapping[str, DataFrame],
    id_map: DataFrame,
    scope: Scope,
    project: str | None = None,
) -> tuple[dict[str, TypeCopy], DataFrame, DataFrame]:
    """Copy every kind in dependency order; mappings flow from one kind to the next.

    For kinds that other objects refer to, objects of the same name in the destination are matched
    before anything is created. Returns the copies, all results and the final mapping.
    """
    copies: dict[str, TypeCopy] = {}
    results = None
    for kind in COPY_ORDER:
        if kind not in sources:
            continue
        if kind in destinations and "name" in sources[kind].columns:
            matched = match_by_name(
                sources[kind], destinations[kind], source_id="id", source_name="name",
                dest_id="id", dest_name="name", position=["id"], limits=scope.limits,
            ).withColumn("resource_type", F.lit(kind))
            id_map = merge_mappings(id_map, matched, keys=("resource_type", "source_id"))
        copy = copy_type(sources[kind], kind, id_map, scope, project)
        # The mapping of one kind feeds every later kind; settled, it is computed once.
        copies[kind], id_map = copy, settle(copy.id_map)
        results = copy.results if results is None else results.unionByName(copy.results)
    return copies, results, id_map
